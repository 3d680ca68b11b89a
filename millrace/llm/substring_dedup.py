"""Substring dedup by fixed-block anchors.

A passage of `window` words that two documents share holds a whole aligned block of `block` = (window + 1) // 2 words
of either one. So the index holds only the non-overlapping blocks of each document, and every rolling block-sized
window of every document probes it. Where a probe meets a block of another place, both places are seeds; each seed is
extended to all windows around it, whose full hashes are exchanged to find the smallest doc_id that holds them, and
covered words merge into maximal exact repeats.

Keys go from document groups to hash buckets once a group and distinct key (see shared.py), so a passage that a third
of all documents share costs one entry a group. Probe keys keep 40 bits beside their bucket: a collision makes a false
seed, which the full window hashes (64 bits) then reject.

Defined cases: null or empty text has no words and nothing is removed; a row without a doc_id never counts as the
earlier holder and loses nothing; rows that repeat a doc_id don't count as smaller than each other; a text of fewer
than `window` words is kept whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import (
    LOW_BITS,
    MESSAGE,
    MESSAGE_SCHEMA,
    REPLY,
    REPLY_SCHEMA,
    U64,
    bucket_of,
    columns,
    group_count,
    grouped,
    pack,
    runs,
    slices,
    unpack,
)
from millrace.llm.words import Words, cover, member, window_starts, windows

LOW = U64((1 << LOW_BITS) - 1)
RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first:long,length:long>>"
RESULT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())])))]
)


def _probe_keys(hashes: np.ndarray, block: int, buckets: int) -> np.ndarray:
    h = windows(hashes, block)
    return (bucket_of(h, buckets) << U64(LOW_BITS)) | (h & LOW)


def _send_probes(block: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        words = Words(table["text"])
        keys = _probe_keys(words.hashes(), block, buckets)
        at = np.flatnonzero(window_starts(words.first, block)[: len(keys)])
        place = at - np.repeat(words.first[:-1], words.count)[at]
        found = np.sort((keys[at] << U64(1)) | (place % block == 0).astype(np.uint64))
        first, length = runs(found >> U64(1))
        keys = found[first] >> U64(1)
        indexed = (found[first + length - 1] & U64(1)).astype(bool) if len(first) else np.zeros(0, bool)
        several = length > 1
        out: dict[str, list] = {"b": [], "g": [], "p": [], "q": []}
        for b, i, j in slices(keys >> U64(LOW_BITS)):
            out["b"].append(b)
            out["p"].append(pack(keys[i:j] & LOW))
            out["q"].append(np.packbits(indexed[i:j]).tobytes() + np.packbits(several[i:j]).tobytes())
        out["g"] = [table["g"][0].as_py()] * len(out["b"])
        return columns(MESSAGE_SCHEMA, **out)

    return send


def _answer_probes(table: pa.Table) -> pa.Table:
    """To each group, its keys that are indexed somewhere and stand in two places or more."""
    if table.num_rows >= 1 << 22:
        raise ValueError("more than 4 million groups: raise group_bytes")
    groups, parts = table["g"].to_numpy(), []
    for i, (p, q) in enumerate(zip(table["p"].to_pylist(), table["q"].to_pylist(), strict=True)):
        low = unpack(p)
        bits = np.unpackbits(np.frombuffer(q, np.uint8).reshape(2, -1), axis=1)[:, : len(low)].astype(np.uint64)
        parts.append((low << U64(24)) | U64(i << 2) | (bits[0] << U64(1)) | bits[1])
    found = np.sort(np.concatenate(parts))
    first, length = runs(found >> U64(24))
    flags = np.bitwise_or.reduceat(found & U64(3), first)
    hit = ((flags & U64(2)) > 0) & ((length > 1) | ((flags & U64(1)) > 0))
    found = found[np.repeat(hit, length)]
    back = np.sort((((found >> U64(2)) & U64((1 << 22) - 1)) << U64(LOW_BITS)) | (found >> U64(24)))
    out: dict[str, list] = {"g": [], "b": [], "p": [], "q": []}
    for i, lo, hi in slices(back >> U64(LOW_BITS)):
        out["g"].append(groups[i])
        out["p"].append(pack(back[lo:hi] & LOW))
    out["b"] = [table["b"][0].as_py()] * len(out["g"])
    out["q"] = [b""] * len(out["g"])
    return columns(REPLY_SCHEMA, **out)


def _by_doc_id(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows by ascending doc_id, their ids, and whether they have one."""
    table = table.sort_by("doc_id").combine_chunks()
    known = np.asarray(table["doc_id"].is_valid())
    return table, table["doc_id"].fill_null(0).to_numpy(), known


def _send_windows(block: int, window: int, buckets: int):
    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        table, ids, known = _by_doc_id(table)
        words = Words(table["text"])
        hashes = words.hashes()
        seeds = [unpack(p) | U64(b << LOW_BITS) for b, p in zip(replies["b"].to_pylist(), replies["p"].to_pylist(), strict=True)]
        out: dict[str, list] = {"b": [], "g": [], "p": [], "q": []}
        if seeds and len(hashes) >= window:
            seeded = member(np.sort(np.concatenate(seeds)), _probe_keys(hashes, block, buckets))
            before = np.concatenate([[0], np.cumsum(seeded)])
            n = len(hashes) - window + 1
            ahead = window - block + 1  # the places in a window where a block can begin
            row = words.row()
            at = np.flatnonzero(window_starts(words.first, window)[:n] & (before[ahead : n + ahead] > before[:n]) & known[row[:n]])
            h = windows(hashes, window)[at]
            order = np.argsort(h, kind="stable")
            h, doc = h[order], ids[row[at[order]]]
            first, length = runs(h)
            keys, least = h[first], doc[first]
            several = doc[first + length - 1] > least if len(first) else np.zeros(0, bool)
            for b, i, j in slices(bucket_of(keys, buckets)):
                out["b"].append(b)
                out["p"].append(pack(keys[i:j], 8))
                out["q"].append(least[i:j].tobytes() + several[i:j].tobytes())
        out["g"] = [table["g"][0].as_py()] * len(out["b"]) if out["b"] else []
        return columns(MESSAGE_SCHEMA, **out)

    return send


def _answer_windows(table: pa.Table) -> pa.Table:
    """To each group, its windows that two documents or more hold, with the smallest doc_id of all."""
    groups, keys, least, several, source = table["g"].to_numpy(), [], [], [], []
    for i, (p, q) in enumerate(zip(table["p"].to_pylist(), table["q"].to_pylist(), strict=True)):
        keys.append(unpack(p, 8))
        n = len(keys[-1])
        least.append(np.frombuffer(q, np.int64, n))
        several.append(np.frombuffer(q, bool, n, 8 * n))
        source.append(np.full(n, i))
    key, doc, multi, src = np.concatenate(keys), np.concatenate(least), np.concatenate(several), np.concatenate(source)
    order = np.argsort(key)
    key, doc, multi, src = key[order], doc[order], multi[order], src[order]
    first, length = runs(key)
    smallest = np.repeat(np.minimum.reduceat(doc, first), length)
    back = np.flatnonzero(np.repeat((length > 1) | np.logical_or.reduceat(multi, first), length))
    back = back[np.lexsort((key[back], src[back]))]
    out: dict[str, list] = {"g": [], "b": [], "p": [], "q": []}
    for i, lo, hi in slices(src[back]):
        out["g"].append(groups[i])
        out["p"].append(pack(key[back[lo:hi]], 8))
        out["q"].append(smallest[back[lo:hi]].tobytes())
    out["b"] = [table["b"][0].as_py()] * len(out["g"])
    return columns(REPLY_SCHEMA, **out)


def _remove(window: int):
    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, known = table["doc_id"].fill_null(0).to_numpy(), np.asarray(table["doc_id"].is_valid())
        words = Words(table["text"])
        n, row = len(words), words.row()
        gone = np.zeros(n, bool)
        if replies.num_rows and n >= window:
            key = np.concatenate([unpack(p, 8) for p in replies["p"].to_pylist()])
            least = np.concatenate([np.frombuffer(q, np.int64) for q in replies["q"].to_pylist()])
            order = np.argsort(key)
            key, least = key[order], least[order]
            h = windows(words.hashes(), window)
            at = np.flatnonzero(window_starts(words.first, window)[: len(h)] & known[row[: len(h)]] & member(key, h))
            at = at[least[np.searchsorted(key, h[at])] < ids[row[at]]]
            gone = cover(at, window, n)
        total = np.concatenate([[0], np.cumsum(gone)])[words.first]
        removed, kept, spans = np.diff(total), [], []
        raw, offsets, first = words.data, words.offsets, words.first
        for r in range(table.num_rows):
            parts = raw[offsets[r] : offsets[r + 1]].tobytes().split()
            if not removed[r]:
                spans.append([])
            else:
                mask = gone[first[r] : first[r + 1]]
                parts = compress(parts, (~mask).tolist())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"first": a, "length": b - a} for a, b in edge.reshape(-1, 2).tolist()])
            kept.append(b" ".join(parts))
        return columns(RESULT_SCHEMA, doc_id=table["doc_id"].combine_chunks(), n_words=words.count, n_removed=removed, kept=pa.array(kept, pa.binary()).cast(pa.string()), removed=spans)

    return remove


def substring_dedup(docs: DataFrame, window: int = 13, group_bytes: int = 4 << 20) -> DataFrame:
    """Removes from each document the words of every window of `window` words that a document of smaller doc_id holds.

    docs: doc_id, text. Returns a row per row: doc_id, n_words, n_removed, kept (the other words, joined by one space)
    and removed (the maximal removed spans, counted in words).
    """
    block = (window + 1) // 2
    groups = group_count(docs, group_bytes)
    buckets = groups
    texts = grouped(docs, groups)
    probes = texts.groupBy("g").applyInArrow(_send_probes(block, buckets), MESSAGE)
    seeds = probes.groupBy("b").applyInArrow(_answer_probes, REPLY)
    spread = texts.groupBy("g").cogroup(seeds.groupBy("g")).applyInArrow(_send_windows(block, window, buckets), MESSAGE)
    repeats = spread.groupBy("b").applyInArrow(_answer_windows, REPLY)
    return texts.groupBy("g").cogroup(repeats.groupBy("g")).applyInArrow(_remove(window), RESULT)


def digest(result: DataFrame) -> DataFrame:
    """The query's columns of substring_dedup's result."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
