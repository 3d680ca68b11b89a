"""Benchmark decontamination against a broadcast hash set of normalised test n-grams.

Items and documents are lower-cased and cut into alphanumeric words. The 64-bit hashes of all item windows are
broadcast, every rolling window of every document is looked up, and each hit is verified word by word, byte for byte.
The set is a few sorted arrays over one byte buffer, some 40 bytes an item word. It goes out only up to `block_bytes` of
item text (16 MB: about 110 MB of set); a larger benchmark is dealt into blocks of that size and the documents pass block
after block, with the hits so far as a column written to the shared folder.

Defined cases: null or empty texts have no words and can't be hit or hit others; an item of fewer than n words is one
window; an item without item_id hits words but isn't listed; rows that repeat an id are separate documents (or one
item); an empty benchmark leaves all documents clean; other columns are carried along by `clean` and `remove_spans`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import release, runs, stored
from millrace.llm.words import ALNUM_WORDS, Words, _tables, cover, member, window_starts, windows

BLOCK_BYTES = 16 << 20


def _bytes_at(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all bytes of these spans, one span behind the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WindowSet:
    """The windows of a block of items: of each length, sorted hashes, where the words of each distinct window are, and which items hold it."""

    def __init__(self, rows: list[tuple[str | None, str | None]], n: int):
        words = Words(pa.array([t for _, t in rows], pa.string()), ALNUM_WORDS, True)
        self.names = [name for name, _ in rows]
        self.data, self.start, self.size = _tables(ALNUM_WORDS, True)[0][words.data], words.start, words.end - words.start
        self.layers: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        hashes, item = words.hashes(), words.row()
        wanted = np.minimum(words.count, n)  # the length of each item's windows
        for k in np.unique(wanted[wanted > 0]).tolist():
            h = windows(hashes, k)
            place = np.flatnonzero(window_starts(words.first, k)[: len(h)] & (wanted[item[: len(h)]] == k))
            place = place[np.lexsort((place, h[place]))]
            while len(place):  # windows of one hash and different words, if there ever are any, go to a layer of their own
                first, length = runs(h[place])
                one = place[first]
                alike = self._equal(self.data, self.start, self.size, place, np.repeat(one, length), k)
                of, holder = np.repeat(np.arange(len(first)), length)[alike], item[place[alike]]
                both = np.unique((of << 32) | holder)
                bounds = np.searchsorted(both >> 32, np.arange(len(first) + 1))
                self.layers.append((k, h[one], one, bounds, both & ((1 << 32) - 1)))
                place = place[~alike]

    def _equal(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, mine: np.ndarray, k: int, step: int = 1 << 15) -> np.ndarray:
        """Whether the k words from each of `at` on are those from `mine` on in this set; data: lower-case bytes."""
        out = np.zeros(len(at), bool)
        for i in range(0, len(at), step):
            a, b = at[i : i + step, None] + np.arange(k), mine[i : i + step, None] + np.arange(k)
            same = (size[a] == self.size[b]).all(axis=1)
            a, b = a[same].ravel(), b[same].ravel()
            if len(a):
                length = size[a]
                differ = data[_bytes_at(start[a], length)] != self.data[_bytes_at(self.start[b], length)]
                same[same] = np.add.reduceat(differ, (np.cumsum(length) - length)[::k]) == 0
            out[i : i + step] = same
        return out

    def _found(self, words: Words):
        """Of each length, where windows of this set occur, which ones, and the layer's arrays; compared word by word."""
        hashes, data = words.hashes(), None
        for k, keys, one, bounds, holders in self.layers:
            h = windows(hashes, k)
            at = np.flatnonzero(member(keys, h) & window_starts(words.first, k)[: len(h)])
            if len(at):
                data = _tables(ALNUM_WORDS, True)[0][words.data] if data is None else data
                window = np.searchsorted(keys, h[at])
                true = self._equal(data, words.start, words.end - words.start, at, one[window], k)
                yield k, at[true], window[true], keys, bounds, holders

    def places(self, words: Words, length: int) -> tuple[list[int], list[int]]:
        """The words at which windows of this length begin, and the windows' hashes."""
        found = [(at, keys[window].astype(np.int64)) for k, at, window, keys, _, _ in self._found(words) if k == length]
        return [x for at, _ in found for x in at.tolist()], [x for _, h in found for x in h.tolist()]

    def hits(self, words: Words, rows: int, listed: bool = True) -> tuple[np.ndarray, list[set]]:
        """Whether each word lies in an occurrence of a window, and the items whose windows occur in each row."""
        row, n = words.row(), len(words)
        hit = np.zeros(n, bool)
        items: list[set] = [set() for _ in range(rows)] if listed else []
        for k, at, window, _, bounds, holders in self._found(words):
            hit |= cover(at, k, n)
            if listed:
                both = np.unique((row[at] << 32) | window)
                for r, w in zip((both >> 32).tolist(), (both & ((1 << 32) - 1)).tolist(), strict=True):
                    items[r].update(self.names[i] for i in holders[bounds[w] : bounds[w + 1]].tolist())
        return hit, items


def _in_parts(batch: pa.RecordBatch, most: int = 4 << 20):
    """The batch in parts of about `most` bytes."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _scan(window_set, last: bool):
    def scan(batches):
        sets = window_set.value
        for whole in batches:
            for batch in _in_parts(whole):
                words = Words(batch["text"], ALNUM_WORDS, True)
                hit, items = sets.hits(words, batch.num_rows)
                first = words.first.tolist()
                if "hit" in batch.schema.names:  # what the blocks before have hit
                    for r, (old, names) in enumerate(zip(batch["hit"].to_pylist(), batch["items"].to_pylist(), strict=True)):
                        items[r].update(names)
                        if old is not None:
                            n = first[r + 1] - first[r]
                            hit[first[r] : first[r + 1]] |= np.unpackbits(np.frombuffer(old, np.uint8), count=n).astype(bool)
                n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
                marks = [np.packbits(hit[a:b]).tobytes() if k else None for a, b, k in zip(first[:-1], first[1:], n_hit.tolist(), strict=True)]
                out = {
                    "doc_id": batch["doc_id"],
                    "n_words": pa.array(words.count, pa.int64()),
                    "n_hit": pa.array(n_hit, pa.int64()),
                    "hit": pa.array(marks, pa.binary()),
                    "items": pa.array([sorted(x for x in names if x is not None) for names in items], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_pydict(out if last else out | {"text": batch["text"]})
        release()

    return scan


def _blocks(benchmark: DataFrame, n: int, block_bytes: int):
    """Broadcast window sets of about block_bytes of item text each, one after another, with True for the last one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in part.collect()], n)), b + 1 == blocks


def scan_windows(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, hit (a bit for each word, null if none is hit), items (ids with an occurring window, sorted)."""
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    columns = "doc_id long, n_words long, n_hit long, hit binary, items array<string>"
    for found, last in _blocks(benchmark, n, block_bytes):
        state = state.mapInArrow(_scan(found, last), columns if last else columns + ", text string")
        if not last:
            state = stored(state, "hits")
    return state


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return scan_windows(docs, benchmark, n, block_bytes).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    for found, last in _blocks(benchmark, n, block_bytes):
        docs = docs.mapInArrow(_cut(found, True), docs.schema)
        docs = docs if last else stored(docs, "clean")
    return docs


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents; the text from the first to the last character of each hit span is cut out.
    A benchmark of several blocks is cut block after block, so a window that meets a cut of an earlier block may escape;
    `clean` and `scan_windows` judge the whole text by all blocks."""
    for found, last in _blocks(benchmark, n, block_bytes):
        docs = docs.mapInArrow(_cut(found, False), docs.schema)
        docs = docs if last else stored(docs, "cut")
    return docs


def _cut(window_set, drop: bool):
    def cut(batches):
        sets = window_set.value
        for whole in batches:
            for batch in _in_parts(whole):
                words = Words(batch["text"], ALNUM_WORDS, True)
                hit, _ = sets.hits(words, batch.num_rows, False)
                total = np.diff(np.concatenate([[0], np.cumsum(hit)])[words.first])
                if drop:
                    yield batch.filter(pa.array(total == 0))
                elif not hit.any():
                    yield batch
                else:
                    texts = batch["text"].to_pylist()
                    for r in np.flatnonzero(total).tolist():
                        raw, lo = words.data[words.offsets[r] : words.offsets[r + 1]].tobytes(), int(words.offsets[r])
                        first = int(words.first[r])
                        mask = hit[first : int(words.first[r + 1])]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)
                        for a, b in reversed(edge.tolist()):
                            raw = raw[: int(words.start[first + a]) - lo] + raw[int(words.end[first + b - 1]) - lo :]
                        texts[r] = raw.decode()
                    at = batch.schema.get_field_index("text")
                    yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        release()

    return cut


# Items of n words or more have windows of n; the others one window of their own length.
ORACLE = r"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ks AS (SELECT DISTINCT k FROM bg),
dw AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dg AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw),
hits AS (SELECT dg.rid, dg.k, dg.i, bg.item_id FROM dg JOIN bg USING (k, g)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hw.n_hit, 0)::BIGINT AS n_hit, coalesce(hi.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
