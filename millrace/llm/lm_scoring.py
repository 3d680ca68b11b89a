"""Language-model scoring by context-tree weighting.

The model predicts a text's lower-cased bytes and a final end byte (0). Each byte is decomposed into eight binary
decisions, and each decision has a context tree over the last `DEPTH` bytes. A node's Krichevsky-Trofimov estimate is
mixed with its children's by their weighted block probabilities, so every depth takes part; below the deepest context
that training has seen, nothing is mixed in. The probability of a byte is a product of eight mixtures, and
`bits_per_byte` its code length.

Counting and scoring go by exchange. A document group of about 32 MB of text, which is worked off in slices of 1 MB, sends
each distinct (context, byte) it holds once with its training count, to a bucket by the last four bytes; buckets add up
the groups' counts; trees are built by the last two bytes, and only the nodes of depths 0 and 1 (at most 256 * 255 and 255 rows, whatever the corpus) are gathered
to join them; then the buckets answer each group with the log-probabilities of what it holds. Words for the base score
travel the same way. Neither counts nor model are ever in one place.

Defined cases: a null text is an empty text, which is scored by its end; a row without a doc_id is in the training
rows; repeated rows count repeatedly; with no training rows each bit has probability 1/2; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import MESSAGE, MESSAGE_SCHEMA, REPLY, REPLY_SCHEMA, U64, bucket_of, columns, grouped, pack, release, runs, slices, stored, text_bytes, unpack
from millrace.llm.words import Words, mix

DEPTH = 6
WIDTH = DEPTH + 1  # bytes of a key
SLICE = 1 << 20
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
RESULT_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]
)
NODE = "c1 int, m int, n0 double, n1 double, below double"
NODE_SCHEMA = pa.schema([("c1", pa.int32()), ("m", pa.int32()), ("n0", pa.float64()), ("n1", pa.float64()), ("below", pa.float64())])


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def byte_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte and each text's end byte: its last DEPTH bytes, the nearest first, and itself, as one number; and the texts' first places."""
    n = len(offsets) - 1
    first = offsets + np.arange(n + 1)
    seq = np.zeros(int(first[-1]), np.uint8)
    seq[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    upper = (seq >= 65) & (seq <= 90)
    seq[upper] += 32
    wide = seq.astype(np.uint64)
    keys = wide.copy()
    starts = first[:-1]
    for j in range(1, DEPTH + 1):
        c = np.zeros(len(seq), np.uint64)
        c[j:] = wide[: max(0, len(seq) - j)]
        for t in range(j):  # a context doesn't reach into the text before
            at = starts + t
            c[at[at < first[1:]]] = 0
        keys |= c << U64(8 * (DEPTH + 1 - j))
    return keys, first


def _near(keys: np.ndarray, count: int) -> np.ndarray:
    """A hash of the last `count` bytes of context."""
    return mix((keys >> U64(8 * (DEPTH + 1 - count))) + U64(1))


def _parts(table: pa.Table, slice_bytes: int):
    """Row ranges of a group with about slice_bytes bytes of text each; a longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy()
    bin_ = np.cumsum(size) // slice_bytes
    cut = [0, *(np.flatnonzero(np.diff(bin_)) + 1).tolist(), table.num_rows]
    return [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


def _distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, of keys with a last bit that is 1 where they don't count, and how often each counts."""
    found.sort()
    keys = found >> U64(1)
    first, length = runs(keys)
    fresh = np.add.reduceat(1 - (found & U64(1)).astype(np.int64), first) if len(first) else length
    return keys[first], fresh


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
    keys, n = keys[order], n[order]
    first, _ = runs(keys)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _add(parts: list, part: tuple[np.ndarray, np.ndarray]) -> None:
    """Puts a slice's keys to those before it; parts of like size are merged at once, so few are ever held twice."""
    parts.append(part)
    while len(parts) > 1 and len(parts[-2][0]) < 2 * len(parts[-1][0]):
        parts[-2:] = [_merged(parts[-2:])]


def _send(buckets: int, slice_bytes: int):
    """Distinct (context, byte) keys to buckets 0 .. buckets - 1, and distinct words to as many more behind them, with training counts."""

    def send(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        held = np.array([is_held_out(i) for i in table["doc_id"].to_pylist()], np.uint64)
        out: dict[str, list] = {"b": [], "g": [], "p": [], "q": []}
        contexts, tokens = [], []
        for a, b in _parts(table, slice_bytes):
            words = Words(table["text"].slice(a, b - a), lower=True)
            keys, first = byte_keys(words.data, words.offsets)
            _add(contexts, _distinct((keys << U64(1)) | np.repeat(held[a:b], np.diff(first))))
            h = (words.hashes() >> U64(1)) << U64(1)
            _add(tokens, _distinct(h | np.repeat(held[a:b], words.count)))

        def put(parts: list, shift: int, hashes, width: int) -> None:
            keys, fresh = _merged(parts)
            b = bucket_of(hashes(keys), buckets)
            order = np.argsort(b, kind="stable")
            keys, fresh, b = keys[order], fresh[order], b[order]
            for k, i, j in slices(b):
                out["b"].append(k + shift)
                out["p"].append(pack(keys[i:j], width))
                out["q"].append(pack(fresh[i:j], 4))

        put(contexts, 0, lambda k: _near(k, 4), WIDTH)
        put(tokens, buckets, lambda k: k << U64(1), 8)
        out["g"] = [g] * len(out["b"])
        del contexts, tokens
        release()
        return columns(MESSAGE_SCHEMA, **out)

    return send


def _gather(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all rows, ascending, with their summed counts."""
    key = np.concatenate([unpack(p, width) for p in table["p"].to_pylist()])
    n = np.concatenate([unpack(q, 4) for q in table["q"].to_pylist()]).astype(np.int64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first, _ = runs(key)
    return key[first], np.add.reduceat(n, first)


def _total(buckets: int):
    """Of a bucket, rows for the trees (b: the tree part, g: the bucket); of a bucket of words, a row b = -1 with their number and sum in q."""

    def total(table: pa.Table) -> pa.Table:
        b = table["b"][0].as_py()
        out: dict[str, list] = {"b": [], "g": [], "p": [], "q": []}
        if b >= buckets:
            _, n = _gather(table, 8)
            out = {"b": [-1], "g": [b], "p": [b""], "q": [f"{(n > 0).sum()} {n.sum()}".encode()]}
        else:
            keys, n = _gather(table, WIDTH)
            part = bucket_of(_near(keys, 2), buckets)
            order = np.argsort(part, kind="stable")
            keys, n, part = keys[order], n[order], part[order]
            for k, i, j in slices(part):
                out["b"].append(k)
                out["p"].append(pack(keys[i:j], WIDTH))
                out["q"].append(pack(np.minimum(n[i:j], (1 << 40) - 1), 5))
            out["g"] = [b] * len(out["b"])
        return columns(MESSAGE_SCHEMA, **out)

    return total


_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    small = x < 10
    y = np.where(small, x + 10, x)
    for k in range(10):
        shift += np.where(small, np.log(x + k), 0)
    z = 1 / y
    series = sum(c * z ** (2 * i + 1) for i, c in enumerate(_STIRLING))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - np.log(np.pi)


class Nodes:
    """The binary nodes of one depth: key (context << 8 | 1, bits so far), n0, n1, and the weight of stopping there."""

    def __init__(self, key, n0, n1, below=None):
        self.key, self.n0, self.n1 = key, n0, n1
        own = log_kt(n0, n1)
        self.log_weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones(len(key)) if below is None else np.exp(own - np.log(2) - self.log_weighted)

    def parents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the depth above, with counts and the sum of these nodes' weighted log-probabilities."""
        up, inverse = np.unique(((self.key >> U64(16)) << U64(8)) | (self.key & U64(255)), return_inverse=True)
        return up, *(np.bincount(inverse, x, len(up)) for x in (self.n0, self.n1, self.log_weighted))


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (context, byte): the eight node marks (1, bits so far) and the eight bits; shape (8, n)."""
    byte = (keys & U64(255)).astype(np.int64)
    level = np.arange(8)[:, None]
    return ((1 << level) | (byte >> (8 - level))).astype(np.uint64), (byte >> (7 - level)) & 1


def trees(keys: np.ndarray, n: np.ndarray, top: int) -> list[Nodes]:
    """Nodes of depths DEPTH down to `top`, the deepest first."""
    marks, bits = _bits(keys)
    node = ((keys >> U64(8)) << U64(8))[None] | marks
    key, inverse = np.unique(node.ravel(), return_inverse=True)
    n8 = np.tile(n.astype(np.float64), 8)
    ones = bits.ravel() == 1
    out = [Nodes(key, np.bincount(inverse[~ones], n8[~ones], len(key)), np.bincount(inverse[ones], n8[ones], len(key)))]
    while len(out) <= DEPTH - top:
        out.append(Nodes(*out[-1].parents()))
    return out


def log_probability(keys: np.ndarray, depths: list[Nodes]) -> np.ndarray:
    """The log10-probability of each byte in its context; depths: nodes of DEPTH down to 0."""
    marks, bits = _bits(keys)
    context, p, seen = (keys >> U64(8))[None], np.full(marks.shape, 0.5), np.zeros(marks.shape, bool)
    for nodes in depths:
        if len(nodes.key):
            want = (context << U64(8)) | marks
            at = np.searchsorted(nodes.key, want)
            at[at == len(nodes.key)] = 0
            here = nodes.key[at] == want
            zero, one = nodes.n0[at], nodes.n1[at]
            here &= zero + one > 0
            kt = (np.where(bits == 1, one, zero) + 0.5) / (zero + one + 1)
            p = np.where(here, np.where(seen, nodes.stop[at] * kt + (1 - nodes.stop[at]) * p, kt), p)
            seen |= here
        context = context >> U64(8)
    return np.log10(p).sum(axis=0)


def _counts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tree part: all keys, ascending, their training counts and the bucket each came from."""
    key = np.concatenate([unpack(p, WIDTH) for p in table["p"].to_pylist()])
    n = np.concatenate([unpack(q, 5) for q in table["q"].to_pylist()]).astype(np.int64)
    source = np.repeat(table["g"].to_numpy(), [len(p) // WIDTH for p in table["p"].to_pylist()])
    order = np.argsort(key)
    return key[order], n[order], source[order]


def _upper(table: pa.Table) -> pa.Table:
    keys, n, _ = _counts_of(table)
    key, n0, n1, below = trees(keys[n > 0], n[n > 0], 2)[-1].parents()
    return columns(NODE_SCHEMA, c1=(key >> U64(8)).astype(np.int32), m=(key & U64(255)).astype(np.int32), n0=n0, n1=n1, below=below)


def _probabilities(upper):
    def run(table: pa.Table) -> pa.Table:
        one, root = upper.value
        keys, n, source = _counts_of(table)
        logs = log_probability(keys, [*trees(keys[n > 0], n[n > 0], 2), one, root])
        order = np.argsort(source, kind="stable")
        out: dict[str, list] = {"b": [], "g": [], "p": [], "q": []}
        for b, i, j in slices(source[order]):
            out["b"].append(b)
            out["p"].append(pack(keys[order[i:j]], WIDTH))
            out["q"].append(logs[order[i:j]].astype("<f4").tobytes())
        out["g"] = [table["b"][0].as_py()] * len(out["b"])
        return columns(MESSAGE_SCHEMA, **out)

    return run


def _answer(buckets: int):
    def answer(messages: pa.Table, model: pa.Table) -> pa.Table:
        out: dict[str, list] = {"g": [], "b": [], "p": [], "q": []}
        if not messages.num_rows:
            return columns(REPLY_SCHEMA, **out)
        b = messages["b"][0].as_py()
        if b >= buckets:
            keys, values, width, kind = *_gather(messages, 8), 8, np.int64
        else:
            keys = np.concatenate([unpack(p, WIDTH) for p in model["p"].to_pylist()])
            values, width, kind = np.concatenate([np.frombuffer(q, "<f4") for q in model["q"].to_pylist()]), WIDTH, np.float32
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
        for g, p in zip(messages["g"].to_pylist(), messages["p"].to_pylist(), strict=True):
            out["g"].append(g)
            out["p"].append(p)
            out["q"].append(values[np.searchsorted(keys, unpack(p, width))].astype(kind).tobytes())
        out["b"] = [b] * len(out["g"])
        return columns(REPLY_SCHEMA, **out)

    return answer


class Index:
    """An open-addressing index of distinct keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._at(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            left, at = left[out], (at[out] + 1) & ((1 << self.bits) - 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each of keys, all of which must be in the index."""
        at = self._at(keys)
        out = self.slots[at]
        left = np.flatnonzero(self.keys[out] != keys)
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.slots[at[left]]
            left = left[self.keys[out[left]] != keys[left]]
        return out


def _score(buckets: int, known: int, total: int, ends: int, slice_bytes: int):
    """known: distinct training tokens; total: all training tokens; ends: training texts."""

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        parts = {True: ([], []), False: ([], [])}
        for b, p, q in zip(replies["b"].to_pylist(), replies["p"].to_pylist(), replies["q"].to_pylist(), strict=True):
            keys, values = parts[b >= buckets]
            keys.append(unpack(p, 8 if b >= buckets else WIDTH))
            values.append(np.frombuffer(q, np.int64 if b >= buckets else np.float32))
        del replies
        nothing = np.zeros(0, np.uint64)
        contexts, log_of = Index(np.concatenate([nothing, *parts[False][0]])), np.concatenate([np.zeros(0, np.float32), *parts[False][1]])
        tokens, count_of = Index(np.concatenate([nothing, *parts[True][0]])), np.concatenate([np.zeros(0, np.int64), *parts[True][1]])
        del parts
        ids, out = table["doc_id"].combine_chunks(), []
        for a, b in _parts(table, slice_bytes):
            words = Words(table["text"].slice(a, b - a), lower=True)
            keys, first = byte_keys(words.data, words.offsets)
            logs = log_of[contexts.find(keys)].astype(np.float64)
            n = len(words.count)
            counts = np.full(len(words) + n, ends, np.int64)
            begin = words.first + np.arange(n + 1)
            if len(words):
                counts[np.arange(len(words)) + words.row()] = count_of[tokens.find(words.hashes() >> U64(1))]
            base = np.log10((counts + 1) / (total + known + 1))
            out.append(
                columns(
                    RESULT_SCHEMA,
                    doc_id=ids.slice(a, b - a),
                    held_out=[is_held_out(i) for i in ids.slice(a, b - a).to_pylist()],
                    n_tokens=words.count + 1,
                    n_known=np.add.reduceat((counts > 0).astype(np.int64), begin[:-1]),
                    base_score=np.add.reduceat(base, begin[:-1]),
                    score=np.add.reduceat(logs, first[:-1]),
                    n_bytes=np.diff(words.offsets),
                )
            )
        del contexts, tokens
        release()
        return pa.concat_tables(out)

    return score


def score_texts(docs: DataFrame, group_bytes: int = 32 << 20, slice_bytes: int = SLICE) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte."""
    spark = docs.sparkSession
    groups = buckets = max(spark.sparkContext.defaultParallelism, -(-text_bytes(docs) // group_bytes))
    texts = grouped(docs, groups)
    messages = stored(texts.groupBy("g").applyInArrow(_send(buckets, slice_bytes), MESSAGE), "keys")
    totals = stored(messages.groupBy("b").applyInArrow(_total(buckets), MESSAGE), "counts")
    number = totals.where("b < 0").select(F.split(F.col("q").cast("string"), " ").alias("n")).agg(*[F.sum(F.col("n")[i].cast("long")) for i in (0, 1)]).first()
    number = [x or 0 for x in number]
    nodes = totals.where("b >= 0").groupBy("b").applyInArrow(_upper, NODE).groupBy("c1", "m").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    upper = sorted(tuple(r) for r in nodes.collect())  # at most 256 * 255 rows
    c1, m, n0, n1, below = (np.array([r[i] for r in upper], np.float64 if i > 1 else np.uint64) for i in range(5))
    one = Nodes((c1 << U64(8)) | m, n0, n1, below)
    root = Nodes(*one.parents())
    ends = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2).count()
    model = totals.where("b >= 0").groupBy("b").applyInArrow(_probabilities(spark.sparkContext.broadcast((one, root))), MESSAGE)
    replies = messages.groupBy("b").cogroup(model.groupBy("b")).applyInArrow(_answer(buckets), REPLY)
    known, total = int(number[0]) + (ends > 0), int(number[1]) + ends
    scored = texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(_score(buckets, known, total, ends, slice_bytes), RESULT)
    bits = -F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
