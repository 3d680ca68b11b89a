"""Token ids in a binary file format with Re-Pair grammar compression.

Documents are range-partitioned by doc_id and written as shards of about `shard_ids` ids, several to a partition. A shard
holds whole documents, each ended by id 0, and one grammar: frequent pairs of neighbouring ids are replaced by
nonterminals, again and again until no pair stands 8 times, and the shard stores the rules, the length that each rule
expands to, and the remaining sequence; so any range of ids is decoded by summing lengths and expanding only the symbols
that it meets (`Shard.slice`, and `read_range` over a whole folder).

Shard format, little-endian: magic b"RPB1"; four uint32: documents, rules, symbols, terminals (the tokenizer's number of
ids; symbols under it are ids); int64 doc_ids; uint8 known (0 where a doc_id is null); uint32 ids of each document; rules
as uint32 pairs; uint32 expansion length of each rule; uint32 symbols. Shards are rows (part, shard, n_ids, content) of
Parquet files, written by Spark, so any store that Spark writes to will do.

Encoding splits texts at single spaces between two visible characters, and between a letter and punctuation. The
tokenizer's pre-tokens never reach across such places, so the pieces (which repeat a lot) are encoded once each and
remembered, with the same ids as for the whole text.

Defined cases: a null text is an empty one, whose only id is the end; null doc_ids come first; rows that repeat a
doc_id stand beside each other, ordered by their texts' hash; rows without a doc_id, or of one doc_id, may fill many
partitions; a document is never cut, so one very long document is one shard of its size; a shard without a repeated pair
has no rules; an empty table gives no shards and an empty result; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import U64, release, runs, text_bytes
from millrace.llm.words import BASE, WINDOW, string_buffers
from millrace.session import scratch_path

END = 0
STEP = 1 << 17
SHARD = "part int, shard int, n_ids long, content binary"
SHARD_SCHEMA = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("content", pa.binary())])


# ---- encoding ----


class Encoder:
    """Ids of texts by a tokenizer file. Remembers the ids of short pieces in a table of fixed size: a piece of up to 16 bytes is its own
    key (two 64-bit numbers and its length, no hash stands for it), and a new one takes the place of the one that holds its slot.
    With 2 ** 21 slots and 2 ** 23 ids the memory is some 70 MB, whatever the texts; longer pieces aren't remembered."""

    def __init__(self, path: str | None = None, slots: int = 1 << 21, most_ids: int = 1 << 23):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer, self.slots, self.most_ids = Tokenizer.from_file(path), slots, most_ids
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab()
        self.terminals = max(vocabulary.values()) + 1
        self.bytes_of = np.zeros(self.terminals, np.int64)  # of a byte-level token, a character for each byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.encode()) if token in added else len(token)
        # punctuation (without the apostrophe) that may follow a letter as a new pre-token; not where a special token has such a place
        self.marks = np.zeros(256, bool)
        self.marks[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True
        for token in added:
            for x, y in zip(token, token[1:], strict=False):
                if x.isalpha() and ord(y) < 128:
                    self.marks[ord(y)] = False
        self._forget()

    def _forget(self) -> None:
        # of each slot: the piece's two halves, and where its ids begin (32 bits), how many they are and how many bytes it has (8 bits each)
        self.table = np.zeros((self.slots, 3), np.uint64)
        self.flat, self.used = np.zeros(1 << 16, np.uint16 if self.terminals <= 1 << 16 else np.uint32), 0

    def _ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces data[start:end], one piece's behind the other's, and how many each has.

        Pieces that begin with a space and a visible character and end with a visible one may stand one behind the other
        in a single text: between them are the very places at which texts are split.
        """
        visible, lead = _visible(data)
        inner = (data[start] == 0x20) & (end - start >= 2)
        inner &= (visible | lead)[np.minimum(start + 1, len(data) - 1)] & (visible[end - 1] | lead[np.maximum(end - 2, 0)])
        order = np.concatenate([np.flatnonzero(inner), np.flatnonzero(~inner)])
        length, joined = (end - start)[order], int(inner.sum())
        ends = np.cumsum(length)
        source = np.arange(int(ends[-1])) + np.repeat(start[order] - (ends - length), length)
        raw = data[source].tobytes()
        cut = np.unique(np.searchsorted(ends[:joined], np.arange(1 << 14, ends[joined - 1] + (1 << 14), 1 << 14), "left").clip(max=joined - 1)) if joined else []
        cuts = [0, *ends[cut].tolist()] if joined else [0]
        cuts += ends[joined:].tolist()
        texts = [raw[i:j].decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        reach = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(reach, ends)
        if not np.array_equal(reach[last], ends):
            raise ValueError("this tokenizer's tokens don't add up to the text's bytes")
        size = np.diff(np.concatenate([[-1], last]))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        begin = (np.cumsum(size) - size)[back]
        size = size[back]
        return ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(ids))], size

    def _keys(self, eight: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces of up to 16 bytes, the two halves as numbers, and the slot. eight: the eight bytes from each place on, as a number."""
        low, high = eight[start], eight[start + 8]
        low &= _MASKS[np.minimum(length, 8)]
        high &= _MASKS[np.maximum(length, 8) - 8]
        slot = (low ^ (high * WINDOW) ^ length.astype(np.uint64)) * U64(BASE)
        slot ^= slot >> U64(29)
        slot *= U64(0xBF58476D1CE4E5B9)
        return low, high, ((slot >> U64(32)) * U64(self.slots) >> U64(32)).astype(np.int64)

    def _some(self, data: np.ndarray, eight: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pieces one behind the other, and how many each has."""
        if self.used > self.most_ids:
            self._forget()
        short = length <= 16
        place = np.flatnonzero(short)
        low, high, slot = self._keys(eight, starts[place], length[place])
        held = self.table[slot]
        known = (held[:, 0] == low) & (held[:, 1] == high) & ((held[:, 2] & U64(0xFF)) == length[place].astype(np.uint64))
        begin, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begin[place], size[place] = held[:, 2] >> U64(16), (held[:, 2] >> U64(8)) & U64(0xFF)

        # the others: each distinct one is encoded once
        miss = np.flatnonzero(~known)
        order = miss[np.lexsort((length[place[miss]], high[miss], low[miss]))]
        a, b = order[:-1], order[1:]
        same = (low[a] == low[b]) & (high[a] == high[b]) & (length[place[a]] == length[place[b]])
        first = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
        one, of = order[first], np.cumsum(first) - 1  # distinct short pieces, and the number of each miss's
        long, seen = np.flatnonzero(~short), {}
        which = np.array([seen.setdefault(data[i:j].tobytes(), len(seen)) for i, j in zip(starts[long].tolist(), (starts + length)[long].tolist(), strict=True)], np.int64)
        firsts = long[np.unique(which, return_index=True)[1]] if len(long) else long
        new = np.concatenate([place[one], firsts])
        if len(new):
            ids, count = self._ids(data, starts[new], starts[new] + length[new])
            at = self.used + np.cumsum(count) - count
            self._append(ids)
            begin[place[order]], size[place[order]] = at[: len(one)][of], count[: len(one)][of]
            if len(long):
                begin[long], size[long] = at[len(one) :][which], count[len(one) :][which]
            where = (at[: len(one)] << 16) | (count[: len(one)] << 8) | length[place[one]]
            self.table[slot[one]] = np.stack([low[one], high[one], where.astype(np.uint64)], axis=1)
        source = np.repeat(begin - (np.cumsum(size) - size), size)
        source += np.arange(len(source))
        return self.flat[source], size

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column, each text ended by END, and the number of ids of each text."""
        data, offsets = string_buffers(column)
        starts, rows = pieces(data, offsets, self.marks)
        n = len(offsets) - 1
        if not len(starts):
            return np.full(n, END, np.uint32), np.ones(n, np.int64)
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))
        length = np.diff(np.append(starts, len(data)))
        parts = [self._some(data, eight, starts[i : i + STEP], length[i : i + STEP]) for i in range(0, len(starts), STEP)]
        ids, ends = np.concatenate([x for x, _ in parts]), np.cumsum(np.concatenate([k for _, k in parts]))
        per_row = np.diff(np.concatenate([[0], ends])[np.searchsorted(rows, np.arange(n + 1))])
        out = np.full(len(ids) + n, END, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(per_row + 1) - 1] = False
        out[inside] = ids
        return out, per_row + 1

    def _append(self, ids: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need + need // 4, 1 << 16) - self.used, self.flat.dtype)])
        self.flat[self.used : need] = ids
        self.used = need


#: Of a number's bytes from the first on, 0 to 8.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _visible(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Visible ASCII bytes, and first bytes of two-byte characters from U+00C0 on."""
    return (data >= 0x21) & (data <= 0x7E), (data >= 0xC3) & (data <= 0xDF)


def pieces(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of the texts begins, and its row: at a text's begin, at single spaces between visible characters, and at
    marks (a table of bytes: ASCII punctuation) behind a letter.

    Visible here: ASCII 0x21 to 0x7E, and two-byte characters from U+00C0 on; neither holds any white space.
    """
    n = len(data)
    begin = offsets[:-1][np.diff(offsets) > 0]
    cut = np.zeros(n, bool)
    if n > 2:
        visible, lead = _visible(data)
        before = visible.copy()
        before[1:] |= lead[:-1]  # the second byte of such a character
        cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & (visible | lead)[2:]
        cut[offsets[1:-1][offsets[1:-1] < n] - 1] = False  # the space is a text's last character
        if marks is not None:
            letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # U+00C0 to U+00FF without the two signs
            cut[1:] |= marks[data[1:]] & letter[:-1]
    cut[begin] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(offsets, starts, "right") - 1


# ---- Re-Pair ----


def compress(ids: np.ndarray, terminals: int, most: int = 8192, least: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, lengths, symbols): in each round the `most` most frequent pairs that stand `least` times or more are replaced, until no pair
    stands so often.

    A pair never spans a document's end. Rule r is symbol terminals + r and stands for the two symbols of its row; lengths are those of what
    the rules expand to. Of places that overlap every other one from the left is replaced, and a pair that this leaves under half of `least`
    waits for a later round. When a round has taken up all frequent pairs, the next one looks only at places that it changed or left.
    """
    seq, lengths, rules = ids.astype(np.uint32), np.ones(terminals, np.uint32), [np.zeros((0, 2), np.uint32)]
    at_once, open_places = most, None
    while len(seq) > 1:
        half = 16 if len(lengths) <= 1 << 16 else 32
        kind = np.uint32 if half == 16 else np.uint64
        if open_places is None:
            inside = seq != END
            place = np.flatnonzero(inside[:-1] & inside[1:])
            code = seq[:-1].astype(kind)
            code <<= half
            code |= seq[1:]
            code = code[place]
        else:
            place = open_places
            code = (seq[place].astype(kind) << half) | seq[place + 1]
        ordered = np.sort(code)
        first, count = runs(ordered)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        every = len(often) <= at_once
        if not every:
            often = often[np.argsort(-count[often], kind="stable")[:at_once]]
        chosen = ordered[first[often]]
        # a table from a pair's slot to its number; of pairs that share a slot one waits for a later round
        number = np.full(1 << 17, -1, np.int16)
        number[_slot(chosen)] = np.arange(len(chosen), dtype=np.int16)
        at = number[_slot(code)]
        hit = np.flatnonzero((chosen[at] == code) & (at >= 0))
        every &= int(np.sum(count[often])) == len(hit)
        at, hit = at[hit], place[hit]
        begin = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
        alternate = (np.arange(len(hit)) - np.repeat(begin, np.diff(np.append(begin, len(hit))))) % 2 == 0
        enough = np.bincount(at[alternate], minlength=len(chosen)) >= max(1, least // 2)
        if not enough.any():
            at_once, open_places = 1, None  # a pair alone keeps half of its places at least
            continue
        at_once = most
        taken = alternate & enough[at]
        rest, hit, at = hit[~taken], hit[taken], at[taken]
        symbol = (np.cumsum(enough) - 1 + len(lengths)).astype(np.uint32)
        pair = np.stack([chosen[enough] >> half, chosen[enough] & ((1 << half) - 1)], axis=1).astype(np.uint32)
        seq[hit] = symbol[at]
        lengths = np.concatenate([lengths, lengths[pair].sum(axis=1, dtype=np.uint32)])
        rules.append(pair)
        kept = np.ones(len(seq), bool)
        kept[hit + 1] = False
        if every:  # frequent pairs are now those with a new symbol, and what is left of the chosen ones
            rest = rest[kept[rest]]
            back = np.cumsum(kept, dtype=np.int32) - 1  # of the places that stay, the new one
            hit, rest = back[hit], back[rest]
        seq = seq[kept]
        open_places = None
        if every:
            near = np.unique(np.concatenate([hit - 1, hit, rest]))
            near = near[(near >= 0) & (near < len(seq) - 1)]
            open_places = near[(seq[near] != END) & (seq[near + 1] != END)]
    return np.concatenate(rules), lengths[terminals:], seq


def _slot(code: np.ndarray) -> np.ndarray:
    """17 bits of a hash of pairs."""
    if code.dtype == np.uint32:
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(15)
    return (code * U64(BASE)) >> U64(47)


def unfold(symbols: np.ndarray, rules: np.ndarray, terminals: int) -> np.ndarray:
    """The ids that symbols stand for, level by level: for few symbols, or the rules themselves."""
    while True:
        high = symbols >= terminals
        if not high.any():
            return symbols
        place = np.cumsum(high.astype(np.int64) + 1)
        out = np.zeros(int(place[-1]), np.uint32)
        at = place - 1 - high
        pair = rules[symbols[high].astype(np.int64) - terminals]
        out[at] = symbols
        out[at[high]], out[at[high] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


def write_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    rules, lengths, symbols = compress(ids, terminals)
    head = np.array([len(counts), len(rules), len(symbols), terminals], "<u4")
    known = np.array([i is not None for i in doc_ids], np.uint8)
    own = np.array([i or 0 for i in doc_ids], "<i8")
    return b"".join([b"RPB1", head.tobytes(), own.tobytes(), known.tobytes(), counts.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes()])


class Shard:
    """A shard's parts, read from its bytes."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"RPB1":
            raise ValueError("not a shard")
        docs, rules, symbols, self.terminals = (int(x) for x in np.frombuffer(raw, "<u4", 4, 4))
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        own, known = take("<i8", docs), take("u1", docs)
        self.doc_ids = [i if k else None for i, k in zip(own.tolist(), known.tolist(), strict=True)]
        self.counts = take("<u4", docs)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.symbols = take("<u4", symbols)

    def _sizes(self) -> np.ndarray:
        size = np.ones(len(self.symbols), np.int64)
        high = self.symbols >= self.terminals
        size[high] = self.lengths[self.symbols[high].astype(np.int64) - self.terminals]
        return size

    def ids(self) -> np.ndarray:
        """All ids: the rules are unfolded once, and each symbol copies what it stands for."""
        rules = np.arange(self.terminals, self.terminals + len(self.rules), dtype=np.uint32)
        flat = np.concatenate([np.arange(self.terminals, dtype=np.uint32), unfold(rules, self.rules, self.terminals)])
        begin = np.concatenate([np.arange(self.terminals), self.terminals + np.cumsum(self.lengths, dtype=np.int64) - self.lengths])
        size = self._sizes()
        source = np.repeat(begin[self.symbols] - (np.cumsum(size) - size), size)
        source += np.arange(len(source))
        return flat[source]

    def slice(self, start: int, n: int) -> np.ndarray:
        """Ids start up to start + n, expanding only the symbols that cover them."""
        end = np.cumsum(self._sizes())
        a, b = np.searchsorted(end, start, "right"), np.searchsorted(end, start + n, "left") + 1
        skip = start - (int(end[a - 1]) if a else 0)
        return unfold(self.symbols[a:b], self.rules, self.terminals)[skip : skip + n]


# ---- files ----

_encoders: dict[str | None, Encoder] = {}


def _write(path: str | None, shard_ids: int):
    def write(batches):
        from pyspark import TaskContext

        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder, part, shard = _encoders[path], TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def row():
            every = np.concatenate(ids)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(every)], pa.int64()), pa.array([write_shard(doc_ids, np.concatenate(counts), every, encoder.terminals)], pa.binary())], schema=SHARD_SCHEMA)

        for whole in batches:
            step = max(1, int(whole.num_rows * min(1 << 20, 2 * shard_ids) / max(1, whole.nbytes)))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x, n = encoder.encode(batch["text"])
                doc_ids += batch["doc_id"].to_pylist()
                counts.append(n)
                ids.append(x)
                held += len(x)
                if held >= shard_ids:
                    yield row()
                    doc_ids, counts, ids, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield row()
        release()

    return write


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = 1 << 20, part_bytes: int = 16 << 20) -> None:
    """Writes the ids of docs (doc_id, text), in ascending doc_id order, as shards in Parquet files in `folder`. path: the tokenizer's file.

    Ties are ordered by the text's hash and dealt out by their place in the input, so no id's rows are bound to one partition.
    """
    parts = max(1, -(-text_bytes(docs) // part_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("i")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_write(path, shard_ids), SHARD).write.option("compression", "zstd").parquet(folder)


def _offsets(shards: DataFrame) -> DataFrame:
    """(part, shard, before): the number of ids of all shards before each."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))  # a row a partition
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return shards.select("part", "shard", "n_ids").join(parts, "part").select("part", "shard", "n_ids", (F.col("_before") + within).alias("before"))


def _read(batches):
    for batch in batches:
        for part, shard, raw in zip(batch["part"].to_pylist(), batch["shard"].to_pylist(), batch["content"], strict=True):
            held = Shard(raw.as_buffer().to_pybytes())
            ids = np.ascontiguousarray(held.ids(), "<u4")
            counts = held.counts.astype(np.int64)
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            n = len(counts)
            yield pa.record_batch({"part": pa.array([part] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "doc_id": pa.array(held.doc_ids, pa.int64()), "start": pa.array(ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})
    release()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the shards of `folder`: start is the number of ids of all documents before it.

    The contents are read where they lie; only the documents' digests meet the shards' offsets.
    """
    shards = spark.read.schema(SHARD).parquet(folder)
    found = shards.select("part", "shard", "content").mapInArrow(_read, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    found = found.join(_offsets(shards).drop("n_ids"), ["part", "shard"])
    return found.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, folder: str, start: int, n: int) -> np.ndarray:
    """Ids start up to start + n of all documents in `folder`, from the shards that hold them and no others. The caller bounds n: the ids come to the driver."""
    shards = spark.read.schema(SHARD).parquet(folder)
    want = _offsets(shards).where((F.col("before") < start + n) & (F.col("before") + F.col("n_ids") > start)).drop("n_ids")
    met = shards.join(want, ["part", "shard"]).select("before", "n_ids", "content")

    def cut(batches):
        for batch in batches:
            for before, size, raw in zip(batch["before"].to_pylist(), batch["n_ids"].to_pylist(), batch["content"], strict=True):
                a, b = max(0, start - before), min(size, start + n - before)
                yield pa.record_batch({"before": pa.array([before]), "ids": pa.array([Shard(raw.as_buffer().to_pybytes()).slice(a, b - a).astype("<u4").tobytes()], pa.binary())})

    rows = met.mapInArrow(cut, "before long, ids binary").collect()
    return np.frombuffer(b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.before)), "<u4")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path)
    return read_tokens(docs.sparkSession, folder)
