"""A lossless byte-level tokenizer learned by counting, greedy longest-match encoding, and loss masks by origin."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from millrace.session import stored

# What a unit is, and the size limits of vocabulary entries.
UNIT = r"(?U)\s+|[\p{L}\p{N}_\x{200C}\x{200D}]+|[^\p{L}\p{N}_\s]+"
SPECIALS = ("<pad>", "<unk>", "<bos>", "<eos>")
PAD, UNK, BOS, EOS = range(4)
UNIT_BYTES, SOURCE_UNITS, PIECE_CHARACTERS, CHARACTER_PIECES = 64, 20_000, 8, 1000


def unit_counts(docs: DataFrame) -> DataFrame:
    """(unit, n): runs of white space, words or other characters, up to 64 bytes."""
    units = docs.select(F.explode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("unit"))
    return units.where(F.octet_length("unit") <= UNIT_BYTES).groupBy("unit").agg(F.count("*").alias("n"))


def character_counts(units: DataFrame) -> DataFrame:
    """(character, n) from unit counts: each distinct unit is taken apart once."""
    characters = units.select(F.explode(F.split("unit", "")).alias("character"), "n").where("character <> ''")
    return characters.groupBy("character").agg(F.sum("n").alias("n"))


def gain(n: Column, piece: Column) -> Column:
    return n * F.greatest(F.lit(1), F.octet_length(piece) - 1)


def substring_counts(units: DataFrame, top: int = SOURCE_UNITS) -> DataFrame:
    """(piece, n): substrings of 2 to 8 characters of the best-scoring units of 3 to 48 characters that are no space. The cut is the feature:
    only `top` units feed the candidates."""
    long = units.where(F.length("unit").between(3, 48) & ~F.col("unit").rlike(r"(?U)^\s+$")).withColumn("score", gain(F.col("n"), F.col("unit")))
    long = long.orderBy(F.desc("score"), "unit").limit(top)
    size = F.least(F.lit(PIECE_CHARACTERS), F.length("unit") - 1)
    spans = long.select("unit", "n", F.explode(F.sequence(F.lit(2), size)).alias("k"))
    spans = spans.select("unit", "n", "k", F.explode(F.sequence(F.lit(1), F.length("unit") - F.col("k") + 1)).alias("i"))
    return spans.groupBy(F.substring(F.col("unit"), F.col("i"), F.col("k")).alias("piece")).agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = 8192) -> DataFrame:
    """(id, piece binary, kind): specials, the 256 bytes, frequent characters, then units and substrings by score. A vocabulary is small by its size."""
    spark = docs.sparkSession
    units = stored(unit_counts(docs), "units")  # read three times
    fixed = [(i, s.encode(), "special") for i, s in enumerate(SPECIALS)] + [(len(SPECIALS) + b, bytes([b]), "byte") for b in range(256)]
    base = spark.createDataFrame(fixed, "id int, piece binary, kind string")
    characters = character_counts(units).orderBy(F.desc("n"), F.col("character").cast("binary")).limit(CHARACTER_PIECES)
    characters = characters.select(F.lit(0).alias("class"), F.col("n").alias("score"), F.col("character").cast("binary").alias("piece"), F.lit("character").alias("kind"))
    whole = units.select(F.lit(1).alias("class"), gain(F.col("n"), F.col("unit")).alias("score"), F.col("unit").cast("binary").alias("piece"), F.lit("unit").alias("kind"))
    parts = substring_counts(units)
    parts = parts.select(F.lit(1).alias("class"), gain(F.col("n"), F.col("piece")).alias("score"), F.col("piece").cast("binary").alias("piece"), F.lit("substring").alias("kind"))
    every = characters.union(whole).union(parts).join(base.select("piece"), "piece", "left_anti")
    one = every.groupBy("piece").agg(F.min_by(F.struct("class", "score", "kind"), F.struct("class", -F.col("score"), "kind")).alias("b")).select("piece", "b.*")
    ranked = one.orderBy("class", F.desc("score"), "piece", "kind").limit(size - len(fixed))
    place = F.row_number().over(Window.orderBy("class", F.desc("score"), "piece", "kind")) + (len(fixed) - 1)
    return base.union(ranked.select(place.alias("id"), "piece", "kind"))


class Trie:
    """Greedy longest match over byte pieces."""

    def __init__(self, pieces: list[tuple[int, bytes]]):
        self.ids = {p: i for i, p in pieces}
        self.pieces = dict(pieces)
        self.most = max(map(len, self.ids), default=1)
        self.starts = {}
        for p in self.ids:
            self.starts[p[:1]] = max(self.starts.get(p[:1], 1), len(p))

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and byte spans, with BOS and EOS at (0, 0) and (n, n)."""
        raw = text.encode()
        n, i, out, spans = len(raw), 0, [BOS], [(0, 0)]
        while i < n:
            for j in range(min(n, i + self.starts.get(raw[i : i + 1], 1)), i, -1):
                k = self.ids.get(raw[i:j])
                if k is not None:
                    break
            out.append(k)
            spans.append((i, j))
            i = j
        return [*out, EOS], [*spans, (n, n)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids if i not in (PAD, BOS, EOS)).decode()


TEXT_END = r"\Z"
#: Of each kind of record: the patterns whose group 1 bears loss, the rule's name, and the rule's name where none is found (None: an error).
SPANS = {
    "reasoning": ((re.compile(r"<reasoning>\n?(.*)" + TEXT_END, re.DOTALL),), "reasoning_answer_only", None),
    "translated": ((re.compile(r"<observation>\s*(.*)</observation>", re.DOTALL),), "translated_observation_only", None),
    "agentic": (
        (re.compile(r"^<assistant>\n(.*?)(?=^<(?:system|user|assistant|tool)>\n|" + TEXT_END + ")", re.DOTALL | re.MULTILINE), re.compile(r"(<tool_call>.*?</tool_call>)", re.DOTALL)),
        "assistant_origin_only",
        "agentic_context_only",
    ),
}
ZERO, FULL = "never_train_zero_loss", "full_text_causal"


def supervised_spans(text: str, kind: str) -> np.ndarray | None:
    """Character spans (n, 2) that bear loss, ascending, none within another; None for a kind without a pattern: the whole text."""
    if kind not in SPANS:
        return None
    patterns, _, without = SPANS[kind]
    found = np.array([m.span(1) for p in patterns for m in p.finditer(text)], np.int64).reshape(-1, 2)
    if without is None and not len(found):
        raise ValueError(f"no {kind} span")
    found = found[np.lexsort((-found[:, 1], found[:, 0]))]
    reach = np.maximum.accumulate(found[:, 1])
    return found[np.concatenate([[True], found[1:, 1] > reach[:-1]])] if len(found) else found


def byte_places(text: str) -> np.ndarray:
    """Of each character, and of the text's end, how many bytes stand before it."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]).astype(np.int64)


def loss_mask(text: str, spans: list[tuple[int, int]], kind: str, permission: str) -> tuple[list[int], str]:
    """For each token's byte span, whether it bears loss, and the name of the rule: a token must lie within one supervised span. The first
    token never does; the last one, the end, does if a span reaches it."""
    if permission == "never_train":
        return [0] * len(spans), ZERO
    own = supervised_spans(text, kind)
    mask = np.ones(len(spans), np.int64)
    rule = FULL
    if own is not None:
        rule = SPANS[kind][1] if len(own) else SPANS[kind][2]
        begin, end = byte_places(text)[own].T
        token = np.array(spans, np.int64)
        before = np.searchsorted(begin, token[:, 0], "right")  # spans that begin at or before the token; the last of them reaches furthest
        reach = np.concatenate([[-1], end])[before]
        mask = (reach >= token[:, 1]).astype(np.int64)
        mask[-1] = int(len(end) > 0 and end[-1] == token[-1, 1])
    mask[0] = 0
    return mask.tolist(), rule


def tokenizer_hash(vocab: DataFrame) -> str:
    """The hash of a vocabulary's ids, pieces and kinds: what a stored tokenizer is checked against when it is loaded."""
    rows = sorted((r.id, bytes(r.piece).hex(), r.kind) for r in vocab.select("id", "piece", "kind").collect())  # of the vocabulary's size
    return "sha256:" + hashlib.sha256(canonical_json({"specials": list(SPECIALS), "tokens": rows})).hexdigest()


def save_vocabulary(vocab: DataFrame, path: str) -> str:
    """Writes a vocabulary with its hash, and returns the hash."""
    claimed = tokenizer_hash(vocab)
    vocab.withColumn("tokenizer_hash", F.lit(claimed)).coalesce(1).write.mode("overwrite").parquet(path)
    return claimed


def load_vocabulary(spark, path: str, expected: str | None = None) -> DataFrame:
    """A stored vocabulary. An error if its content doesn't give the hash that it claims, or that is expected."""
    df = spark.read.parquet(path)
    claims = [r[0] for r in df.select("tokenizer_hash").distinct().collect()]  # one
    vocab = df.drop("tokenizer_hash")
    actual = tokenizer_hash(vocab)
    if claims != [actual] or expected not in (None, actual):
        raise ValueError("the tokenizer's hash doesn't fit its content")
    return vocab


def encode(df: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tokens, loss, loss_policy, decoded_equals_text) of df (key, text, kind, permission)."""
    rows = [(r.id, bytes(r.piece)) for r in vocab.select("id", "piece").collect()]  # of the vocabulary's size
    shared = df.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie([r for r in shared.value if r[0] >= len(SPECIALS)])
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, kind, permission in zip(*[batch[c].to_pylist() for c in ("text", "kind", "permission")], strict=True):
                ids, spans = trie.encode(text or "")
                mask, policy = loss_mask(text or "", spans, kind, permission)
                for o, x in zip(out, (ids, mask, policy, trie.decode(ids) == (text or "")), strict=True):
                    o.append(x)
            yield pa.record_batch([batch[key], pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.int8())), pa.array(out[2]), pa.array(out[3])], names=[key, "tokens", "loss", "loss_policy", "lossless"])

    kind = dict(df.dtypes)[key]
    return df.select(key, "text", "kind", "permission").mapInArrow(run, f"{key} {kind}, tokens array<int>, loss array<tinyint>, loss_policy string, lossless boolean")


def clip_to_loss(tokens: Column, loss: Column, k: Column) -> tuple[Column, Column]:
    """The shortest prefix whose loss adds up to k."""
    sums = F.aggregate(loss, F.struct(F.lit(0).alias("s"), F.lit(0).alias("i"), F.lit(0).alias("at")), lambda a, x: F.struct((a.s + x).alias("s"), (a.i + 1).alias("i"), F.when((a["at"] == 0) & (a.s + x == k), a.i + 1).otherwise(a["at"]).alias("at")), lambda a: a["at"])
    end = F.when(k == F.aggregate(loss, F.lit(0), lambda a, x: a + x), F.size(loss)).otherwise(sums)
    return F.slice(tokens, F.lit(1), end), F.slice(loss, F.lit(1), end)


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


@F.pandas_udf(IntegerType())
def effective_loss(tokens: pd.Series, loss: pd.Series, segments: pd.Series) -> pd.Series:
    """Positions whose shifted target bears loss: loss there, and the position before in the same segment."""
    return pd.Series([int(((np.asarray(m)[1:] > 0) & (np.asarray(s)[:-1] >= 0) & (np.asarray(s)[:-1] == np.asarray(s)[1:])).sum()) for m, s in zip(loss, segments, strict=True)])
