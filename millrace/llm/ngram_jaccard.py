"""N-gram Jaccard join by set-relation skipping.

1. Exact document frequencies of all word shingles (hash buckets answer document groups, shared.py). A shingle of one
   document only can't be shared, so a set with under `percent` % shared shingles links with nothing and drops out.
2. Equal sets fall into one class; the rest of the work is on one set a class.
3. Sets are ordered rarest shingle first. Two linked sets share a shingle in their prefixes, so the components of the
   (prefix shingle, set) graph hold every link. Lists are joined to their smallest member, never paired.
4. Each such component is joined in memory: inverted lists are kept by position (sets in order of size) and searched
   only from the probing set on, skipping the blocks before it; and a set that is close to one already answered takes
   over that one's overlap counts, corrected by the lists of the shingles in which the two differ.
   A large component is dealt out as pairs of blocks, all of them: 16 blocks at most until a block holds `max_sets` sets
   or `max_tokens` shingles, and then as many as that takes.

Copies are never expanded into pairs, and no link is lost: the counts are exact.

Defined cases: null, empty or blank text: no set, n_shingles 0, linked with nothing (component_id is its own doc_id);
1 to n - 1 words: the whole sequence is the one shingle; rows that repeat a doc_id are one node; a row without a
doc_id takes its component from rows of equal text, or null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
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
    stored,
    unpack,
)
from millrace.llm.words import Words, mix, window_starts, windows

LOW = U64((1 << LOW_BITS) - 1)
KEY = ["s1", "s2", "n"]
HOT = 1000  # classes with this part of all rows or more, so as many classes at the most, meet their rows by broadcast
UNIT_BYTES = 16 << 20
SETS = "doc_id long, h long, n long, s1 long, s2 long, prefix int, tokens binary"
SETS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("prefix", pa.int32()), ("tokens", pa.binary())])
EDGES_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text, as ascending hashes."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    whole = windows(hashes, n)
    first = words.first.tolist()
    empty = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(mix(windows(hashes[a:b], b - a) ^ U64(b - a)) if b > a else empty)
    return out


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    return (bucket_of(h, buckets) << U64(LOW_BITS)) | (h & LOW)


def _send_shingles(n: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table["text"], n)
        found = np.sort(_keys(np.concatenate(sets), buckets))
        first, length = runs(found)
        keys = found[first]
        out: dict[str, list] = {"b": [], "g": [], "p": [], "q": []}
        for b, i, j in slices(keys >> U64(LOW_BITS)):
            out["b"].append(b)
            out["p"].append(pack(keys[i:j] & LOW))
            out["q"].append(pack(length[i:j], 4))
        out["g"] = [table["g"][0].as_py()] * len(out["b"])
        return columns(MESSAGE_SCHEMA, **out)

    return send


def _answer_shingles(table: pa.Table) -> pa.Table:
    """To each group, its shingles that two documents or more hold, with the number of documents."""
    groups, low, count, source = table["g"].to_numpy(), [], [], []
    for i, (p, q) in enumerate(zip(table["p"].to_pylist(), table["q"].to_pylist(), strict=True)):
        low.append(unpack(p))
        count.append(unpack(q, 4))
        source.append(np.full(len(low[-1]), i))
    key, number, src = np.concatenate(low), np.concatenate(count).astype(np.int64), np.concatenate(source)
    order = np.argsort(key)
    key, number, src = key[order], number[order], src[order]
    first, length = runs(key)
    total = np.repeat(np.add.reduceat(number, first), length)
    back = np.flatnonzero(total > 1)
    back = back[np.lexsort((key[back], src[back]))]
    out: dict[str, list] = {"g": [], "b": [], "p": [], "q": []}
    for i, lo, hi in slices(src[back]):
        out["g"].append(groups[i])
        out["p"].append(pack(key[back[lo:hi]]))
        out["q"].append(pack(np.minimum(total[back[lo:hi]], (1 << 32) - 1), 4))
    out["b"] = [table["b"][0].as_py()] * len(out["g"])
    return columns(REPLY_SCHEMA, **out)


def _make_sets(n: int, percent: int, buckets: int):
    def make(table: pa.Table, replies: pa.Table) -> pa.Table:
        keys, freq = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        if replies.num_rows:
            keys = np.concatenate([unpack(p) | U64(b << LOW_BITS) for b, p in zip(replies["b"].to_pylist(), replies["p"].to_pylist(), strict=True)])
            freq = np.concatenate([unpack(q, 4) for q in replies["q"].to_pylist()])
            order = np.argsort(keys)
            keys, freq = keys[order], freq[order]
        out: dict[str, list] = {"n": [], "s1": [], "s2": [], "prefix": [], "tokens": []}
        sets = shingle_sets(table["text"], n)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        wanted = _keys(flat, buckets)
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        shared_flat = keys[at] == wanted if len(keys) else np.zeros(len(flat), bool)
        df_flat = freq[at] if len(keys) else np.zeros(len(flat), np.uint64)
        lo = 0
        for s in sets:
            hi = lo + len(s)
            shared = shared_flat[lo:hi]
            size, common = len(s), int(shared.sum())
            out["n"].append(size)
            out["s1"].append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
            out["s2"].append(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
            need = -(-percent * size // 100)
            if size and common >= need:
                t = s[shared]
                t = t[np.lexsort((t, df_flat[lo:hi][shared]))]
                out["prefix"].append(max(0, size - need + 1 - (size - common)))
                out["tokens"].append(t.tobytes())
            else:
                out["prefix"].append(None)
                out["tokens"].append(None)
            lo = hi
        return columns(SETS_SCHEMA, doc_id=table["doc_id"].combine_chunks(), h=table["h"].combine_chunks(), **out)

    return make


def _prefixes(batches):
    for batch in batches:
        ids, tokens = [], []
        for i, prefix, raw in zip(batch["id"].to_pylist(), batch["prefix"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
            tokens.append(np.frombuffer(raw, np.int64, prefix))
            ids.append(np.full(prefix, i, np.int64))
        if ids:
            yield pa.record_batch([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(ids))], names=["t", "id"])


def link(ids: np.ndarray, size: np.ndarray, tokens: list[np.ndarray], percent: int, stats: dict | None = None) -> np.ndarray:
    """For each set, the smallest id reachable by links among these sets.

    tokens: of each set, the shingles that may be shared; size: of the whole set.
    stats: counts sets answered from nothing ("searched") and from a similar one ("derived").
    """
    m = len(ids)
    order = np.lexsort((ids, size))
    ids, size, tokens = ids[order], size[order].astype(np.int64), [tokens[i] for i in order]
    owner = np.repeat(np.arange(m), [len(t) for t in tokens])
    _, dense = np.unique(np.concatenate(tokens), return_inverse=True)
    often = np.bincount(dense)[dense] > 1
    owner, dense = owner[often], dense[often]
    lists = np.sort(dense * m + owner)  # position lists: by shingle, then by set in order of size
    holder = lists % m
    bounds = np.searchsorted(owner, np.arange(m + 1))
    own = [np.sort(dense[bounds[i] : bounds[i + 1]]) for i in range(m)]
    label = np.arange(m)

    def overlap(t: np.ndarray, x: int) -> np.ndarray:
        """How many of the shingles t each set from x on holds: list blocks before position x are skipped."""
        a = np.searchsorted(lists, t * m + x)
        b = np.searchsorted(lists, (t + 1) * m)
        length = b - a
        total = int(length.sum())
        if not total:
            return np.zeros(m, np.int64)
        step = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        return np.bincount(holder[np.repeat(a, length) + step], minlength=m)

    answered: list[tuple[int, np.ndarray]] = []
    for x in range(m):
        counts = None
        if answered and len(own[x]):
            r, known = max(answered, key=lambda a: a[1][x] / max(1, len(own[a[0]]) + len(own[x]) - a[1][x]))
            if len(own[r]) + len(own[x]) - 2 * known[x] < len(own[x]):
                counts = known + overlap(np.setdiff1d(own[x], own[r], True), x) - overlap(np.setdiff1d(own[r], own[x], True), x)
        if stats is not None:
            stats["searched" if counts is None else "derived"] = stats.get("searched" if counts is None else "derived", 0) + 1
        if counts is None:
            counts = overlap(own[x], x)
            answered = [*answered[-7:], (x, counts)]
        c, sizes = counts[x + 1 :], size[x + 1 :]
        linked = np.flatnonzero((c > 0) & (100 * c >= percent * (size[x] + sizes - c))) + x + 1
        if len(linked):
            met = np.unique(np.append(label[linked], label[x]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    least = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    out = np.empty(m, np.int64)
    out[order] = least[label]
    return out


def _link_blocks(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        key = np.stack([table[c].to_numpy() for c in ("component", "lo", "hi")])
        cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [table.num_rows]])
        ids, size = table["id"].to_numpy(), table["n"].to_numpy()
        raw = table["tokens"].to_pylist()
        u, v = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a > 1:
                root = link(ids[a:b], size[a:b], [np.frombuffer(x, np.uint64) for x in raw[a:b]], percent)
                moved = root != ids[a:b]
                u.append(ids[a:b][moved])
                v.append(root[moved])
        return columns(EDGES_SCHEMA, u=np.concatenate(u) if u else [], v=np.concatenate(v) if v else [])

    return run


def _sets(docs: DataFrame, n: int, percent: int, group_bytes: int) -> DataFrame:
    """A row per row of docs: doc_id, h (the text's hash) and its set; tokens is null where too few shingles are shared."""
    groups = group_count(docs, group_bytes)
    texts = grouped(docs, groups).withColumn("h", F.xxhash64("text"))
    sent = texts.groupBy("g").applyInArrow(_send_shingles(n, groups), MESSAGE)
    shared = sent.groupBy("b").applyInArrow(_answer_shingles, REPLY)
    return stored(texts.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_make_sets(n, percent, groups), SETS), "sets")


def _roots(one: DataFrame, percent: int, max_sets: int, max_tokens: int) -> DataFrame:
    """(id, component) of the sets `one` (id, n, prefix, tokens) that link with others; component is the smallest id reachable."""
    tokens = one.select("id", "prefix", "tokens").mapInArrow(_prefixes, "t long, id long")
    least = tokens.groupBy("t").agg(F.min("id").alias("lo"), F.max("id").alias("top")).where("lo < top").select("t", "lo")
    maybe = components(tokens.join(least, "t").where("id != lo").select(F.col("id").alias("u"), F.col("lo").alias("v")))

    maybe = stored(maybe, "maybe")
    weight = one.select("id", F.expr(f"octet_length(tokens) / {8.0 * max_tokens} + 1.0 / {max_sets}").alias("w")).join(maybe, "id")
    half = F.sum("w") / 2
    blocks = weight.groupBy("component").agg(F.greatest(F.ceil(half), F.least(F.lit(16), F.ceil(32 * half))).cast("int").alias("blocks"))
    dealt = one.join(maybe, "id").join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "n", "tokens")
    size = one.join(maybe, "id").join(blocks, "component").agg(F.sum(F.octet_length("tokens") * F.col("blocks"))).first()[0] or 0
    parts = max(4 * int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // UNIT_BYTES))
    k = F.pmod(F.xxhash64("component", "lo", "hi"), F.lit(parts)).cast("int")
    links = dealt.withColumn("k", k).groupBy("k").applyInArrow(_link_blocks(percent), "u long, v long")
    return components(links)


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows joined to their classes (KEY, copies, ...). A class with a large part of all rows doesn't gather them in one task."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") * HOT >= total
    hot = F.broadcast(classes.where(is_hot))  # HOT rows at most, by their share
    cold = rows.join(hot.select(*KEY), KEY, "left_anti").join(classes.where(~is_hot), KEY)
    return rows.join(hot, KEY).unionByName(cold)


def ngram_jaccard(docs: DataFrame, n: int = 5, percent: int = 75, max_sets: int = 4096, max_tokens: int = 4 << 20, group_bytes: int = 4 << 20) -> DataFrame:
    """Groups documents whose shingle sets link: 100 * intersection >= percent * union.

    docs: doc_id, text. Returns a row per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).
    """
    sets = _sets(docs, n, percent, group_bytes)

    linked = sets.where("n > 0 and tokens is not null")
    classes = stored(linked.groupBy(*KEY).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "classes")
    one = _with_class(linked, classes).where("doc_id = id").select("id", *KEY, "prefix", "tokens").dropDuplicates(KEY)
    one = stored(one.select("id", "n", "prefix", "tokens"), "one")
    roots = _roots(one, percent, max_sets, max_tokens)

    node = classes.join(roots, "id", "left").select(*KEY, "copies", F.coalesce("component", "id").alias("component"))
    found = _with_class(linked.select("doc_id", *KEY), stored(node, "node")).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    alone = sets.where("n = 0 or tokens is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)


def keep_texts(docs: DataFrame, n: int = 5, percent: int = 75, max_sets: int = 4096, max_tokens: int = 4 << 20, group_bytes: int = 4 << 20) -> DataFrame:
    """Of each group of linked rows one: the smallest doc_id (null last), then the smallest text hash, then the smallest row hash.

    A row is a node of its own whatever its doc_id, so a null or repeated doc_id neither drops a text nor links two.
    Rows without words link with nothing and all stay.
    """
    sets = _sets(docs, n, percent, group_bytes)
    key = ["_none", "_id", "_h"]  # of a row: doc_id is null, doc_id, hash of the text
    own = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("h").alias("_h")]
    linked = sets.where("n > 0 and tokens is not null").select(*own, "n", "s1", "s2", "prefix", "tokens")
    classes = linked.groupBy(*KEY).agg(F.min(F.struct(*key)).alias("row"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    one = _with_class(linked, classes).where(F.struct(*key) == F.col("row")).dropDuplicates(KEY)
    roots = _roots(stored(one.select("id", "n", "prefix", "tokens"), "one"), percent, max_sets, max_tokens)

    first = classes.join(roots, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("row").alias("row")).select("row.*")
    first = first.union(sets.where("n > 0 and tokens is null").select(*own))  # no other row has such a set
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.isNull().alias("_none"), F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64("text").alias("_h"), F.struct(*docs.columns).alias("_row"))
    kept = rows.join(first, key, "left_semi").groupBy(*key).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return kept.unionByName(docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")))
