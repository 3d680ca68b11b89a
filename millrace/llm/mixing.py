"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of doc_id and text. A document's virtual finish time is its source's words
up to and with it, divided by the source's target; a second pass over a source continues behind its first. All finish
times are cut where the words taken reach the budget. That is the order in which a fair queue would serve the sources.

The texts are scanned once: sizes and hashes go to a table in the shared folder, and all else reads that table's narrow
columns. Running sums don't gather a source in one task: the hash is cut into slots, more of them for more rows; sums of
(source, slot) give each slot its offset, and only rows of one source and slot are sorted together. The cut is found on a
histogram of finish times, and only the histogram's crossing bin is sorted.

Defined cases: null or empty text has size 0 and is not taken; a null source is a source, ordered last; rows that repeat
a doc_id are separate rows, shuffled apart unless their texts are equal too, as are rows without a doc_id; which of rows
equal in doc_id, source and text is taken is the same to the mix; an empty table gives an empty result; other columns are
carried along, and the operator's own begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored

WEIGHTS = (3, 1, 2)
SLOTS = 1024
BINS = 4096
ROWS = 50_000  # of a slot or bin, about, where there are more rows than SLOTS and BINS hold at that size


def size_of(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of doc_id and text, the same on every run."""
    both = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, _rank, _source_size, _target) from (source, _size): the budget is 150 % of all words, shared by weight;
    a target stops at twice its source and the excess is shared again. It has a row for each source."""
    by_source = sizes.groupBy("source").agg(F.sum("_size").alias("_source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    every = F.array(*[F.lit(w).cast("long") for w in weights])
    s = by_source.withColumn("_rank", rank).withColumn("_w", F.element_at(every, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(2 * F.col("_source_size") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(2 * F.col("_source_size") / F.col("_w"), "_rank").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("_source_size").over(Window.partitionBy())
    left = 3 * total - 4 * F.coalesce(F.sum("_source_size").over(fill), F.lit(0))
    s = s.withColumn("_rate", left.cast("double") / (2 * F.sum("_w").over(rest)).cast("double"))
    free = F.col("_w") * F.col("_rate") <= 2 * F.col("_source_size")
    at = Window.orderBy(2 * F.col("_source_size") / F.col("_w"), "_rank")
    s = s.withColumn("_free", F.max(free.cast("int")).over(at) == 1)
    rate = F.min_by("_rate", F.when(F.col("_free"), F.struct(2 * F.col("_source_size") / F.col("_w"), "_rank"))).over(Window.partitionBy())
    target = F.when(F.col("_free"), F.col("_w") * rate).otherwise(F.col("_source_size").cast("double") * 2)
    return s.select("source", "_rank", "_source_size", target.alias("_target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, slots: int | None = None, bins: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, source, any others; or the columns `keep` of it) with _size, _source_size, _target and _taken: the words that the
    mix takes of each row, 0, 1 or 2 times its size. _finish is its first virtual finish time, null where nothing can be taken."""
    keep = docs.columns if keep is None else keep
    own = {"_size": size_of(F.col("text")), "_key": shuffle_key(F.col("doc_id"), F.col("text")), "_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_of": F.col("source")}
    rows = stored(docs.withColumns(own).select(*keep, *own), "sizes")
    n, total = rows.agg(F.count("*"), F.sum("_size")).first()
    total = F.lit(total or 0).cast("long")
    slots, bins = slots or max(SLOTS, n // ROWS), bins or max(BINS, n // ROWS)
    targets = stored(source_targets(rows.select(F.col("_of").alias("source"), "_size"), weights), "targets")  # a row for each source

    rows = rows.withColumn("_slot", F.floor(F.col("_key") / ((1 << 60) // slots)).cast("int"))
    rows = rows.join(targets.withColumnRenamed("source", "_source"), F.col("_of").eqNullSafe(F.col("_source"))).drop("_source", "_of")
    offsets = rows.groupBy("_rank", "_slot").agg(F.sum("_size").alias("_sum"))
    offsets = offsets.select("_rank", "_slot", (F.sum("_sum").over(Window.partitionBy("_rank").orderBy("_slot")) - F.col("_sum")).alias("_offset"))
    order = Window.partitionBy("_rank", "_slot").orderBy("_key", "_doc", "_size").rowsBetween(Window.unboundedPreceding, 0)

    def finished(df: DataFrame) -> DataFrame:
        df = df.withColumn("_local", F.sum("_size").over(order)).join(offsets, ["_rank", "_slot"])
        end = F.col("_offset") + F.col("_local")
        able = (F.col("_size") > 0) & (F.col("_target") > 0)
        return df.withColumn("_finish", F.when(able, end / F.col("_target"))).withColumn("_again", F.when(able, (end + F.col("_source_size")) / F.col("_target")))

    one = lambda f: F.struct(F.col(f).alias("f"), F.col("_rank").alias("r"), F.col("_key").alias("k"), F.col("_doc").alias("d"), F.col("_size").alias("z"))
    narrow = finished(rows.select("_rank", "_slot", "_key", "_doc", "_size", "_source_size", "_target")).where("_finish is not null")
    items = narrow.select(F.explode(F.array(one("_finish"), one("_again"))).alias("i"))
    items = stored(items.withColumn("bin", F.least(F.floor(F.col("i.f") * bins), F.lit(4 * bins)).cast("int")), "items")
    hist = items.groupBy("bin").agg(F.sum("i.z").alias("z"))
    hist = hist.withColumn("upto", F.sum("z").over(Window.orderBy("bin")))  # a row a bin
    cross = hist.where(2 * F.col("upto") > 3 * total).agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("z")).alias("before")), "bin").alias("c")).first().c
    rows = finished(rows)
    if cross is None:
        taken = F.when(F.col("_finish").isNotNull(), 2).otherwise(0)
    else:
        inside = items.where(F.col("bin") == cross["bin"])
        inside = inside.withColumn("upto", F.sum("i.z").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(cross["before"]))
        last = inside.where(2 * F.col("upto") <= 3 * total).agg(F.max("i").alias("i")).first().i
        low = [cross["bin"] / bins, -1, 0, 0, 0] if last is None else [last["f"], last["r"], last["k"], last["d"], last["z"]]
        cut = F.struct(F.lit(float(low[0])).alias("f"), F.lit(low[1]).cast("int").alias("r"), F.lit(low[2]).cast("long").alias("k"), F.lit(low[3]).cast("long").alias("d"), F.lit(low[4]).cast("long").alias("z"))
        took = lambda f: F.when(F.col(f).isNotNull() & (one(f) <= cut), 1).otherwise(0)
        taken = took("_finish") + took("_again")
    return rows.withColumn("_taken", (taken * F.col("_size")).cast("long")).drop("_rank", "_slot", "_key", "_doc", "_local", "_offset", "_again")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    rows = mix_sources(docs, weights).where("_taken > 0")
    times = F.expr("explode(array_repeat(0, cast(_taken / _size as int)))")
    return rows.select(*docs.columns, times.alias("_copy")).drop("_copy")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s),
s2 AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s1),
s3 AS (SELECT *, (2 * source_size)::DOUBLE / w::DOUBLE AS ratio, sum(source_size) OVER ()::BIGINT AS total FROM s2),
s4 AS (SELECT *, (3 * total - 4 * coalesce(sum(source_size) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (2 * sum(w) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM s3),
s5 AS (SELECT *, max(CASE WHEN w * rate <= 2 * source_size THEN 1 ELSE 0 END) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free FROM s4),
level AS (SELECT rate FROM s5 WHERE free = 1 ORDER BY ratio, rnk LIMIT 1),
t AS (SELECT source, rnk, source_size, total, CASE WHEN free = 1 THEN w * (SELECT rate FROM level) ELSE 2.0::DOUBLE * source_size END AS target FROM s5),
j AS (SELECT d.doc_id, d.size, d.k, t.rnk, t.source_size, t.total, t.target,
             sum(d.size) OVER (PARTITION BY t.rnk ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             row_number() OVER () AS rid
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT rid, (upto + e.e * source_size)::DOUBLE / target AS f, rnk, k, doc_id, size, total FROM j, (VALUES (0), (1)) e(e) WHERE size > 0 AND target > 0),
c AS (SELECT rid, size, total, sum(size) OVER (ORDER BY f, rnk, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM i),
a AS (SELECT rid, sum(size) AS taken FROM c WHERE 2 * upto <= 3 * total GROUP BY rid)
SELECT j.doc_id, j.size, j.source_size, j.target, coalesce(a.taken, 0)::BIGINT AS taken FROM j LEFT JOIN a USING (rid)
"""
