"""Queries of hash splits, quotas, bands and selection."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.operators import allocation
from millrace.plans.catalog import register, table
from millrace.plans.dedup_queries import PERMISSION_SQL
from millrace.session import stored


@register("a1_permission_split", f"SELECT doc_id, {PERMISSION_SQL.format(id='doc_id')} AS permission FROM documents")
def a1_permission_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.permission(F.col("doc_id")).alias("permission"))


@register(
    "a2_arm_and_split",
    r"""WITH h AS (SELECT doc_id, substr(sha256('millrace-arms' || chr(31) || source || chr(31) || doc_id), 1, 16) AS h FROM documents)
    SELECT doc_id, h < '1999999999999999' AS held_out, (('0x' || h)::UBIGINT % 3)::BIGINT AS arm FROM h""",
)
def a2_arm_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("\x1f", F.lit("millrace-arms"), "source", F.col("doc_id").cast("string"))
    df = table(spark, sf_dir, "documents").select("doc_id", F.substring(ids.sha256(text), 1, 16).alias("h"))
    return df.select("doc_id", (F.col("h") < ids.threshold("0.10")).alias("held_out"), (ids.unsigned(F.col("h")) % 3).cast("long").alias("arm"))


@register(
    "a3_hash_top_k",
    r"""WITH h AS (SELECT doc_id, source, length(text) AS n, sha256('millrace-local-row|' || source || '|' || doc_id) AS h FROM documents),
    c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS r FROM h QUALIFY r <= 15)
    SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS q FROM c WHERE n >= 400) WHERE q <= 5""",
)
def a3_hash_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, the 15 rows of smallest hash are candidates; the first 5 that pass the gate are taken. A quota is the feature."""
    df = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    df = df.withColumn("h", ids.hash_rank("millrace-local-row", F.col("source"), F.col("doc_id")))
    w = Window.partitionBy("source").orderBy("h", "doc_id")
    df = df.withColumn("r", F.row_number().over(w)).where("r <= 15").where("n >= 400")
    return df.withColumn("q", F.row_number().over(w)).where("q <= 5").select("doc_id", "source")


@register(
    "a4_quota_take",
    r"""WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE length(text) >= 400)
    SELECT lang, count(*)::BIGINT AS taken, sum(doc_id)::BIGINT AS id_sum, count(*) < 150 AS shortfall FROM a WHERE r <= 150 GROUP BY lang""",
)
def a4_quota_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first accepted rows up to a quota, and whether the supply fell short."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    df = table(spark, sf_dir, "documents").where(F.length("text") >= 400).select("lang", "doc_id", rank.alias("r")).where("r <= 150")
    return df.groupBy("lang").agg(F.count("*").alias("taken"), F.sum("doc_id").alias("id_sum"), (F.count("*") < 150).alias("shortfall"))


@register(
    "a5_allocate_integer",
    r"""WITH w AS (SELECT c_mktsegment AS segment, count(*)::HUGEINT AS w FROM customer GROUP BY 1),
    p AS (SELECT segment, (w * 100003) // sum(w) OVER () AS part, (w * 100003) % sum(w) OVER () AS rest FROM w)
    SELECT segment, (part + CASE WHEN row_number() OVER (ORDER BY rest DESC, segment) <= 100003 - sum(part) OVER () THEN 1 ELSE 0 END)::BIGINT AS share FROM p""",
)
def a5_allocate_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("w"))
    return allocation.allocate_table(weights, 100_003, "segment", "w")


@register(
    "a5_a8_stage_budgets",
    r"""WITH s(stage, w) AS (VALUES ('seed', 5), ('general_foundation', 55), ('reasoning_skill_build', 20), ('long_context', 18), ('anneal', 2)),
    p AS (SELECT stage, 262144 * w // 100 AS part, 262144 * w % 100 AS rest FROM s)
    SELECT stage, (part + CASE WHEN row_number() OVER (ORDER BY rest DESC, stage) <= 262144 - sum(part) OVER () THEN 1 ELSE 0 END)::BIGINT AS target FROM p""",
)
def a5_a8_stage_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s["stage"], s["target"]) for s in allocation.schedule(262_144)], "stage string, target long")


@register("a6_a8_lane_targets")
def a6_a8_lane_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane targets with floors enforced, and tier targets of the lane that has tiers."""
    rows = []
    for s in allocation.schedule(262_144, reserve_tiers={"verified_native", "unverified_native", "translated"}):
        rows += [(s["stage"], lane, None, n) for lane, n in s["lanes"].items()] + [(s["stage"], "indic", tier, n) for tier, n in s["tiers"].items()]
    return spark.createDataFrame(rows, "stage string, lane string, tier string, target long")


BANDS_SQL = r"""
ranked AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents),
banded AS (SELECT doc_id, lang, source, n_chars, CASE WHEN (2 * r - 1) * 10000 <= 2 * n * 1000 THEN 'B0' WHEN (2 * r - 1) * 10000 <= 2 * n * 3000 THEN 'B1' WHEN (2 * r - 1) * 10000 <= 2 * n * 6000 THEN 'B2'
  WHEN (2 * r - 1) * 10000 <= 2 * n * 8200 THEN 'B3' WHEN (2 * r - 1) * 10000 <= 2 * n * 9500 THEN 'B4' ELSE 'B5' END AS band FROM ranked)
"""


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return allocation.difficulty_bands(docs, ["lang", "source"], "n_chars", "doc_id").withColumnRenamed("difficulty_band", "band")


@register("a7_difficulty_bands", f"WITH {BANDS_SQL} SELECT doc_id, band FROM banded")
def a7_difficulty_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(spark, sf_dir).select("doc_id", "band")


@register(
    "a8_supply",
    f"WITH {BANDS_SQL} SELECT {PERMISSION_SQL.format(id='doc_id')} AS permission, band, lang AS lane, sum(n_chars)::BIGINT AS supply FROM banded WHERE n_chars > 0 GROUP BY ALL",
)
def a8_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss-bearing supply by permission, band and lane; the schedule may not ask for more."""
    df = banded(spark, sf_dir).where("n_chars > 0").withColumn("permission", ids.permission(F.col("doc_id")))
    return df.groupBy("permission", "band", F.col("lang").alias("lane")).agg(F.sum("n_chars").alias("supply"))


@register(
    "a9_weighted_priority",
    r"""WITH d AS (SELECT doc_id, sha256('millrace-order|s|' || lang || '|-|' || doc_id) AS h, CASE lang WHEN 'en' THEN 1000000 WHEN 'de' THEN 250000 ELSE 1250000 END::HUGEINT AS w FROM documents),
    l AS (SELECT doc_id, w, ('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT * 1000000 AS hi, ('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT * 1000000 AS lo FROM d),
    q AS (SELECT doc_id, hi // w AS qh, ((hi % w) * 18446744073709551616::HUGEINT + lo) // w AS ql FROM l)
    SELECT doc_id, row_number() OVER (ORDER BY qh + ql // 18446744073709551616::HUGEINT, ql % 18446744073709551616::HUGEINT, doc_id) AS place FROM q""",
)
def a9_weighted_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each record in order of its 128-bit hash, scaled by a million and divided by its weight."""
    w = F.when(F.col("lang") == "en", 1_000_000).when(F.col("lang") == "de", 250_000).otherwise(1_250_000)
    text = F.concat_ws("|", F.lit("millrace-order"), F.lit("s"), "lang", F.lit("-"), F.col("doc_id").cast("string"))
    high, low = ids.weighted_priority(text, w)
    df = table(spark, sf_dir, "documents").select("doc_id", high.alias("high"), low.alias("low"))
    df = df.withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    slot = F.least(F.lit(1023), F.col("high") / F.lit(Decimal(2**64 // 256 * 1000))).cast("int")
    return allocation.running_sum(df, ["all"], ["high", "low", "doc_id"], slot, "one", "place").select("doc_id", "place")


def _select_sql() -> str:
    out = [f"WITH {BANDS_SQL}, t(stage, lane, target) AS (VALUES ('s1', 'en', 200000), ('s1', 'de', 40000), ('s1', 'fr', 30000), ('s2', 'en', 90000), ('s2', 'es', 25000), ('s2', 'de', 20000))"]
    for i, (stage, bands) in enumerate((("s1", "'B0', 'B1', 'B2'"), ("s2", "'B2', 'B3', 'B4'"))):
        used = " AND doc_id NOT IN (SELECT record_id FROM c0)" if i else ""
        out.append(
            rf"""e{i} AS (SELECT doc_id, lang, n_chars, target, sha256('millrace-order|{stage}|' || lang || '|-|' || doc_id) AS h FROM banded JOIN t ON lane = lang AND stage = '{stage}' WHERE band IN ({bands}) AND n_chars > 0{used}),
            l{i} AS (SELECT *, ('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT AS qh, ('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT AS ql FROM e{i}),
            r{i} AS (SELECT *, sum(n_chars) OVER (PARTITION BY lang ORDER BY qh, ql, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM l{i}),
            c{i} AS (SELECT '{stage}' AS stage, doc_id AS record_id, lang AS lane, least(n_chars, target - (upto - n_chars))::BIGINT AS selected FROM r{i} WHERE upto - n_chars < target)"""
        )
    return ", ".join(out) + " SELECT * FROM c0 UNION ALL SELECT * FROM c1"


@register("a10_select_for_schedule", _select_sql())
def a10_select_for_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages over the same supply: what the first one takes, clipped records included, the second one can't."""
    supply = banded(spark, sf_dir).selectExpr("doc_id AS record_id", "lang AS lane", "band", "n_chars AS loss", "1000000 AS weight_micros")
    lanes = lambda rows: F.broadcast(spark.createDataFrame(rows, "lane string, target long"))
    plan = [
        ("s1", lanes([("en", 200_000), ("de", 40_000), ("fr", 30_000)]), ("B0", "B1", "B2")),
        ("s2", lanes([("en", 90_000), ("es", 25_000), ("de", 20_000)]), ("B2", "B3", "B4")),
    ]
    return allocation.select_for_schedule(supply, plan, "millrace-order")


@register("a8_a10_executable_schedule")
def a8_a10_executable_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule that the documents' supply can fill, by permission, band, lane and tier, and the records chosen for it: what each target got."""
    lane = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "general", "fr", "indic", "de", "code", "es", "agentic")]), F.col("lang"))
    tiers = {"verified_native": "0.6", "translated": "0.4"}
    tier = F.element_at(F.array(*[F.lit(t) for t in tiers]), (F.crc32(F.col("source").cast("binary")) % len(tiers) + 1).cast("int"))
    records = banded(spark, sf_dir).select(F.col("doc_id").alias("record_id"), lane.alias("lane"), F.when(lane == "indic", tier).alias("tier"), "band", F.col("n_chars").alias("loss"), F.lit(1_000_000).alias("weight_micros"), ids.permission(F.col("doc_id")).alias("permission"))
    total = records.where("permission = 'train'").agg(F.sum("loss")).first()[0] or 0
    stages = (("one", "0.4", 256, ("B0", "B1", "B2"), "train"), ("two", "0.6", 512, ("B3", "B4", "B5"), "train"))
    plan = allocation.executable_schedule(total // 100, records, stages, mixture={"general": "0.8", "indic": "0.1", "code": "0.08", "agentic": "0.02"}, floors={"indic": "0.1"}, tiers=tiers)
    targets = [allocation.stage_targets(spark, s).withColumn("stage", F.lit(s["stage"])) for s in plan]
    every = targets[0].union(targets[1])
    chosen = allocation.select_for_schedule(records, [(s["stage"], t, s["bands"], s["permission"]) for s, t in zip(plan, targets, strict=True)], "millrace-order")
    return allocation.require_targets(stored(chosen, "chosen"), every).groupBy("stage", "lane").agg(F.sum("selected").alias("selected"), F.count("*").alias("records"))


@register(
    "a11_balanced_windows",
    r"""WITH w AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS i, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars, doc_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    c AS (SELECT * FROM w WHERE i <= n - 7), e AS (SELECT max(a) AS a, min(b) AS b FROM (SELECT lang, min(s) AS a, max(s) AS b FROM c GROUP BY lang)),
    b AS (SELECT lang, i, s, row_number() OVER (PARTITION BY lang ORDER BY abs(s - (e.a + e.b) // 2), i) AS r FROM c, e)
    SELECT lang, i::BIGINT AS start, s::BIGINT AS total FROM b WHERE r = 1""",
)
def a11_balanced_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.balanced_windows(table(spark, sf_dir, "documents").select("lang", "n_chars", "doc_id"), "lang", "n_chars", "doc_id", 8)


@register(
    "a12_equal_arms",
    r"""WITH h AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('millrace-equal|' || doc_id), doc_id) AS r FROM documents),
    m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) SELECT lang, doc_id FROM h, m WHERE r <= m.n""",
)
def a12_equal_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of each arm as the smallest one has, by hash."""
    df = table(spark, sf_dir, "documents").select("lang", "doc_id", ids.hash_rank("millrace-equal", F.col("doc_id")).alias("h"))
    least = df.groupBy("lang").count().agg(F.min("count").alias("least"))
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    return df.join(F.broadcast(least)).where("r <= least").select("lang", "doc_id")  # least is one row


@register(
    "a13_evenly_spaced",
    r"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
    p AS (SELECT DISTINCT round_even(k * (n - 1) / 36, 0)::BIGINT AS i FROM (SELECT DISTINCT n FROM r), range(0, 37) t(k)) SELECT doc_id FROM r JOIN p USING (i)""",
)
def a13_evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 37).select("doc_id")


@register(
    "a14_validation_probe",
    r"""WITH w AS (SELECT doc_id, lang, regexp_extract_all(text, '\S+') AS w FROM documents), m AS (SELECT doc_id, lang, [CASE WHEN length(x) > 3 THEN 1 ELSE 0 END FOR x IN w] AS loss FROM w),
    s AS (SELECT doc_id, lang, loss, unnest(range(0, greatest(1, len(loss) - 32), 32)) AS start FROM m), v AS (SELECT doc_id, lang, start, coalesce(list_sum(loss[start + 2:start + 64]), 0) AS loss FROM s),
    b AS (SELECT doc_id, lang, max(loss) AS loss, arg_min(start, (-loss, start)) AS start FROM v GROUP BY doc_id, lang HAVING max(loss) >= 30),
    f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('millrace-probe|' || doc_id), doc_id) AS r FROM b) SELECT lang, doc_id, start::BIGINT AS start, loss::BIGINT AS loss FROM f WHERE r = 1""",
)
def a14_validation_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per lane, the first record by hash that has a window with enough shifted loss, and its best window on a half-length stride."""
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)).alias("w"))
    df = df.withColumn("loss", F.transform("w", lambda x: (F.length(x) > 3).cast("int")))
    df = df.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("loss") - 33), F.lit(32))))
    df = df.select("doc_id", "lang", "start", F.expr("aggregate(slice(loss, start + 2, 63), 0L, (a, x) -> a + x)").alias("loss"))
    best = df.groupBy("doc_id", "lang").agg(F.max("loss").alias("loss"), F.min_by("start", F.struct(-F.col("loss"), F.col("start"))).cast("long").alias("start")).where("loss >= 30")
    return best.groupBy("lang").agg(F.min_by(F.struct("doc_id", "start", "loss"), F.struct(ids.hash_rank("millrace-probe", F.col("doc_id")), F.col("doc_id"))).alias("b")).select("lang", "b.doc_id", "b.start", "b.loss")


@register(
    "s2_block_offsets",
    r"""WITH c AS (SELECT n AS counter, (('0x' || substr(sha256('millrace-block|src0|' || n), 1, 16))::UBIGINT % 120)::BIGINT AS slot FROM range(0, 4000) t(n)),
    f AS (SELECT slot, min(counter) AS counter FROM c GROUP BY slot) SELECT slot * 100 AS block_offset, row_number() OVER (ORDER BY counter) AS place FROM f QUALIFY place <= 40""",
)
def s2_block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 distinct blocks of 100 rows out of 120, by hashed counters; a slot that comes again is passed over."""
    from millrace.sources.blocks import block_offsets

    return block_offsets(spark, "src0", 12_000, 40)


@register(
    "s3_bucket_ids",
    r"""WITH c AS (SELECT n AS counter, (('0x' || substr(sha256('millrace-bucket|src0|' || n), 1, 8))::UBIGINT % 256)::BIGINT AS slot FROM range(0, 8192) t(n)),
    f AS (SELECT slot, min(counter) AS counter FROM c GROUP BY slot) SELECT printf('%02x', slot) AS bucket, row_number() OVER (ORDER BY counter) AS place FROM f QUALIFY place <= 16""",
)
def s3_bucket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.blocks import bucket_ids

    return bucket_ids(spark, "src0", 16)
