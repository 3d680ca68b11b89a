"""Queries of aggregations and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.plans.allocation_queries import BANDS_SQL, banded
from millrace.plans.catalog import register, table
from millrace.plans.dedup_queries import CASCADE_SQL, PERMISSION_SQL, cascade
from millrace.plans.text_queries import FLAG_SQL, SIGNALS_SQL, signals

PERMISSION = PERMISSION_SQL.format(id="doc_id")


@register(
    "g1_counts_by_lane_and_permission",
    f"SELECT lang, count(*) FILTER (p = 'train')::BIGINT AS train, count(*) FILTER (p = 'validation')::BIGINT AS validation, count(*) FILTER (p = 'anneal')::BIGINT AS anneal FROM (SELECT lang, {PERMISSION} AS p FROM documents) GROUP BY lang",
)
def g1_counts_by_lane_and_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("lang", ids.permission(F.col("doc_id")).alias("p"))
    return df.groupBy("lang").pivot("p", ["train", "validation", "anneal"]).agg(F.count(F.lit(1))).na.fill(0)


@register("g1_rejections_by_source", f"WITH {CASCADE_SQL} SELECT source, status, count(*)::BIGINT AS n FROM cascade GROUP BY ALL")
def g1_rejections_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(spark, sf_dir).groupBy("source", "status").agg(F.count("*").alias("n"))


@register("g2_flag_counts", SIGNALS_SQL + ", f AS (SELECT unnest([x FOR x IN [" + FLAG_SQL.format(short="false") + "] IF x IS NOT NULL]) AS flag FROM sig) SELECT flag, count(*)::BIGINT AS n FROM f GROUP BY flag")
def g2_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.functions.quality import flags_v1

    return signals(spark, sf_dir).select(F.explode(flags_v1()).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@register("g3_turns_histogram", "SELECT turns, count(*)::BIGINT AS conversations FROM (SELECT conv_id, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id) GROUP BY turns")
def g3_turns_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return per.groupBy("turns").agg(F.count("*").alias("conversations"))


@register(
    "g4_percentiles",
    "SELECT lang, min(n_chars) AS least, quantile_cont(n_chars, 0.05) AS p05, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.95) AS p95, max(n_chars) AS most FROM documents GROUP BY lang",
)
def g4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, with linear interpolation."""
    p = lambda q: F.percentile("n_chars", F.lit(q))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("n_chars").alias("least"), p(0.05).alias("p05"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("n_chars").alias("most"))


@register(
    "g5_nearest_rank_percentiles",
    """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, f::DOUBLE AS f, n_chars AS value FROM r, (VALUES (0.1), (0.5), (0.9)) t(f) WHERE i = round_even(f::DOUBLE * (n - 1), 0) + 1""",
)
def g5_nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("lang")
    df = table(spark, sf_dir, "documents").select("lang", "n_chars", F.row_number().over(w.orderBy("n_chars", "doc_id")).alias("i"), F.count("*").over(w).alias("n"))
    df = df.withColumn("f", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))))
    return df.where(F.col("i") == F.bround(F.col("f") * (F.col("n") - 1)) + 1).select("lang", "f", F.col("n_chars").alias("value"))


@register(
    "g6_weighted_shares_and_caps",
    f"""WITH {BANDS_SQL}, w AS (SELECT band, CASE band WHEN 'B0' THEN 25 WHEN 'B1' THEN 50 WHEN 'B2' THEN 100 WHEN 'B3' THEN 115 ELSE 125 END AS w FROM banded)
    SELECT band, sum(w)::DOUBLE / (SELECT sum(w) FROM w) AS share, sum(w)::DOUBLE / (SELECT sum(w) FROM w) > 0.05 AS over_cap FROM w GROUP BY band""",
)
def g6_weighted_shares_and_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each band's share of the sampling weight (in hundredths, so sums are exact), held against a cap of 5 %."""
    weight = F.create_map(*[F.lit(x) for pair in (("B0", 25), ("B1", 50), ("B2", 100), ("B3", 115), ("B4", 125), ("B5", 125)) for x in pair])
    by = banded(spark, sf_dir).groupBy("band").agg(F.sum(weight[F.col("band")]).alias("w"))
    share = F.col("w").cast("double") / F.sum("w").over(Window.partitionBy())
    return by.select("band", share.alias("share"), (share > 0.05).alias("over_cap"))


@register(
    "g7_version_comparison",
    f"""WITH {CASCADE_SQL}, v AS (SELECT d.source, d.doc_id, length(d.text) AS n, c.status FROM documents d JOIN cascade c USING (doc_id))
    SELECT source, count(*)::BIGINT AS records_before, count(*) FILTER (status = 'admitted')::BIGINT AS records_after, sum(n)::BIGINT AS characters_before,
      coalesce(sum(n) FILTER (status = 'admitted'), 0)::BIGINT AS characters_after FROM v GROUP BY source""",
)
def g7_version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, n = F.col("status") == "admitted", F.length("text")
    return cascade(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("records_before"), F.count_if(kept).alias("records_after"), F.sum(n).alias("characters_before"), F.coalesce(F.sum(F.when(kept, n)), F.lit(0)).alias("characters_after")
    )


@register(
    "g8_character_flow",
    r"""WITH f AS (SELECT lang, length(text) AS raw, length(trim(regexp_replace(text, '[ \t]+', ' ', 'g'))) AS clean FROM documents)
    SELECT lang, sum(raw)::BIGINT AS raw, sum(clean)::BIGINT AS normalized, sum(least(clean, 8000))::BIGINT AS truncated, sum(CASE WHEN clean >= 80 THEN least(clean, 8000) ELSE 0 END)::BIGINT AS admitted FROM f GROUP BY lang""",
)
def g8_character_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that each step leaves, in one pass."""
    clean = F.length(F.trim(F.regexp_replace("text", r"[ \t]+", " ")))
    df = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("raw"), clean.alias("clean"))
    return df.groupBy("lang").agg(
        F.sum("raw").alias("raw"), F.sum("clean").alias("normalized"), F.sum(F.least("clean", F.lit(8000))).alias("truncated"), F.sum(F.when(F.col("clean") >= 80, F.least("clean", F.lit(8000))).otherwise(0)).alias("admitted")
    )


@register(
    "g9_extreme_examples",
    "SELECT lang, doc_id, n_chars, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r <= 5",
)
def g9_extreme_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest of each lane; ties in descending order of id, like the rest. Top k is the feature."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), F.desc("doc_id")))
    return table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", rank.cast("long").alias("place")).where("place <= 5")


@register("g10_supply_rollup", f"WITH {BANDS_SQL} SELECT lang, band, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS supply FROM banded GROUP BY ROLLUP (lang, band)")
def g10_supply_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(spark, sf_dir).rollup("lang", "band").agg(F.count("*").alias("n"), F.sum("n_chars").alias("supply"))


@register("g10_labels_by_band", f"WITH {BANDS_SQL} SELECT band, quality, toxic, count(*)::BIGINT AS n FROM banded JOIN labels USING (doc_id) GROUP BY ALL")
def g10_labels_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("band", "quality", "toxic").agg(F.count("*").alias("n"))


@register(
    "g15_ablation_metrics",
    r"""WITH w AS (SELECT lang, text, regexp_extract_all(text, '\S+') AS w FROM documents)
    SELECT lang, count(*) FILTER (trim(text) = '')::BIGINT AS empty, count(*) FILTER (len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ɏ]')) < 0.5 * len(regexp_extract_all(text, '\p{L}')))::BIGINT AS wrong_script,
      (sum(len(list_distinct(w)))::DOUBLE / sum(len(w))) AS unique_token_yield FROM w GROUP BY lang""",
)
def g15_ablation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)))
    wrong = F.regexp_count("text", F.lit("[A-Za-zÀ-ÖØ-öø-ɏ]")) < 0.5 * F.regexp_count("text", F.lit(r"\p{L}"))
    return df.groupBy("lang").agg(F.count_if(F.trim("text") == "").alias("empty"), F.count_if(wrong).alias("wrong_script"), (F.sum(F.size(F.array_distinct("w"))).cast("double") / F.sum(F.size("w"))).alias("unique_token_yield"))


@register("g15_source_copy_ratio")
def g15_source_copy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the two sides of each pair are: twice the matching blocks over both lengths, 0.9 and more being a copy."""
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, (x or "").split(), (y or "").split(), False).ratio() for x, y in zip(a, b, strict=True)])

    side = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("user").alias("src"), side("assistant").alias("tgt"))
    return p.select("conv_id", ratio("src", "tgt").alias("ratio")).withColumn("copy", F.col("ratio") >= 0.9)


@register(
    "g16_relative_changes",
    """WITH m AS (SELECT l_returnflag AS arm, sum(l_quantity) AS now, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS base FROM lineitem GROUP BY 1)
    SELECT arm, CASE WHEN base = 0 THEN NULL ELSE round((now - base) / base, 9) END AS change, CASE WHEN base = 0 THEN NULL ELSE (now - base) / base <= -0.1 END AS confirmed FROM m""",
)
def g16_relative_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative change to a base, null where the base is 0."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.sum("l_quantity").alias("now"), F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0)).alias("base"))
    change = F.when(F.col("base") != 0, (F.col("now") - F.col("base")) / F.col("base"))
    return m.select("arm", F.round(change, 9).alias("change"), (change <= -0.1).alias("confirmed"))


@register(
    "g17_accounting_identities",
    f"""WITH {CASCADE_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (status = 'admitted') AS admitted, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status LIKE '%overlap') AS overlap FROM cascade)
    SELECT 'drops' AS identity, (admitted + duplicate + overlap = total) AS holds, total::BIGINT AS total FROM c
    UNION ALL SELECT 'mix', sum(w) = 1.0, count(*)::BIGINT FROM (VALUES (0.53), (0.10), (0.10), (0.10), (0.085), (0.08), (0.005)) t(w)""",
)
def g17_accounting_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops add up to the input, and mixture weights to one, in exact numbers."""
    from decimal import Decimal

    from millrace.operators.allocation import MIXTURE

    st = F.col("status")
    c = cascade(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(st == "admitted").alias("a"), F.count_if(st == "duplicate").alias("d"), F.count_if(st.endswith("overlap")).alias("o"))
    drops = c.select(F.lit("drops").alias("identity"), (F.col("a") + F.col("d") + F.col("o") == F.col("total")).alias("holds"), "total")
    mix = spark.createDataFrame([(Decimal(w),) for w in MIXTURE.values()], "w decimal(10,4)").agg((F.sum("w") == 1).alias("holds"), F.count("*").alias("total"))
    return drops.unionByName(mix.select(F.lit("mix").alias("identity"), "holds", "total"))


@register("g18_throughput", "SELECT event_id, 2000 * 1e9 / ((event_id % 7 + 1) * 1000000000) AS physical_per_s, 1800 * 1e9 / ((event_id % 7 + 1) * 1000000000) AS nonpadding_per_s, 1500 * 1e9 / ((event_id % 7 + 1) * 1000000000) AS loss_per_s FROM events")
def g18_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from counted tokens and elapsed nanoseconds."""
    ns = (F.col("event_id") % 7 + 1) * 1_000_000_000
    rate = lambda n: (F.lit(float(n)) * 1e9) / ns
    return table(spark, sf_dir, "events").select("event_id", rate(2000).alias("physical_per_s"), rate(1800).alias("nonpadding_per_s"), rate(1500).alias("loss_per_s"))


@register(
    "v1_frozen_corpus_violations",
    f"""WITH {CASCADE_SQL}, k AS (SELECT doc_id, h, {PERMISSION} AS p FROM cascade JOIN d USING (doc_id) WHERE status = 'admitted')
    SELECT 'repeated_id' AS rule, (SELECT count(*) FROM (SELECT doc_id FROM k GROUP BY doc_id HAVING count(*) > 1))::BIGINT AS violations
    UNION ALL SELECT 'repeated_content', (SELECT count(*) FROM (SELECT h FROM k GROUP BY h HAVING count(*) > 1))::BIGINT
    UNION ALL SELECT 'split_group', (SELECT count(*) FROM (SELECT doc_id FROM k GROUP BY doc_id HAVING count(DISTINCT p) > 1))::BIGINT
    UNION ALL SELECT 'evaluation_overlap', (SELECT count(*) FROM k JOIN hits USING (doc_id))::BIGINT""",
)
def v1_frozen_corpus_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a frozen corpus, with the number of rows that break each."""
    from millrace.operators import dedup

    k = cascade(spark, sf_dir).where("status = 'admitted'").withColumn("p", ids.permission(F.col("doc_id")))
    broken = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    hits = dedup.overlapping(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")
    return (
        broken("repeated_id", k.groupBy("doc_id").count().where("count > 1"))
        .union(broken("repeated_content", k.groupBy("content_sha256").count().where("count > 1")))
        .union(broken("split_group", k.groupBy("doc_id").agg(F.count_distinct("p").alias("n")).where("n > 1")))
        .union(broken("evaluation_overlap", k.join(hits, "doc_id", "left_semi")))
    )
