"""Queries of deduplication, decontamination and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.functions.text import NORMALIZATION, casefold
from millrace.operators import dedup
from millrace.plans.catalog import register, table

TOKENS_SQL = r"""[x FOR x IN string_split(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'), ' ') IF x <> '']"""
FIREWALL_SQL = rf"""
bt AS (SELECT {TOKENS_SQL} AS w FROM benchmark),
ref AS (SELECT DISTINCT 13 AS k, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM bt)
        UNION SELECT DISTINCT len(w), array_to_string(w, ' ') FROM bt WHERE len(w) BETWEEN 5 AND 12),
dt AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM ref),
hits AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dt, ks)) JOIN ref USING (k, gram))
"""
CASCADE_SQL = FIREWALL_SQL + r""",
ev AS (SELECT DISTINCT sha256(text) AS h FROM benchmark),
d AS (SELECT doc_id, lang, source, sha256(text) AS h, CASE WHEN sha256(text) IN (SELECT h FROM ev) THEN 'exact_evaluation_overlap'
        WHEN doc_id IN (SELECT doc_id FROM hits) THEN 'ngram_evaluation_overlap' END AS reason FROM documents),
cascade AS (SELECT doc_id, lang, source, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY h, reason ORDER BY doc_id) = 1 THEN 'admitted' ELSE 'duplicate' END) AS status FROM d)
"""
PERMISSION_SQL = "CASE WHEN substr(sha256('millrace-partition-v1|' || {id}), 1, 16) < '1999999999999999' THEN 'validation' WHEN substr(sha256('millrace-partition-v1|' || {id}), 1, 16) < '1eb851eb851eb851' THEN 'anneal' ELSE 'train' END"


FIREWALL = {"firewall": {"n": 13, "least": 5}, "order": ["doc_id"], "split": ids.PARTITION_SEED}
FREEZE_POLICY = dedup.policy_text(NORMALIZATION, FIREWALL)


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cascade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@register(
    "entry_curation_summary",
    f"WITH {CASCADE_SQL} SELECT lang, {PERMISSION_SQL.format(id='doc_id')} AS permission, status, count(*)::BIGINT AS documents FROM cascade GROUP BY ALL",
)
def entry_curation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cascade(spark, sf_dir).withColumn("permission", ids.permission(F.col("doc_id")))
    return df.groupBy("lang", "permission", "status").agg(F.count("*").alias("documents"))


@register("j1_exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha256 FROM documents GROUP BY 2")
def j1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each content."""
    df = table(spark, sf_dir, "documents").select("doc_id", ids.sha256(F.col("text")).alias("content_sha256"))
    return df.groupBy("content_sha256").agg(F.min("doc_id").alias("doc_id"))


@register(
    "j1_lane_priority_dedup",
    """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, source, doc_id) AS r FROM documents) WHERE r = 1""",
)
def j1_lane_priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal contents, the one of the lane with the highest priority, then by source and id."""
    df = table(spark, sf_dir, "documents").withColumn("h", ids.sha256(F.col("text")))
    lane = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return dedup.first_per_key(df, ["h"], [lane, "source", "doc_id"]).select("doc_id", "lang")


@register("j2_per_source_dedup", "SELECT source, min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY source, 3")
def j2_per_source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", ids.sha256(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@register("j3_exact_evaluation_overlap", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark)")
def j3_exact_evaluation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", ids.sha256(F.col("text")).alias("h"))
    evaluation = table(spark, sf_dir, "benchmark").select(ids.sha256(F.col("text")).alias("h"))
    return df.join(dedup.bounded(evaluation, "h"), "h", "left_anti").select("doc_id")


@register("j4_normalized_tokens", f"WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS tokens, sha256(array_to_string(w, ' ')) AS tokens_sha256 FROM t")
def j4_normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.functions.text import firewall_tokens

    df = table(spark, sf_dir, "documents").select("doc_id", firewall_tokens(F.col("text")).alias("w"))
    return df.select("doc_id", F.size("w").cast("long").alias("tokens"), ids.sha256(F.array_join("w", " ")).alias("tokens_sha256"))


@register("j5_ngram_firewall", f"WITH {FIREWALL_SQL} SELECT doc_id FROM hits")
def j5_ngram_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.overlapping(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


@register("j6_rejection_cascade", f"WITH {CASCADE_SQL} SELECT doc_id, status FROM cascade")
def j6_rejection_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade(spark, sf_dir).select("doc_id", "status")


@register(
    "j7_freeze",
    f"WITH {CASCADE_SQL} SELECT doc_id, {PERMISSION_SQL.format(id='doc_id')} AS permission, count(*) OVER (PARTITION BY doc_id) > 1 AS repeated_id, sha256('{FREEZE_POLICY}') AS pipeline_sha256 FROM cascade WHERE status = 'admitted'",
)
def j7_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted records with their split, the pipeline's hash, and whether an id repeats (an error)."""
    from pyspark.sql import Window

    df = cascade(spark, sf_dir).where("status = 'admitted'")
    again = F.count("*").over(Window.partitionBy("doc_id")) > 1
    return df.select("doc_id", ids.permission(F.col("doc_id")).alias("permission"), again.alias("repeated_id"), F.lit(dedup.policy_hash(NORMALIZATION, FIREWALL)).alias("pipeline_sha256"))


@register(
    "j8_registry",
    "SELECT item_id % 50 AS evaluation_id, min(sha256(text)) AS content_sha256, count(DISTINCT sha256(text)) > 1 AS conflict FROM benchmark GROUP BY 1",
)
def j8_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 50).alias("evaluation_id"), "text")
    return dedup.registry(entries)


@register(
    "j8_canaries",
    """WITH c AS (SELECT DISTINCT replace(lower(text[1:40]), 'ß', 'ss') AS canary FROM benchmark)
    SELECT doc_id, canary FROM documents JOIN c ON contains(replace(lower(text), 'ß', 'ss'), canary)""",
)
def j8_canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a canary string; the first 40 characters of each item stand for canaries."""
    canaries = table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 40).alias("canary"))
    return dedup.canary_hits(table(spark, sf_dir, "documents"), canaries)


NEAR_SQL = r"""
n AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS t FROM documents),
w AS (SELECT min(doc_id) AS id, t, string_split(t, ' ') AS w FROM n GROUP BY t),
s AS (SELECT DISTINCT id, CASE WHEN len(w) >= 3 THEN array_to_string(w[i:i + 2], ' ') ELSE t END AS x FROM (SELECT id, t, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w)),
z AS (SELECT id, count(*) AS size FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT a, b, common, za.size AS size_a, zb.size AS size_b FROM p JOIN z za ON a = za.id JOIN z zb ON b = zb.id WHERE common >= 0.8 * (za.size + zb.size - common))
"""


@register("j9_near_duplicate_pairs", f"WITH {NEAR_SQL} SELECT a, b, common::BIGINT AS common, size_a::BIGINT AS size_a, size_b::BIGINT AS size_b FROM pairs")
def j9_near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 3-shingle sets of distinct texts with a Jaccard similarity of 0.8 and more, exactly."""
    from millrace.functions.text import casefold

    t = F.trim(F.regexp_replace(casefold(F.col("text")), r"(?U)\s+", " "))
    one = table(spark, sf_dir, "documents").groupBy(ids.sha256(t)).agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text"))
    return dedup.similar_pairs(one, "doc_id")


@register(
    "j10_components",
    f"""WITH RECURSIVE {NEAR_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    r(id, reach) AS (SELECT id, id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
    c AS (SELECT id, min(reach) AS component FROM r GROUP BY id)
    SELECT n.doc_id, c.component FROM n JOIN w USING (t) JOIN c ON w.id = c.id""",
)
def j10_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@register("j9_minhash_lsh")
def j9_minhash_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form by MinHash, which misses a pair of similarity 0.8 with a probability of 4 in 10 ** 9: links between classes of equal shingle sets,
    verified by their whole sets, and of distance 0 from a class's first row to each of its other rows."""
    links = dedup.minhash_links(table(spark, sf_dir, "documents"), "doc_id")
    return links.select("a", "b", F.round("distance", 9).alias("distance"))


@register(
    "j11_clean_representative",
    f"""WITH RECURSIVE {NEAR_SQL}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    r(id, reach) AS (SELECT id, id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
    c AS (SELECT id, min(reach) AS component FROM r GROUP BY id),
    d AS (SELECT n.doc_id, c.component, length(t) AS n, len(regexp_extract_all(t, '\\p{{L}}'))::DOUBLE / greatest(1, length(t)) AS alpha FROM n JOIN w USING (t) JOIN c ON w.id = c.id)
    SELECT component, min(doc_id) AS doc_id FROM d WHERE n >= 400 AND alpha >= 0.6 GROUP BY component""".replace("\\\\p", "\\p"),
)
def j11_clean_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each cluster of near duplicates, the first row that passes the filters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.trim(F.regexp_replace(casefold(F.col("text")), r"(?U)\s+", " "))
    clustered = dedup.near_duplicates(docs, "doc_id").join(docs.select("doc_id", t.alias("t")), "doc_id")
    passes = (F.length("t") >= 400) & (F.regexp_count("t", F.lit(r"\p{L}")).cast("double") / F.greatest(F.lit(1), F.length("t")) >= 0.6)
    return dedup.first_per_key(clustered.where(passes), ["component"], ["doc_id"]).select("component", "doc_id")


@register(
    "j12_snapshot_reconciliation",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'unlisted' END AS problem
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
)
def j12_snapshot_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids on one side only: a listed record that is missing, or one that isn't listed."""
    return dedup.reconcile(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@register(
    "j13_baseline_lookup",
    "SELECT l.doc_id, l.quality, d.lang, d.doc_id IS NULL AS missing FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id",
)
def j13_baseline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(False).alias("there"))
    return table(spark, sf_dir, "labels").join(d, "doc_id", "left").select("doc_id", "quality", "lang", F.coalesce("there", F.lit(True)).alias("missing"))


@register(
    "j14_manifest_enrichment",
    "SELECT o_orderkey, c_mktsegment AS lane, n_name AS tier FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
)
def j14_manifest_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane and tier of each index row from its manifest."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", F.col("c_mktsegment").alias("lane"), F.col("n_name").alias("tier"))


@register(
    "j16_leakage_between_arms",
    "SELECT l_suppkey AS cluster, count(DISTINCT l_returnflag)::BIGINT AS arms FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1",
)
def j16_leakage_between_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that stand in more than one arm."""
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster")).agg(F.count_distinct("l_returnflag").alias("arms"))
    return df.where("arms > 1")
