"""Queries of the tokenizer and the loss masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import ids
from millrace.operators import shards, tokenizer
from millrace.plans.catalog import register, table
from millrace.plans.dedup_queries import PERMISSION_SQL
from millrace.session import stored

UNITS_SQL = r"u AS (SELECT unnest(regexp_extract_all(text, '\s+|[\p{L}\p{N}_\x{200C}\x{200D}]+|[^\p{L}\p{N}_\s]+')) AS unit FROM documents), units AS (SELECT unit, count(*)::BIGINT AS n FROM u WHERE strlen(unit) <= 64 GROUP BY unit)"
CHARS_SQL = "chars AS (SELECT character, sum(n)::BIGINT AS n FROM (SELECT unnest(string_split(unit, '')) AS character, n FROM units) GROUP BY character)"
PIECES_SQL = r"""long AS (SELECT unit, n FROM units WHERE length(unit) BETWEEN 3 AND 48 AND NOT regexp_matches(unit, '^\s+$') ORDER BY n * greatest(1, strlen(unit) - 1) DESC, encode(unit) LIMIT 20000),
k AS (SELECT unit, n, unnest(range(2, least(8, length(unit) - 1) + 1)) AS k FROM long), i AS (SELECT unit, n, k, unnest(range(1, length(unit) - k + 2)) AS i FROM k),
pieces AS (SELECT substr(unit, i, k) AS piece, sum(n)::BIGINT AS n FROM i GROUP BY 1)"""


@register("k1_unit_counts", f"WITH {UNITS_SQL} SELECT unit, n FROM units")
def k1_unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.unit_counts(table(spark, sf_dir, "documents"))


@register("k1_character_counts", f"WITH {UNITS_SQL}, {CHARS_SQL} SELECT character, n FROM chars")
def k1_character_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.character_counts(tokenizer.unit_counts(table(spark, sf_dir, "documents")))


@register("k3_substring_counts", f"WITH {UNITS_SQL}, {PIECES_SQL} SELECT piece, n FROM pieces")
def k3_substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.substring_counts(tokenizer.unit_counts(table(spark, sf_dir, "documents")))


@register(
    "k2_vocabulary",
    rf"""WITH {UNITS_SQL}, {CHARS_SQL}, {PIECES_SQL},
    c AS (SELECT 0 AS class, n AS score, encode(character) AS piece, 'character' AS kind FROM chars ORDER BY n DESC, encode(character) LIMIT 1000),
    e AS (SELECT * FROM c UNION ALL SELECT 1, n * greatest(1, strlen(unit) - 1), encode(unit), 'unit' FROM units UNION ALL SELECT 1, n * greatest(1, strlen(piece) - 1), encode(piece), 'substring' FROM pieces),
    o AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY class, score DESC, kind) AS r FROM e WHERE octet_length(piece) > 1 OR hex(piece) > '7F'),
    b AS (SELECT * FROM o WHERE r = 1 AND hex(piece) NOT IN ('3C7061643E', '3C756E6B3E', '3C626F733E', '3C656F733E') QUALIFY row_number() OVER (ORDER BY class, score DESC, piece, kind) <= 8192 - 260),
    t AS (SELECT (row_number() OVER (ORDER BY class, score DESC, piece, kind) + 259)::INTEGER AS id, lower(hex(piece)) AS piece, kind FROM b)
    SELECT * FROM t UNION ALL SELECT (4 + v)::INTEGER, printf('%02x', v), 'byte' FROM range(0, 256) r(v)
    UNION ALL SELECT * FROM (VALUES (0, '3c7061643e', 'special'), (1, '3c756e6b3e', 'special'), (2, '3c626f733e', 'special'), (3, '3c656f733e', 'special')) s(id, piece, kind)""",
)
def k2_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.vocabulary(table(spark, sf_dir, "documents")).select("id", F.lower(F.hex("piece")).alias("piece"), "kind")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    permission = F.when(ids.permission(F.col("doc_id")) == "validation", "never_train").otherwise("train")
    return tokenizer.encode(docs.select("doc_id", "text", F.lit("plain").alias("kind"), permission.alias("permission")), tokenizer.vocabulary(docs))


@register("k4_k5_k8_encode")
def k4_k5_k8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, loss and whether decoding gives the text back."""
    df = encoded(spark, sf_dir)
    total = F.aggregate("loss", F.lit(0), lambda a, x: a + x)
    return df.select("doc_id", F.size("tokens").alias("tokens"), total.alias("loss_tokens"), "loss_policy", "lossless", F.xxhash64("tokens").alias("tokens_hash"))


@register("k7_conversation_loss")
def k7_conversation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the assistant's turns bear loss."""
    from millrace.plans.text_queries import p6_conversation_text

    text = p6_conversation_text(spark, sf_dir).select("conv_id", "text", F.lit("agentic").alias("kind"), F.lit("train").alias("permission"))
    df = tokenizer.encode(text, tokenizer.vocabulary(table(spark, sf_dir, "documents")), "conv_id")
    return df.select("conv_id", F.size("tokens").alias("tokens"), F.aggregate("loss", F.lit(0), lambda a, x: a + x).alias("loss_tokens"), "loss_policy", "lossless")


@register(
    "k7_assistant_characters",
    "SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS supervised_characters FROM conversations GROUP BY conv_id",
)
def k7_assistant_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("supervised_characters"))


# Shards of the tokenizer that knows the 256 bytes only: a text's ids are its bytes plus 4 between 2 and 3.
BYTES = 260
SEGMENT = 100_000
BYTE_TOKENS_SQL = rf"""d AS (SELECT lang AS lane, {PERMISSION_SQL.format(id="doc_id")} AS permission, doc_id AS record_id, text, (strlen(text) + 2)::BIGINT AS token_count FROM documents),
ix AS (SELECT *, CASE WHEN permission = 'validation' THEN 0 ELSE token_count - 1 END::BIGINT AS loss_count, (sum(token_count) OVER (PARTITION BY lane, permission ORDER BY record_id) - token_count)::BIGINT AS token_offset FROM d)"""
SEGMENTS_SQL = rf"""{BYTE_TOKENS_SQL},
hx AS (SELECT *, token_offset // {SEGMENT} AS segment, '0200' || array_to_string([printf('%02x%02x', (('0x' || h)::INTEGER + 4) % 256, (('0x' || h)::INTEGER + 4) // 256) FOR h IN regexp_extract_all(hex(encode(text)), '..')], '') || '0300' AS x,
  CASE WHEN permission = 'validation' THEN repeat('00', token_count) ELSE '00' || repeat('01', token_count - 1) END AS m FROM ix),
sg AS (SELECT lane, permission, segment, min(token_offset) AS first_offset, count(*)::BIGINT AS records, sum(token_count)::BIGINT AS tokens, sum(loss_count)::BIGINT AS loss_tokens,
  sha256(unhex(string_agg(x, '' ORDER BY token_offset))) AS payload_sha256, sha256(unhex(string_agg(m, '' ORDER BY token_offset))) AS loss_sha256 FROM hx GROUP BY ALL)"""
MANIFEST_SQL = SEGMENTS_SQL + r""",
mf AS (SELECT lane, permission, sum(records)::BIGINT AS records, sum(tokens)::BIGINT AS tokens, sum(loss_tokens)::BIGINT AS loss_tokens, count(*)::BIGINT AS segments,
  'sha256:' || sha256(string_agg(payload_sha256 || ':' || loss_sha256, chr(10) ORDER BY segment)) AS shard_hash FROM sg GROUP BY ALL)"""


def byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lane, permission, record_id, tokens, loss) of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    permission = ids.permission(F.col("doc_id"))
    rows = docs.select("doc_id", "text", F.lit("plain").alias("kind"), F.when(permission == "validation", "never_train").otherwise("train").alias("permission"))
    found = tokenizer.encode(rows, tokenizer.vocabulary(docs, BYTES))
    return found.join(docs.select("doc_id", F.col("lang").alias("lane"), permission.alias("permission")), "doc_id").select("lane", "permission", F.col("doc_id").alias("record_id"), "tokens", "loss")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.index(byte_tokens(spark, sf_dir))


@register("k9_shard_index", f"WITH {BYTE_TOKENS_SQL} SELECT lane, permission, record_id, token_offset, token_count, loss_count FROM ix")
def k9_shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each record's tokens lie in the shard of its lane and permission."""
    return _index(spark, sf_dir).select(*shards.INDEX.split(", "))


@register("s12_shard_segments", f"WITH {SEGMENTS_SQL} SELECT * FROM sg")
def s12_shard_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards' bytes, 16 bits an id and 8 a mark of loss, by hash."""
    return shards.segments(_index(spark, sf_dir), SEGMENT).drop("payload", "loss")


@register("k9_manifest", f"WITH {MANIFEST_SQL} SELECT * FROM mf")
def k9_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.manifest(shards.segments(_index(spark, sf_dir), SEGMENT))


@register(
    "l9_manifest_violations",
    f"""WITH {MANIFEST_SQL} SELECT lane, permission, unnest(['unknown_lane', 'unknown_permission', 'hash_form', 'negative_count', 'loss_over_tokens', 'loss_where_none_is_allowed']) AS violation, 1::BIGINT AS shards FROM mf""",
)
def l9_manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each manifest row as it is, which breaks no rule, and in six altered forms, which break one each: by the shard that was altered."""
    m = stored(k9_manifest(spark, sf_dir), "manifest")  # a row a shard
    lanes = tuple(r.lane for r in m.select("lane").distinct().collect())
    own = m.withColumns({"was_lane": F.col("lane"), "was": F.col("permission")})
    altered = [
        {"lane": F.lit("elsewhere")},
        {"permission": F.lit("perhaps"), "loss_tokens": F.lit(0).cast("long")},
        {"shard_hash": F.substring("shard_hash", 8, 64)},
        {"segments": F.lit(-1).cast("long")},
        {"loss_tokens": F.col("tokens") + 1, "permission": F.lit("train")},
        {"loss_tokens": F.lit(1).cast("long"), "permission": F.lit("never_train")},
    ]
    every = own
    for columns in altered:
        every = every.union(own.withColumns(columns).select(own.columns))
    broken = every.select("was_lane", "was", F.explode(shards.violations(every, lanes)).alias("violation"))
    return broken.groupBy(F.col("was_lane").alias("lane"), F.col("was").alias("permission"), "violation").agg(F.count("*").alias("shards"))


@register(
    "l10_offset_gaps",
    f"""WITH {BYTE_TOKENS_SQL}, p AS (SELECT lane, permission, record_id, token_offset + CASE WHEN record_id % 97 = 0 THEN 1 ELSE 0 END AS token_offset, token_count FROM ix),
    g AS (SELECT lane, permission, record_id, token_offset, lag(token_offset + token_count, 1, 0) OVER (PARTITION BY lane, permission ORDER BY token_offset, record_id) AS expected FROM p)
    SELECT lane, permission, record_id, token_offset, expected FROM g WHERE token_offset <> expected""",
)
def l10_offset_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verifier of an index in which some records were moved by one token: they and their successors are found."""
    moved = F.col("token_offset") + F.when(F.col("record_id") % 97 == 0, 1).otherwise(0)
    return shards.offset_gaps(k9_shard_index(spark, sf_dir).withColumn("token_offset", moved))


@register(
    "g11_shard_totals",
    f"WITH {BYTE_TOKENS_SQL} SELECT lane, permission, count(*)::BIGINT AS records, sum(token_count)::BIGINT AS tokens, sum(loss_count)::BIGINT AS loss_tokens FROM ix GROUP BY ALL",
)
def g11_shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k9_shard_index(spark, sf_dir).groupBy("lane", "permission").agg(F.count("*").alias("records"), F.sum("token_count").alias("tokens"), F.sum("loss_count").alias("loss_tokens"))


@register(
    "g14_fertility",
    rf"""WITH {BYTE_TOKENS_SQL} SELECT lane, sum(token_count)::DOUBLE / sum(length(text)) AS tokens_per_character, sum(token_count)::DOUBLE / sum(len(regexp_extract_all(text, '\S+'))) AS tokens_per_word FROM ix GROUP BY lane""",
)
def g14_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the byte tokenizer for each character and each word, by lane."""
    return fertility(byte_tokens(spark, sf_dir), spark, sf_dir)


@register("g14_fertility_learned")
def g14_fertility_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the learned vocabulary."""
    lanes = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("lane"))
    return fertility(encoded(spark, sf_dir).join(lanes, "doc_id").select("lane", F.col("doc_id").alias("record_id"), "tokens"), spark, sf_dir)


def fertility(tokens: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.length("text").alias("characters"), F.regexp_count("text", F.lit(r"(?U)\S+")).alias("words"))
    n = F.sum(F.size("tokens")).cast("double")
    return tokens.join(docs, "record_id").groupBy("lane").agg((n / F.sum("characters")).alias("tokens_per_character"), (n / F.sum("words")).alias("tokens_per_word"))


@register("k7_reasoning_loss")
def k7_reasoning_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of question and answer pairs, only the answer bears loss."""
    from millrace.plans.text_queries import p4_reasoning_text

    text = p4_reasoning_text(spark, sf_dir).select("conv_id", "text", F.lit("reasoning").alias("kind"), F.lit("train").alias("permission"))
    df = tokenizer.encode(text, tokenizer.vocabulary(table(spark, sf_dir, "documents"), BYTES), "conv_id")
    return df.select("conv_id", F.size("tokens").alias("tokens"), F.aggregate("loss", F.lit(0), lambda a, x: a + x).alias("loss_tokens"), "loss_policy", "lossless")


@register(
    "k10_clip_to_loss",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents), m AS (SELECT doc_id, [CASE WHEN length(x) > 3 THEN 1 ELSE 0 END FOR x IN w] AS m FROM w),
    k AS (SELECT doc_id, m, list_sum(m) AS total, (list_sum(m) + 1) // 2 AS k FROM m WHERE list_sum(m) > 0),
    p AS (SELECT doc_id, k, total, len(m) AS n, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS x FROM k),
    s AS (SELECT doc_id, k, total, n, i, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM p)
    SELECT doc_id, k::BIGINT AS loss, (CASE WHEN k = any_value(total) THEN any_value(n) ELSE min(i) FILTER (s = k) END)::BIGINT AS clipped FROM s GROUP BY doc_id, k""",
)
def k10_clip_to_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest prefix with half of a record's loss; words stand for tokens."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)).alias("w"))
    df = df.withColumn("m", F.transform("w", lambda x: (F.length(x) > 3).cast("int"))).withColumn("total", F.aggregate("m", F.lit(0), lambda a, x: a + x))
    df = df.where("total > 0").withColumn("k", F.floor((F.col("total") + 1) / 2).cast("int"))
    _, loss = tokenizer.clip_to_loss(F.col("w"), F.col("m"), F.col("k"))
    return df.select("doc_id", F.col("k").cast("long").alias("loss"), F.size(loss).cast("long").alias("clipped"))
