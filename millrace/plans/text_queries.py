"""Queries of the row transforms: normalization, masking, quality signals, flags, bands and admission filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import pii, quality, text
from millrace.plans.catalog import register, table

# DuckDB: lines, words and trigrams of each document, then the signals.
SIGNALS_SQL = r"""
WITH a AS (
  SELECT doc_id, text AS t, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS w,
         regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E]') AS ls0, string_split(text, '') AS cs FROM documents),
b AS (SELECT *, CASE WHEN ls0[-1] = '' THEN ls0[1:-2] ELSE ls0 END AS ls,
             [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS tri,
             [i FOR i IN range(1, len(cs) + 2) IF i = 1 OR i = len(cs) + 1 OR cs[i] <> cs[i - 1]] AS edge FROM a),
c AS (SELECT *, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN ls] IF x <> ''] AS l FROM b),
d AS (SELECT *, CASE WHEN len(l) > 1 THEN l[2:] ELSE [] END AS body FROM c),
s AS (SELECT doc_id, length(t)::BIGINT AS characters, strlen(t)::BIGINT AS utf8_bytes, len(w)::BIGINT AS words,
  len(list_distinct(w))::DOUBLE / greatest(1, len(w)) AS unique_word_fraction,
  CASE WHEN t = '' THEN 0 ELSE len(ls) END::BIGINT AS lines, len(l)::BIGINT AS nonempty_lines,
  len([x FOR x IN regexp_split_to_array(t, '\n\s*\n') IF regexp_matches(x, '\S')])::BIGINT AS paragraphs,
  len(regexp_extract_all(t, '[.!?]+(?:\s|$)'))::BIGINT AS sentences,
  len(regexp_extract_all(t, '[\p{L}\p{M}]'))::DOUBLE / greatest(1, length(t)) AS alpha_fraction,
  len(regexp_extract_all(t, '\p{N}'))::DOUBLE / greatest(1, length(t)) AS digit_fraction,
  len(regexp_extract_all(t, '\p{P}'))::DOUBLE / greatest(1, length(t)) AS punctuation_fraction,
  len(regexp_extract_all(t, '\s'))::DOUBLE / greatest(1, length(t)) AS whitespace_fraction,
  len(regexp_extract_all(t, '[^\x00-\x7F]'))::DOUBLE / greatest(1, length(t)) AS non_ascii_fraction,
  len([x FOR x IN l IF regexp_matches(x, '^\s*(?:[-*•]|\p{Nd}+[.)])\s+')])::DOUBLE / greatest(1, len(l)) AS list_line_fraction,
  (len(l) - len(list_distinct(l)))::DOUBLE / greatest(1, len(l)) AS duplicate_line_fraction,
  CASE WHEN len(tri) > 0 THEN 1 - len(list_distinct(tri))::DOUBLE / len(tri) ELSE 0 END AS repeated_trigram_fraction,
  round(coalesce(list_aggregate(cs, 'entropy'), 0), 9) AS character_entropy_bits,
  coalesce(list_max([edge[i + 1] - edge[i] FOR i IN range(1, len(edge))]), 0)::INTEGER AS max_same_character_run,
  len(regexp_extract_all(t, '(?i)https?://|www\.'))::BIGINT AS url_count,
  t = '' OR regexp_matches(t, '[.!?:;"'')\]}]\s*$') AS ends_at_boundary,
  contains(lower(t[1:600]), 'may refer to:') AS looks_like_disambiguation,
  len([x FOR x IN body IF length(x) <= 160])::DOUBLE / greatest(1, len(body)) AS short_line_fraction,
  len([x FOR x IN body IF regexp_matches(x, '(?i)^\s*(?:\{\||\|[-+}]?|![^!]*(?:!!|\|)|\|.*(?:bgcolor|rowspan|colspan|valign|align)\s*=)')
                          OR regexp_matches(x, '(?i)(?:^|[^\p{L}\p{N}_])(?:bgcolor|rowspan|colspan|valign)\s*=')])::BIGINT AS wikitable_markup_lines,
  len(body) AS n_body FROM d),
sig AS (SELECT * EXCLUDE (n_body), wikitable_markup_lines::DOUBLE / greatest(1, n_body) AS wikitable_markup_line_fraction,
               nonempty_lines::DOUBLE / greatest(1, paragraphs) AS line_structure_ratio FROM s)
"""

FLAG_SQL = r"""
  CASE WHEN characters < 400 AND NOT {short} THEN 'short_document' END, CASE WHEN alpha_fraction < 0.45 THEN 'low_language_content' END,
  CASE WHEN list_line_fraction > 0.5 THEN 'list_dominant' END, CASE WHEN duplicate_line_fraction > 0.2 THEN 'duplicate_lines' END,
  CASE WHEN repeated_trigram_fraction > 0.35 THEN 'repetitive_language' END, CASE WHEN character_entropy_bits < 3 THEN 'low_character_entropy' END,
  CASE WHEN max_same_character_run > 20 THEN 'long_character_run' END, CASE WHEN looks_like_disambiguation THEN 'disambiguation_page' END
"""
BAND_SQL = r"""
banded AS (SELECT *, CASE WHEN {caps} THEN 'B0'
  WHEN list_has_any(flags, ['low_language_content', 'low_character_entropy', 'long_character_run', 'short_continuation_chunk']) THEN 'B1'
  WHEN characters >= 4000 AND paragraphs >= 8 THEN 'B4' WHEN characters >= 1200 AND paragraphs >= 4 THEN 'B3' ELSE 'B2' END AS band FROM flagged)
SELECT doc_id, array_to_string(flags, ',') AS flags, band,
  CASE band WHEN 'B0' THEN 0.25 WHEN 'B1' THEN 0.5 WHEN 'B2' THEN 1.0 WHEN 'B3' THEN 1.15 ELSE 1.25 END::DOUBLE AS sampling_weight FROM banded
"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.with_signals(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.withColumn("character_entropy_bits", F.round("character_entropy_bits", 9))


@register("q_quality_signals", SIGNALS_SQL + "SELECT * FROM sig")
def q_quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).drop("text", "compression_ratio")


@register("q10_compression_ratio")
def q10_compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).select("doc_id", "compression_ratio")


@register(
    "q17_q19_flags_bands_v1",
    SIGNALS_SQL
    + ", flagged AS (SELECT *, [x FOR x IN ["
    + FLAG_SQL.format(short="false")
    + "] IF x IS NOT NULL] AS flags FROM sig), "
    + BAND_SQL.format(caps="list_has_any(flags, ['short_document', 'disambiguation_page', 'list_dominant', 'duplicate_lines', 'repetitive_language'])"),
)
def q17_q19_flags_bands_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.with_band(signals(spark, sf_dir).withColumn("flags", quality.flags_v1()), groups=quality.CAP_GROUPS_V1)
    return df.select("doc_id", F.array_join("flags", ",").alias("flags"), "band", "sampling_weight")


@register(
    "q18_q20_flags_bands_v2",
    SIGNALS_SQL
    + ", flagged AS (SELECT *, list_sort([x FOR x IN ["
    + FLAG_SQL.format(short="doc_id % 7 = 0")
    + r""", CASE WHEN doc_id % 7 = 0 THEN 'short_continuation_chunk' END,
  CASE WHEN wikitable_markup_lines >= 3 AND wikitable_markup_line_fraction >= 0.05 THEN 'raw_wikitable_markup' END,
  CASE WHEN list_line_fraction >= 0.4 AND duplicate_line_fraction >= 0.2 AND repeated_trigram_fraction >= 0.35 AND nonempty_lines <= 40 THEN 'orphaned_table_footnotes' END,
  CASE WHEN nonempty_lines >= 12 AND short_line_fraction >= 0.85 AND line_structure_ratio >= 4 THEN 'linewise_list' END,
  CASE WHEN doc_id % 7 = 0 AND nonempty_lines >= 4 AND short_line_fraction >= 0.75 THEN 'category_tail' END,
  CASE WHEN alpha_fraction < 0.45 AND digit_fraction >= 0.15 AND short_line_fraction >= 0.9 AND nonempty_lines >= 8 THEN 'stat_heavy_list' END] IF x IS NOT NULL]) AS flags FROM sig), """
    + BAND_SQL.format(caps="list_has_any(flags, ['short_document', 'disambiguation_page', 'list_dominant', 'duplicate_lines', 'repetitive_language', 'linewise_list', 'category_tail', 'stat_heavy_list', 'table_markup_removed'])"),
)
def q18_q20_flags_bands_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document stands for a short continuation chunk, so that those rules are met too."""
    df = signals(spark, sf_dir).withColumn("flags", quality.flags_v2(short_continuation="doc_id % 7 = 0", stat=quality.STAT_HEAVY))
    df = quality.with_band(df)
    return df.select("doc_id", F.array_join("flags", ",").alias("flags"), "band", "sampling_weight")


@register(
    "n1_normalize",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(array_to_string([trim(x, ' ') FOR x IN string_split(
      regexp_replace(regexp_replace(text, '(?i)\[(?:user|assistant|system|human|bot)\]|<\|(?:endoftext|end_of_text|eot_id|im_start|im_end)\|>|</?(?:s|bos|eos)>|###\s*instruction\s*:', ' ', 'g'),
      '[ \t]+', ' ', 'g'), chr(10))], chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS normalized_sha256 FROM documents""",
)
def n1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(text.normalize(F.col("text")).cast("binary"), 256).alias("normalized_sha256"))


@register("n1_normalize_pages")
def n1_normalize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalize(F.col("html")).alias("normalized"))


@register("n3_scrub_pii")
def n3_scrub_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pii.scrub(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "email_count", "ipv4_count", "phone_count", "secret_count", F.sha2(F.col("scrubbed").cast("binary"), 256).alias("scrubbed_sha256"))


@register("n4_scrub_structured_numeric")
def n4_scrub_structured_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pii.scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), "structured_numeric")
    return df.select("doc_id", "email_count", "secret_count", F.sha2(F.col("scrubbed").cast("binary"), 256).alias("scrubbed_sha256"))


@register("n4_scrub_public_reference")
def n4_scrub_public_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions of the policy; the second also counts bank accounts and labels in Hindi."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    one = pii.scrub(docs, "public_reference").select("doc_id", F.col("phone_count").alias("phones_v1"), F.col("scrubbed").alias("text_v1"), "text")
    two = pii.scrub(one, "public_reference_v2")
    return two.select("doc_id", "phones_v1", F.col("phone_count").alias("phones_v2"), "financial_account_count", "email_count", "secret_count", (F.col("text_v1") == F.col("scrubbed")).alias("same_text"))


@register("n4_scrub_general")
def n4_scrub_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pii.scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), "general")
    return df.select("doc_id", "email_count", "ipv4_count", "phone_count", "secret_count")


@register(
    "n3_secret_counts",
    r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:(?:api|access|secret)[_-]?key|token|password)\s*[:=]\s*[''"]?[A-Za-z0-9_./+=-]{12,}'))::BIGINT AS secret_count FROM documents""",
)
def n3_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(pii.SECRET)).cast("long").alias("secret_count"))


@register("n6_strip_wikitables")
def n6_strip_wikitables(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = text.strip_wikitables(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.selectExpr("doc_id", "length(_clean) AS characters", "_removed_lines AS removed_lines", "_removed_characters AS removed_characters", "_removed_blocks AS removed_blocks")


@register(
    "n7_n8_language_content",
    r"""SELECT doc_id, regexp_matches(text, '[\p{L}\p{N}]') AS has_language_content,
      len(regexp_extract_all(text, chr(65533)))::DOUBLE / greatest(1, length(text)) AS replacement_rate FROM documents""",
)
def n7_n8_language_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rate = quality.fraction(F.regexp_count(t, F.lit("�")), F.length(t))
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike(r"[\p{L}\p{N}]").alias("has_language_content"), rate.alias("replacement_rate"))


@register(
    "f1_basic_quality",
    r"""WITH r AS (SELECT doc_id, length(text)::BIGINT AS characters, len(regexp_extract_all(text, '\S+'))::BIGINT AS words,
      [x FOR x IN [CASE WHEN length(text) < 80 THEN 'too_short' END, CASE WHEN length(text) > 24000 THEN 'too_long' END,
        CASE WHEN NOT regexp_matches(text, '[\p{L}\p{N}]') THEN 'no_language_content' END,
        CASE WHEN len(regexp_extract_all(text, chr(65533))) / greatest(1, length(text)) > 0.001 THEN 'replacement_character_rate' END] IF x IS NOT NULL] AS reasons FROM documents)
    SELECT doc_id, characters, words, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS admitted FROM r""",
)
def f1_basic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = F.col("text"), F.length("text")
    reasons = F.array_compact(
        F.array(
            F.when(n < 80, "too_short"),
            F.when(n > 24_000, "too_long"),
            F.when(~t.rlike(r"[\p{L}\p{N}]"), "no_language_content"),
            F.when(quality.fraction(F.regexp_count(t, F.lit("�")), n) > 0.001, "replacement_character_rate"),
        )
    )
    df = table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("characters"), F.regexp_count(t, F.lit(r"(?U)\S+")).cast("long").alias("words"), reasons.alias("r"))
    return df.select("doc_id", "characters", "words", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("admitted"))


@register(
    "f2_f3_parent_gates",
    r"""WITH p AS (SELECT doc_id, coalesce(source, '') || chr(10) || chr(10) || text AS body FROM documents),
    g AS (SELECT doc_id, CASE WHEN length(body) < 300 THEN 'too_short' WHEN NOT regexp_matches(body, '[\p{L}\p{N}]') THEN 'no_language_content'
      WHEN len(regexp_extract_all(body, chr(65533))) / length(body) > 0.001 THEN 'replacement_character_rate' ELSE 'pass' END AS reason FROM p)
    SELECT reason, count(*)::BIGINT AS parents FROM g GROUP BY reason""",
)
def f2_f3_parent_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing gate of title and body together, counted."""
    body = F.concat(F.coalesce("source", F.lit("")), F.lit("\n\n"), F.col("text"))
    df = table(spark, sf_dir, "documents").select(body.alias("body"))
    bad = quality.fraction(F.regexp_count("body", F.lit("�")), F.length("body")) > 0.001
    reason = F.when(F.length("body") < 300, "too_short").when(~F.col("body").rlike(r"[\p{L}\p{N}]"), "no_language_content").when(bad, "replacement_character_rate").otherwise("pass")
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("parents"))


@register(
    "f3_gates_around_table_cleanup",
    r"""WITH p AS (SELECT doc_id, source || chr(10) || chr(10) || text AS body FROM documents),
    c AS (SELECT doc_id, body, regexp_replace(body, '(?m)^[ \t]*[|!].*$', '', 'g') AS kept FROM p)
    SELECT doc_id, CASE WHEN length(body) < 300 THEN 'too_short_before_cleanup' WHEN NOT regexp_matches(body, '[\p{L}\p{N}]') THEN 'no_language_content'
      WHEN len(regexp_extract_all(body, chr(65533))) / length(body) > 0.001 THEN 'replacement_character_rate' ELSE 'pass' END AS reason FROM c""",
)
def f3_gates_around_table_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length is judged before and after tables are cut out, with reasons of their own (the local texts hold no tables; a unit test has some)."""
    body = F.concat("source", F.lit("\n\n"), F.col("text"))
    return quality.gates_around_cleanup(table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))).select("doc_id", "reason")


@register(
    "f10_script_fraction",
    r"""WITH t AS (SELECT doc_id, s.script, CASE s.script WHEN 'latin' THEN len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ɏ]')) WHEN 'devanagari' THEN len([x FOR x IN regexp_extract_all(text, '[\x{0900}-\x{097F}]') IF regexp_matches(x, '\p{L}')])
      ELSE len([x FOR x IN regexp_extract_all(text, '[\x{0B80}-\x{0BFF}]') IF regexp_matches(x, '\p{L}')]) END AS own, len(regexp_extract_all(text, '\p{L}')) AS letters FROM documents, (VALUES ('latin'), ('devanagari'), ('tamil')) s(script))
    SELECT doc_id, script, own::DOUBLE / greatest(1, letters) AS script_fraction, own::DOUBLE / greatest(1, letters) >= 0.5 AS passes FROM t""",
)
def f10_script_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of letters that are of a script, for three of the scripts that are known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("script"), quality.script_fraction(F.col("text"), k).alias("script_fraction")) for k in ("latin", "devanagari", "tamil")])).alias("x"))
    return rows.select("doc_id", "x.script", "x.script_fraction", (F.col("x.script_fraction") >= 0.5).alias("passes"))


@register(
    "f11_repeated_output",
    r"""WITH a AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' +', ' ', 'g'), ' ') AS w FROM documents),
    b AS (SELECT *, [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] AS tri FROM a)
    SELECT doc_id, len(w) >= 9 AND 1 - len(list_distinct(tri))::DOUBLE / greatest(1, len(tri)) > 0.3 AS repeated FROM b""",
)
def f11_repeated_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)).alias("w"))
    df = df.withColumn("tri", F.expr("if(size(w) >= 3, transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])), array())"))
    share = 1 - quality.fraction(F.size(F.array_distinct("tri")), F.size("tri"))
    return df.select("doc_id", ((F.size("w") >= 9) & (share > 0.3)).alias("repeated"))


REVISIONS_SQL = "r AS (SELECT page_id, unnest(['main', 'refs/heads/dev', sha1(url), substr(sha1(url), 1, 39), upper(sha1(url)), sha256(url), url]) AS revision FROM pages)"


@register("f12_revision_predicates", f"WITH {REVISIONS_SQL} SELECT page_id, revision, regexp_matches(revision, '^[0-9a-f]{{40,64}}$') AS immutable, revision IN ('main', 'master', 'HEAD', 'latest') OR revision LIKE 'refs/heads/%' AS mutable FROM r")
def f12_revision_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of branches and hashes of 40 to 64 hex digits, over revisions of every form for each page."""
    from millrace.sources.revisions import is_immutable, is_mutable

    url = F.col("url").cast("binary")
    forms = F.array(F.lit("main"), F.lit("refs/heads/dev"), F.sha1(url), F.substring(F.sha1(url), 1, 39), F.upper(F.sha1(url)), F.sha2(url, 256), F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(forms).alias("revision"))
    return rows.select("page_id", "revision", is_immutable(F.col("revision")).alias("immutable"), is_mutable(F.col("revision")).alias("mutable"))


@register(
    "f8_f9_pair_filters",
    r"""WITH p AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS src, max(CASE WHEN role = 'assistant' THEN text END) AS tgt FROM conversations GROUP BY conv_id)
    SELECT conv_id, length(src)::DOUBLE / length(tgt) AS ratio FROM p WHERE trim(src) <> '' AND trim(tgt) <> '' AND length(src)::DOUBLE / length(tgt) BETWEEN 0.3 AND 3.0""",
)
def f8_f9_pair_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with text on both sides and a length ratio of 0.30 to 3.00."""
    side = lambda role: F.max(F.when(F.col("role") == role, F.col("text")))
    p = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("user").alias("src"), side("assistant").alias("tgt"))
    p = p.where("trim(src) <> '' AND trim(tgt) <> ''").withColumn("ratio", F.length("src").cast("double") / F.length("tgt"))
    return p.where(F.col("ratio").between(0.3, 3.0)).select("conv_id", "ratio")


@register(
    "p1_p5_source_projections",
    r"""SELECT doc_id, sha256(trim(source) || chr(10) || chr(10) || text) AS titled_sha256, source || ':' || lang || ':' || doc_id AS upstream_id,
      sha256(source || ':' || doc_id || ':' || sha256(text)) AS key_sha256, 'rec_' || substr(sha256(source || ':' || doc_id || ':' || sha256(text)), 1, 24) AS record_id,
      'grp_' || substr(sha256(doc_id::VARCHAR), 1, 20) AS group_id, sha256(text) AS content_sha256 FROM documents""",
)
def p1_p5_source_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled text, joined upstream ids, and the content-based identity of a record."""
    from millrace.functions import ids

    df = table(spark, sf_dir, "documents")
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"), ids.sha256(F.col("text")))
    return df.select(
        "doc_id",
        ids.sha256(F.concat(F.trim("source"), F.lit("\n\n"), F.col("text"))).alias("titled_sha256"),
        F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string")).alias("upstream_id"),
        ids.sha256(key).alias("key_sha256"),
        ids.record_id(F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("record_id"),
        ids.group_id(F.col("doc_id").cast("string")).alias("group_id"),
        ids.sha256(F.col("text")).alias("content_sha256"),
    )


@register(
    "p6_conversation_text",
    r"""SELECT conv_id, string_agg('<' || CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END || '>' || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
)
def p6_conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their role as a tag, in order."""
    role = F.when(F.col("role") == "human", "user").when(F.col("role") == "gpt", "assistant").otherwise(F.col("role"))
    turn = F.struct("turn", F.concat(F.lit("<"), role, F.lit(">\n"), F.col("text")).alias("t"))
    df = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return df.select("conv_id", F.array_join("turns.t", "\n").alias("text"))


@register(
    "p4_reasoning_text",
    r"""WITH p AS (SELECT conv_id, arg_min(CASE WHEN role = 'user' THEN trim(text, E' \t\n\r') END, turn) AS q, arg_min(CASE WHEN role = 'assistant' THEN trim(text, E' \t\n\r') END, turn) AS a FROM conversations GROUP BY conv_id)
    SELECT conv_id, '<question>' || chr(10) || q || chr(10) || '<reasoning>' || chr(10) || a AS text, sha256(q) AS upstream_id FROM p WHERE q IS NOT NULL AND a IS NOT NULL""",
)
def p4_reasoning_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question and answer of each conversation in the form of a reasoning record, identified by the question's hash."""
    from millrace.functions.projections import reasoning

    side = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    pairs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(side("user").alias("question"), side("assistant").alias("answer")).where("question is not null and answer is not null")
    return pairs.select("conv_id", *reasoning(F.col("question"), F.col("answer")))


@register("p7_plain_projection", "SELECT doc_id::VARCHAR AS upstream_id, text, lang AS languages FROM documents")
def p7_plain_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and id as they are, with the columns that stay as metadata."""
    from millrace.functions.projections import plain

    return table(spark, sf_dir, "documents").select(*plain(F.col("text"), F.col("doc_id")), F.col("lang").alias("languages"))


LICENSE = r"(?i)(gnu general public license|apache license|mit license|cc by)"


@register(
    "p8_license_gate",
    r"""WITH l AS (SELECT doc_id, nullif(lower(regexp_extract(text, '(?i)(gnu general public license|apache license|mit license|cc by)', 1)), '') AS license FROM documents)
    SELECT doc_id, license FROM l WHERE license IN ('apache license', 'mit license')""",
)
def p8_license_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose license, the first that a text names, is on the allowed list."""
    from millrace.functions.projections import license_gate

    named = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.regexp_extract("text", LICENSE, 1), F.lit("")).alias("license"))
    return license_gate(named, "license", ["MIT License", "Apache License"]).select("doc_id", F.lower("license").alias("license"))


@register(
    "p10_latest_raw_row",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
)
def p10_latest_raw_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each upstream id, by ingest order."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("l")).select("user_id", "l.event_id", "l.event_type")


@register(
    "p11_previews",
    r"""WITH c AS (SELECT doc_id, text, string_split(text, 'the') AS parts, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    p AS (SELECT *, [list_sum([length(x) FOR x IN parts[1:k]])::BIGINT + 3 * (k - 1) + 1 FOR k IN range(1, least(3, len(parts) - 1) + 1)] AS places FROM c)
    SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE t[1:100] || ' … ' || t[-100:] END AS preview,
      array_to_string([trim(regexp_replace(text[greatest(1, a - 180):a + 182], '\s+', ' ', 'g')) FOR a IN places], chr(10)) AS marker_contexts FROM p""",
)
def p11_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and tail with white space collapsed, and the surroundings, collapsed too, of the first three places of a marker."""
    from millrace.functions.text import marker_contexts, preview

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return marker_contexts(docs, "the").select("doc_id", preview(F.col("text")).alias("preview"), F.array_join("_contexts", "\n").alias("marker_contexts"))


@register(
    "n9_adjudicated_replacement",
    r"""SELECT doc_id, (length(text) - length(replace(text, 'the ', ''))) // 4 AS occurrences, replace(text, 'the ', 'that ') AS text FROM documents WHERE doc_id IN (14, 22, 37)""",
)
def n9_adjudicated_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact replacements on reviewed records only, with the number of places for the reviewer's assertion."""
    reviewed = spark.createDataFrame([(14, "the ", "that "), (22, "the ", "that "), (37, "the ", "that ")], "doc_id long, old string, new string")
    df = table(spark, sf_dir, "documents").join(F.broadcast(reviewed), "doc_id")  # a reviewers' list
    n = ((F.length("text") - F.length(F.replace("text", "old", F.lit("")))) / F.length("old")).cast("long")
    return df.select("doc_id", n.alias("occurrences"), F.replace("text", "old", "new").alias("text"))
