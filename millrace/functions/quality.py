"""Quality signals of a text, flags from thresholds that are data, and bands with sampling weights."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from millrace.functions.text import lines, strip, strip_wikitables, words

# Patterns and thresholds of the signals and flags.
LIST_LINE = r"^(?U)\s*(?:[-*•]|\p{Nd}+[.)])\s+"
SENTENCE = r"(?U)[.!?]+(?:\s|$)"
URL = r"(?i)https?://|www\."
WIKITABLE_LINE = r"(?iU)^\s*(?:\{\||\|[-+}]?|![^!]*(?:!!|\|)|\|.*(?:bgcolor|rowspan|colspan|valign|align)\s*=)"
WIKITABLE_ATTRIBUTE = r"(?iU)(?<![\p{L}\p{N}_])(?:bgcolor|rowspan|colspan|valign)\s*="
RULES_V2 = {
    "raw_wikitable_markup": {"lines": 3, "fraction": 0.05},
    "orphaned_table_footnotes": {"list": 0.40, "duplicate": 0.20, "trigram": 0.35, "lines": 40},
    "linewise_list": {"lines": 12, "short": 0.85, "ratio": 4.0},
    "category_tail": {"lines": 4, "short": 0.75},
}
STAT_HEAVY = {"alpha": 0.45, "digit": 0.15, "short": 0.90, "lines": 8}
BANDS = (("B0", 0.25), ("B1", 0.50), ("B2", 1.00), ("B3", 1.15), ("B4", 1.25))


STATISTICS = StructType([StructField("entropy", DoubleType()), StructField("run", IntegerType())])


@F.pandas_udf(STATISTICS)
def character_statistics(text: pd.Series) -> pd.DataFrame:
    """Shannon entropy of characters in bits, and the longest run of one character."""
    entropy, run = np.zeros(len(text)), np.zeros(len(text), np.int32)
    for i, t in enumerate(text):
        if t:
            points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            n = np.bincount(points) if points.max() < 1024 else np.unique(points, return_counts=True)[1]
            p = n[n > 0] / len(points)
            entropy[i] = -(p * np.log2(p)).sum()
            edge = np.flatnonzero(points[1:] != points[:-1])
            run[i] = np.diff(edge, prepend=-1, append=len(points) - 1).max()
    return pd.DataFrame({"entropy": entropy, "run": run})


@F.pandas_udf(LongType())
def compressed_size(text: pd.Series) -> pd.Series:
    """Bytes of the text compressed by zlib at level 9."""
    return text.map(lambda t: len(zlib.compress(t.encode(), 9)) if t else 0)


def fraction(n: Column, of: Column) -> Column:
    return n.cast("double") / F.greatest(F.lit(1), of).cast("double")


def with_signals(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the signals as columns; the structural ones of version 2 included."""
    t = F.col("_t")
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_w", words(t)).withColumn("_all_lines", lines(t))
    df = df.withColumn("_l", F.filter(F.transform("_all_lines", strip), lambda x: x != ""))
    df = df.withColumn("_stats", character_statistics(t)).withColumn("_zip", compressed_size(t))  # each is run only where its column is read
    df = df.withColumn("_tri", F.expr("if(size(_w) >= 3, transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])), array())"))
    df = df.withColumn("_body", F.expr("if(size(_l) > 1, slice(_l, 2, size(_l) - 1), array())"))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    n, n_lines = F.length(t), F.size("_l")
    table_lines = F.size(F.filter("_body", lambda x: x.rlike(WIKITABLE_LINE) | x.rlike(WIKITABLE_ATTRIBUTE)))
    ends = F.substring(F.regexp_replace(t, r"(?U)\s+$", ""), -1, 1)
    df = df.withColumns(
        {
            "characters": n.cast("long"),
            "utf8_bytes": F.octet_length(t).cast("long"),
            "words": F.size("_w").cast("long"),
            "unique_word_fraction": fraction(F.size(F.array_distinct("_w")), F.size("_w")),
            "lines": F.when(t == "", 0).otherwise(F.size("_all_lines")).cast("long"),
            "nonempty_lines": n_lines.cast("long"),
            "paragraphs": F.size(F.filter(F.split(t, r"(?U)\n\s*\n"), lambda x: strip(x) != "")).cast("long"),
            "sentences": count(SENTENCE).cast("long"),
            "alpha_fraction": fraction(count(r"[\p{L}\p{M}]"), n),
            "digit_fraction": fraction(count(r"\p{N}"), n),
            "punctuation_fraction": fraction(count(r"\p{P}"), n),
            "whitespace_fraction": fraction(count(r"(?U)\s"), n),
            "non_ascii_fraction": fraction(count(r"[^\x00-\x7F]"), n),
            "list_line_fraction": fraction(F.size(F.filter("_l", lambda x: x.rlike(LIST_LINE))), n_lines),
            "duplicate_line_fraction": fraction(n_lines - F.size(F.array_distinct("_l")), n_lines),
            "repeated_trigram_fraction": F.when(F.size("_tri") > 0, 1 - fraction(F.size(F.array_distinct("_tri")), F.size("_tri"))).otherwise(0.0),
            "compression_ratio": fraction(F.col("_zip"), F.octet_length(t)),
            "character_entropy_bits": F.col("_stats.entropy"),
            "max_same_character_run": F.col("_stats.run"),
            "url_count": count(URL).cast("long"),
            "ends_at_boundary": (t == "") | ends.isin(*".!?:;\"')]}"),
            "looks_like_disambiguation": F.contains(F.lower(F.substring(t, 1, 600)), F.lit("may refer to:")),
            "short_line_fraction": fraction(F.size(F.filter("_body", lambda x: F.length(x) <= 160)), F.size("_body")),
            "wikitable_markup_lines": table_lines.cast("long"),
            "wikitable_markup_line_fraction": fraction(table_lines, F.size("_body")),
        }
    )
    df = df.withColumn("line_structure_ratio", fraction(F.col("nonempty_lines"), F.col("paragraphs")))
    return df.drop("_t", "_w", "_all_lines", "_l", "_stats", "_zip", "_tri", "_body")


SIGNALS = (
    "characters utf8_bytes words unique_word_fraction lines nonempty_lines paragraphs sentences alpha_fraction digit_fraction punctuation_fraction "
    "whitespace_fraction non_ascii_fraction list_line_fraction duplicate_line_fraction repeated_trigram_fraction compression_ratio character_entropy_bits "
    "max_same_character_run url_count ends_at_boundary looks_like_disambiguation short_line_fraction wikitable_markup_lines wikitable_markup_line_fraction "
    "line_structure_ratio"
).split()


def _flags(pairs: list[tuple[str, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.expr(when), F.lit(name)) for name, when in pairs]))


FLAGS = [
    ("short_document", "characters < 400"),
    ("low_language_content", "alpha_fraction < 0.45D"),
    ("list_dominant", "list_line_fraction > 0.50D"),
    ("duplicate_lines", "duplicate_line_fraction > 0.20D"),
    ("repetitive_language", "repeated_trigram_fraction > 0.35D"),
    ("low_character_entropy", "character_entropy_bits < 3.0D"),
    ("long_character_run", "max_same_character_run > 20"),
    ("disambiguation_page", "looks_like_disambiguation"),
]


def flags_v1(truncated: str = "false", redactions: str = "0") -> Column:
    """The flags of signal columns, in a fixed order."""
    more = [("character_truncated", truncated), ("truncated_mid_boundary", f"{truncated} and not ends_at_boundary"), ("pii_pattern_redacted", f"{redactions} > 0")]
    return _flags(FLAGS + more)


def flags_v2(short_continuation: str = "false", redactions: str = "0", table_removed: str = "false", rules: dict | None = None, stat: dict | None = None) -> Column:
    """Version 2: structural flags besides, sorted; a short continuation is no short document."""
    r = RULES_V2 | (rules or {})
    wiki, orphan, linewise, tail = (r[k] for k in ("raw_wikitable_markup", "orphaned_table_footnotes", "linewise_list", "category_tail"))
    pairs = [(k, f"({w}) and not {short_continuation}" if k == "short_document" else w) for k, w in FLAGS]
    pairs += [
        ("pii_pattern_redacted", f"{redactions} > 0"),
        ("short_continuation_chunk", short_continuation),
        ("raw_wikitable_markup", f"wikitable_markup_lines >= {wiki['lines']} and wikitable_markup_line_fraction >= {wiki['fraction']}D"),
        ("orphaned_table_footnotes", f"list_line_fraction >= {orphan['list']}D and duplicate_line_fraction >= {orphan['duplicate']}D and repeated_trigram_fraction >= {orphan['trigram']}D and nonempty_lines <= {orphan['lines']}"),
        ("linewise_list", f"nonempty_lines >= {linewise['lines']} and short_line_fraction >= {linewise['short']}D and line_structure_ratio >= {linewise['ratio']}D"),
        ("category_tail", f"{short_continuation} and nonempty_lines >= {tail['lines']} and short_line_fraction >= {tail['short']}D"),
        ("table_markup_removed", table_removed),
    ]
    if stat:
        pairs.append(("stat_heavy_list", f"alpha_fraction < {stat['alpha']}D and digit_fraction >= {stat['digit']}D and short_line_fraction >= {stat['short']}D and nonempty_lines >= {stat['lines']}"))
    return F.array_sort(F.array_distinct(_flags(pairs)))


CAP_GROUPS_V1 = [
    ("general_short", ("short_document",)),
    ("general_disambiguation", ("disambiguation_page",)),
    ("general_structured_low_prose", ("list_dominant", "duplicate_lines", "repetitive_language")),
]
CAP_GROUPS_V2 = CAP_GROUPS_V1 + [
    ("general_linewise_list", ("linewise_list",)),
    ("general_category_tail", ("category_tail",)),
    ("general_sensitive_context_review", ("human_sensitive_context_reviewed",)),
    ("general_stat_heavy_list", ("stat_heavy_list",)),
    ("general_table_salvage", ("table_markup_removed",)),
]
WARNINGS = ("low_language_content", "low_character_entropy", "long_character_run", "short_continuation_chunk")


def with_band(df: DataFrame, flags: str = "flags", groups=None) -> DataFrame:
    """df with cap_groups, band and sampling_weight, from flags and the signals characters and paragraphs."""
    has = lambda names: F.arrays_overlap(F.col(flags), F.array(*[F.lit(x) for x in names]))
    caps = F.array_compact(F.array(*[F.when(has(names), F.lit(g)) for g, names in (groups or CAP_GROUPS_V2)]))
    df = df.withColumn("cap_groups", caps)
    band = F.when(F.size("cap_groups") > 0, "B0").when(has(WARNINGS), "B1").when(F.expr("characters >= 4000 and paragraphs >= 8"), "B4")
    df = df.withColumn("band", band.when(F.expr("characters >= 1200 and paragraphs >= 4"), "B3").otherwise("B2"))
    weight = F.create_map(*[F.lit(x) for pair in BANDS for x in pair])
    return df.withColumn("sampling_weight", weight[F.col("band")])


# The Unicode blocks of scripts, as classes of letters.
SCRIPTS = {
    "latin": "[A-Za-zÀ-ÖØ-öø-ɏ]",
    "devanagari": r"[\u0900-\u097F&&\p{L}]",
    "bengali": r"[\u0980-\u09FF&&\p{L}]",
    "gurmukhi": r"[\u0A00-\u0A7F&&\p{L}]",
    "gujarati": r"[\u0A80-\u0AFF&&\p{L}]",
    "oriya": r"[\u0B00-\u0B7F&&\p{L}]",
    "tamil": r"[\u0B80-\u0BFF&&\p{L}]",
    "telugu": r"[\u0C00-\u0C7F&&\p{L}]",
    "kannada": r"[\u0C80-\u0CFF&&\p{L}]",
    "malayalam": r"[\u0D00-\u0D7F&&\p{L}]",
    "arabic": r"[\u0600-\u06FF&&\p{L}]",
}


def script_fraction(text: Column, script: str) -> Column:
    """The share of a text's letters that are of a script."""
    return fraction(F.regexp_count(text, F.lit(SCRIPTS[script])), F.regexp_count(text, F.lit(r"\p{L}")))


def gates_around_cleanup(df: DataFrame, least: int = 300, text: str = "text") -> DataFrame:
    """df with cleaned (tables cut out) and reason: the first gate that fails, length being judged before and after the cleanup; or pass."""
    df = strip_wikitables(df, text)
    t = F.coalesce(F.col(text), F.lit(""))
    reason = F.when(F.length(t) < least, "too_short_before_cleanup").when(F.length("_clean") < least, "too_short_after_cleanup")
    reason = reason.when(~F.col("_clean").rlike(r"[\p{L}\p{N}]"), "no_language_content")
    reason = reason.when(fraction(F.regexp_count("_clean", F.lit("�")), F.length("_clean")) > 0.001, "replacement_character_rate")
    return df.withColumn("reason", reason.otherwise("pass")).withColumnRenamed("_clean", "cleaned").drop("_removed_lines", "_removed_characters", "_removed_blocks")
