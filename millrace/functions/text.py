"""Text as Columns: normalization, words, lines, paragraphs and n-grams.

Arrays that lambdas read are put in columns of their own and used twice or more, so the planner computes them once.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tags of chat formats that are no text, and what a word or a line end is.
GHOST_TAGS = (
    r"\[(?:user|assistant|system|human|bot)\]",
    r"<\|(?:endoftext|end_of_text|eot_id|im_start|im_end)\|>",
    r"</?(?:s|bos|eos)>",
    r"###\s*instruction\s*:",
)
WORD = r"[\p{L}\p{N}_]+"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SPACE = r"(?U)\s"
#: What `normalize` does, as data: part of the hash of every policy that builds on it.
NORMALIZATION = {
    "unescape_html": True,
    "unicode_form": "NFC",
    "dropped": ["U+FEFF", "U+200B", "U+FFFD", "U+202A-U+202E", "controls but tab, line feed and carriage return"],
    "kept": ["U+200C", "U+200D"],
    "ghost_tags": len(GHOST_TAGS),
    "blank_lines": 1,
}


@F.pandas_udf(StringType())
def unescape_nfc(text: pd.Series) -> pd.Series:
    """HTML entities to characters, in Unicode's composed form; null to ''. Neither exists as a built-in."""
    return text.map(lambda t: "" if t is None else unicodedata.normalize("NFC", html.unescape(t)))


def clean_characters(text: Column) -> Column:
    """Without byte order marks, zero-width spaces, replacement characters, bidi marks, controls and ghost tags;
    runs of horizontal space as one, lines stripped, at most one blank line. Joiners stay."""
    x = F.regexp_replace(text, r"[\uFEFF\u200B\uFFFD\u202A-\u202E\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")
    x = F.regexp_replace(x, "\r", "\n")
    x = F.regexp_replace(x, "(?i)" + "|".join(f"(?:{t})" for t in GHOST_TAGS), " ")
    x = F.regexp_replace(x, r"(?U)[^\S\r\n]+", " ")
    x = F.regexp_replace(x, r"(?U) *(?:[\n\x85\u2028\u2029]) *", "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def normalize(text: Column) -> Column:
    return clean_characters(unescape_nfc(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def casefold(text: Column) -> Column:
    """Lower case with sharp s unfolded."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(casefold(text), F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """All lines; a line end at the end makes no further line."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def firewall_tokens(text: Column) -> Column:
    """Casefolded words of letters, marks, digits and joiners; other characters vanish."""
    kept = F.regexp_replace(casefold(text), r"(?U)[^\p{L}\p{M}\p{N}\u200C\u200D\s]", "")
    return F.filter(F.split(kept, SPACE + "+"), lambda w: w != "")


def with_ngrams(df: DataFrame, tokens: str, n: int, out: str) -> DataFrame:
    """A row for each n-gram of the array column `tokens`, as a string joined by spaces."""
    places = f"if(size({tokens}) >= {n}, sequence(1, size({tokens}) - {n - 1}), array())"
    return df.withColumn("_i", F.explode(F.expr(places))).withColumn(out, F.expr(f"array_join(slice({tokens}, _i, {n}), ' ')")).drop("_i")


def strip_wikitables(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _clean, _removed_lines, _removed_characters and _removed_blocks: table blocks and stray table lines cut out.

    A block runs from a line that begins with `{|` to the next that begins with `|}`, or to the end.
    """
    df = df.withColumn("_lines", lines(F.coalesce(F.col(text), F.lit(""))))
    stray = r"(?iU)^(?:\\|[-+}]?|!)(?:\\s|$|.*(?:colspan|rowspan|align|bgcolor|valign)\\s*=)"
    step = f"""aggregate(_lines, named_struct('open', false, 'kept', cast(array() as array<string>), 'n', 0L, 'c', 0L, 'b', 0L), (a, x) ->
      case when _trim(x) like '{{|%' then named_struct('open', true, 'kept', a.kept, 'n', a.n + 1, 'c', a.c + length(x), 'b', a.b + 1)
           when a.open then named_struct('open', not _trim(x) like '|}}%', 'kept', a.kept, 'n', a.n + 1, 'c', a.c + length(x), 'b', a.b)
           when _trim(x) rlike '{stray}' then named_struct('open', false, 'kept', a.kept, 'n', a.n + 1, 'c', a.c + length(x), 'b', a.b)
           else named_struct('open', false, 'kept', concat(a.kept, array(x)), 'n', a.n, 'c', a.c, 'b', a.b) end)""".replace("_trim(x)", r"regexp_replace(x, '(?U)^\\s+|\\s+$', '')")
    # only texts with a line that may be removed take the fold
    marked = F.exists("_lines", lambda x: x.rlike(r"(?U)^\s*(?:[|!]|\{\|)"))
    df = df.withColumn("_fold", F.when(marked, F.expr(step)))
    kept = F.when(marked, F.array_join("_fold.kept", "\n")).otherwise(F.array_join("_lines", "\n"))
    zero = lambda f: F.coalesce(F.col(f"_fold.{f}"), F.lit(0)).cast("long")
    df = df.withColumns({"_clean": strip(F.regexp_replace(kept, r"\n{3,}", "\n\n")), "_removed_lines": zero("n"), "_removed_characters": zero("c"), "_removed_blocks": zero("b")})
    return df.drop("_lines", "_fold")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, side: int = 100) -> Column:
    """A short text as it is, of a longer one head and tail; white space collapsed."""
    t = collapsed(text)
    return F.when(F.length(t) <= 2 * side, t).otherwise(F.concat(F.substring(t, 1, side), F.lit(" … "), F.right(t, F.lit(side))))


def marker_contexts(df: DataFrame, marker: str, most: int = 3, around: int = 180, text: str = "text") -> DataFrame:
    """df with _contexts: what stands around the first `most` places of a marker, white space collapsed."""
    import re

    n = len(marker)
    df = df.withColumn("_parts", F.split(F.coalesce(F.col(text), F.lit("")), re.escape(marker), most + 1))
    places = f"if(size(_parts) > 1, transform(sequence(1, size(_parts) - 1), k -> aggregate(slice(_parts, 1, k), 0, (a, x) -> a + length(x)) + {n} * (k - 1) + 1), array())"
    df = df.withColumn("_at", F.expr(places))
    cut = f"transform(_at, a -> trim(regexp_replace(substring({text}, greatest(1, a - {around}), a + {around + n} - greatest(1, a - {around})), '(?U)\\\\s+', ' ')))"
    return df.withColumn("_contexts", F.expr(cut)).drop("_parts", "_at")
