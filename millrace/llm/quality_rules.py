"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The votes of all documents are counted by pattern;
a rule votes one way only, so there are at most 2 ** 10 patterns, whatever the size of the corpus. Expectation-maximisation over that table
estimates the share of good documents and, of each rule, how often it votes on good and on bad ones, which gives its accuracy: how often it is
right when it votes. A document's posterior probability of being good is then a sum of log-odds of its votes and abstentions, and decides in
place of all-must-pass rules. Nothing is clipped: the start counts as PRIOR documents, and the data decide the rest.

The columns `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words` and `base_failed` are exact.
Repeated 3-word windows are found inside a row (windows hashed to 64 bits, sorted with their places), so nothing is
exploded or shuffled and a long text is one array.

Defined cases: null or empty text has no words and fails the base rules; repeated rows are judged alike; an empty
table gives an empty result; other columns are carried along, and the operator's own begin with an underscore.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
#: Of each rule: its vote, and the SQL of when it votes; otherwise it abstains.
RULES = {
    "prose": (1, "100 * _n_symbols <= 5 * _n_words and 100 * _n_exclaim <= 5 * _n_words and 100 * _n_upper <= 20 * _word_chars and 100 * _n_ends between 2 * _n_words and 50 * _n_words"),
    "varied": (1, "_n_words >= 50 and 100 * _n_repeat_words <= 5 * _n_words and _n_dup_lines = 0 and 100 * _n_symbols <= 5 * _n_words"),
    "short": (-1, "_n_words < 50"),
    "word_length": (-1, "_word_chars < 2 * _n_words or _word_chars > 14 * _n_words"),
    "symbols": (-1, "100 * _n_symbols > 15 * _n_words"),
    "shouting": (-1, "100 * _n_upper > 35 * _word_chars"),
    "exclaiming": (-1, "100 * _n_exclaim > 20 * _n_words"),
    "repeated_words": (-1, "100 * _n_repeat_words > 40 * _n_words"),
    "repeated_lines": (-1, "100 * _n_dup_lines > 40 * _n_lines"),
    "no_sentences": (-1, "100 * _n_ends < 1 * _n_words"),
}
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def signals(docs: DataFrame) -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words and what the rules need besides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_t", text)
    df = df.withColumn("_w", F.regexp_extract_all("_t", F.lit(f"{WORD}+"), F.lit(0)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    # _w stands in two expressions, so it's computed once and never again inside a lambda
    df = df.withColumn("_n_words", F.size("_w").cast("long")).withColumn("_word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("_h", F.expr("if(size(_w) >= 3, transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])), array())"))
    df = df.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (x, i) -> struct(x as x, i as i))), array())"))
    again = "filter(_s, (e, i) -> (i > 0 and _s[i - 1].x = e.x) or (i + 1 < size(_s) and _s[i + 1].x = e.x))"
    df = df.withColumn("_p", F.expr(f"sort_array(transform({again}, e -> e.i))"))
    covered = "aggregate(_p, named_struct('n', 0L, 'e', 0), (a, x) -> named_struct('n', a.n + (x + 3 - greatest(a.e, x)), 'e', x + 3), a -> a.n)"
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    df = df.withColumns(
        {
            "_n_repeat_words": F.expr(covered),
            "_n_lines": F.size("_l").cast("long"),
            "_n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_n_symbols": count(r"[#*$%&|<>]"),
            "_n_upper": count(r"\p{Lu}"),
            "_n_exclaim": count(r"!"),
            "_n_ends": count(r"[.!?](?=[\x20\x09-\x0D]|$)"),
        }
    )
    return df.drop("_t", "_w", "_l", "_h", "_s", "_p")


def base_failed() -> Column:
    return (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


def with_votes(df: DataFrame) -> DataFrame:
    """df of signals() with a column _vote_<rule> of 1, -1 or 0 for each rule."""
    return df.withColumns({f"_vote_{k}": F.expr(f"case when {when} then {vote} else 0 end") for k, (vote, when) in RULES.items()})


#: Where estimation starts, as of this many documents: the share of good ones, and how often a rule votes on documents of its kind and of the other.
PRIOR, SHARE, RIGHT, WRONG = 10.0, 0.5, {1: 0.6, -1: 0.2}, 0.1


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[float], list[float]]:
    """The share of good documents and, of each rule, how often it votes on good and on bad ones, by expectation-maximisation.

    patterns: (votes, number of documents).
    """
    kinds = [vote for vote, _ in RULES.values()]
    begin_good = [RIGHT[k] if k > 0 else WRONG for k in kinds]
    begin_bad = [RIGHT[k] if k < 0 else WRONG for k in kinds]
    share, on_good, on_bad = SHARE, begin_good, begin_bad
    for _ in range(rounds):
        good = total = 0.0
        by_rule = [[0.0, 0.0] for _ in kinds]
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-log_odds(share, on_good, on_bad, votes)))
            good, total = good + n * p, total + n
            for r, v in enumerate(votes):
                if v:
                    by_rule[r][0] += n * p
                    by_rule[r][1] += n * (1 - p)
        last = share
        share = (PRIOR * SHARE + good) / (PRIOR + total)
        on_good = [(PRIOR * b + x) / (PRIOR + good) for b, (x, _) in zip(begin_good, by_rule, strict=True)]
        on_bad = [(PRIOR * b + y) / (PRIOR + total - good) for b, (_, y) in zip(begin_bad, by_rule, strict=True)]
        if abs(share - last) < 1e-12:
            break
    return share, on_good, on_bad


def accuracies(share: float, on_good: list[float], on_bad: list[float]) -> list[float]:
    """Of each rule, how often it's right when it votes."""
    of_good = [share * g / (share * g + (1 - share) * b) for g, b in zip(on_good, on_bad, strict=True)]
    return [p if vote > 0 else 1 - p for p, (vote, _) in zip(of_good, RULES.values(), strict=True)]


def _odds(on_good: list[float], on_bad: list[float]) -> list[tuple[float, float]]:
    """Of each rule, the log-odds of a document's being good that its vote and its abstention add."""
    return [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in zip(on_good, on_bad, strict=True)]


def log_odds(share: float, on_good: list[float], on_bad: list[float], votes: tuple[int, ...]) -> float:
    """Of a document's being good. Kept within 50 either way, beyond which no probability differs from 0 or 1."""
    total = math.log(share / (1 - share)) + sum(voted if v else silent for v, (voted, silent) in zip(votes, _odds(on_good, on_bad), strict=True))
    return max(-50.0, min(50.0, total))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns `keep` of it) with signals, votes, _posterior (the probability that it's good), _base_failed and _kept."""
    names = [f"_vote_{k}" for k in RULES]
    df = stored(with_votes(signals(docs)).select(*(keep if keep is not None else docs.columns), *names, *[f"_{c}" for c in SIGNALS]), "signals")
    patterns = [(tuple(r[:-1]), r[-1]) for r in df.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    share, on_good, on_bad = estimate(sorted(patterns))
    total = F.lit(math.log(share / (1 - share)))
    for name, (voted, silent) in zip(names, _odds(on_good, on_bad), strict=True):
        total = total + F.when(F.col(name) != 0, voted).otherwise(silent)
    df = df.withColumn("_posterior", 1 / (1 + F.exp(-total))).withColumn("_base_failed", base_failed())
    return df.withColumn("_kept", ~F.col("_base_failed") & (F.col("_posterior") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs).where("_kept").select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return judge(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", *[F.col(f"_{c}").alias(c) for c in own])
