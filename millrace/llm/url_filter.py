"""URL filters: fixed host and path rules, and a path-template tree for the urls that no rule fits.

The pages that a rule fits are labelled by it. Per host, paths become templates: segments with a digit, and segments
that are rare under their parent both in this host and over all hosts, are wildcards. Every prefix of a template is a
node of its host's tree and of the tree of all hosts, with the labelled pages below it. A node whose allowed share
doesn't differ from its parent's by more than chance is merged into the parent; siblings that differ to the same side and
not from each other are merged into one branch. From the root down to the whole template, however deep, a branch's share
is smoothed towards that of the branch above by `strength` assumed pages; a host's branch starts from the branch of all
hosts where that one stands out, else from its own parent. A template is rejected if its smoothed allowed share is under
one half.

Paths are summed by host and shape before anything else, so a host with a third of all pages costs one row a shape and
task. Segments are generalised level by level, as deep as `support` pages share a path; below that all are wildcards at
once. No table goes to the driver. Scores meet the pages by (host, shape), where a hot key is split by the planner; the
other joins are between tables of shapes and nodes.

Defined cases: a null url or one without `://` has empty host and path and no rule; a url that ends behind its host has
an empty path, which no rule fits; repeated rows and a null page_id are judged like any; with no labelled page all
templates get 0.5 and are allowed; an empty table gives an empty result; other columns are carried along, and the
operator's own begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import stored

#: (verdict, host, path): fits the host and its subdomains if the path starts with the rule's; the longest fitting rule wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.expr("substring({u}, locate('://', {u}) + 3)".replace("{u}", "coalesce(url, '')"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with _host, _path, _rule and _by_rule (its verdict), both null where none fits."""
    host, path = host_and_path(F.col("url"))
    df = pages.withColumn("_host", host).withColumn("_path", path)
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is tried first
        fits = ((F.col("_host") == h) | F.col("_host").endswith("." + h)) & F.col("_path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return df.withColumn("_rule", rule).withColumn("_by_rule", verdict)


def templates(labelled: DataFrame, support: int = 8, share: float = 0.02) -> DataFrame:
    """(_host, _shape, _template, a, m): the template of each host's shape, with its allowed and its labelled pages."""
    t = labelled.groupBy("_host", "_shape").agg(F.count("*").alias("n"), F.sum((F.col("_by_rule") == "allow").cast("long")).alias("a"), F.count("_by_rule").alias("m"))
    t = t.withColumns({"a": F.coalesce("a", F.lit(0)), "left": F.split(F.regexp_replace("_shape", "^/", ""), "/"), "prefix": F.lit("")})
    t = t.withColumn("left", F.when(F.col("_shape") == "", F.array().cast("array<string>")).otherwise(F.col("left")))
    t, done, depth = stored(t, "shapes"), None, 0
    while True:  # from the root down: rare segments become wildcards, so their branches meet
        seg = F.get("left", F.lit(depth))
        by_seg = t.where(seg.isNotNull()).withColumn("seg", seg).groupBy("_host", "prefix", "seg").agg(F.sum("n").alias("seg_n"))
        by_prefix = by_seg.groupBy("_host", "prefix").agg(F.sum("seg_n").alias("prefix_n"))
        anywhere = by_seg.groupBy("prefix", "seg").agg(F.sum("seg_n").alias("any_n"))
        of_all = by_seg.groupBy("prefix").agg(F.sum("seg_n").alias("all_n"))
        common = lambda n, of: (F.col(n) >= support) & (F.col(n) >= share * F.col(of))
        kept = by_seg.join(by_prefix, ["_host", "prefix"]).join(anywhere, ["prefix", "seg"]).join(of_all, "prefix")
        kept = kept.withColumn("kept", common("seg_n", "prefix_n") | common("any_n", "all_n")).select("_host", "prefix", "seg", "kept", (F.col("all_n") >= support).alias("goes_on"))
        rows = t.withColumn("seg", seg).join(kept, ["_host", "prefix", "seg"], "left")
        # under fewer pages than `support` no segment is common, there and below
        end = F.col("seg").isNull() | ~F.col("goes_on")
        rest = F.concat("prefix", F.repeat(F.lit("/*"), F.size("left") - depth))
        below = F.concat("prefix", F.lit("/"), F.when(F.col("kept"), F.col("seg")).otherwise("*"))
        rows = rows.withColumn("end", end).withColumn("prefix", F.when(end, rest).otherwise(below)).drop("kept", "seg", "goes_on")
        rows = stored(rows, "shapes")
        ended = rows.where("end").select("_host", "_shape", F.col("prefix").alias("_template"), "a", "m")
        done = ended if done is None else done.union(ended)
        t, depth = rows.where("not end").drop("end"), depth + 1
        if t.isEmpty():
            return done


def branches(nodes: DataFrame, keys: list[str], z: float) -> DataFrame:
    """nodes (keys, prefix, parent, a, m) with side (0: merged into the parent) and the counts of the branch, similar siblings merged."""
    above = nodes.select(*keys, F.col("prefix").alias("parent"), F.col("a").alias("a_up"), F.col("m").alias("m_up"))
    df = nodes.join(above, [*keys, "parent"], "left")  # a root has no parent and keeps its own counts

    def differs(a: str, m: str, share: Column) -> Column:
        return F.abs(F.col(a) - F.col(m) * share) > z * F.sqrt(F.col(m) * share * (1 - share))

    up = F.col("a_up") / F.greatest("m_up", F.lit(1))
    side = F.when((F.col("m") > 0) & differs("a", "m", up), F.signum(F.col("a") - F.col("m") * up)).otherwise(0)
    df = df.withColumn("side", F.when(F.col("m_up").isNull(), F.lit(1)).otherwise(side).cast("int"))
    pooled = df.where("side <> 0 and m_up is not null").groupBy(*keys, "parent", "side").agg(F.sum("a").alias("a_all"), F.sum("m").alias("m_all"))
    df = df.join(pooled, [*keys, "parent", "side"], "left")
    alike = F.col("m_all").isNotNull() & ~differs("a", "m", F.col("a_all") / F.greatest("m_all", F.lit(1)))
    return df.select(*keys, "prefix", "side", F.when(alike, F.col("a_all")).otherwise(F.col("a")).alias("a"), F.when(alike, F.col("m_all")).otherwise(F.col("m")).alias("m"))


def template_scores(labelled: DataFrame, support: int = 8, share: float = 0.02, strength: float = 4.0, z: float = 2.0) -> DataFrame:
    """(_host, _shape, _template, _score) from pages with _host, _shape and _by_rule; the score is the smoothed allowed share."""
    t = stored(templates(labelled, support, share), "templates")
    by = t.groupBy("_host", "_template").agg(F.sum("a").alias("a"), F.sum("m").alias("m"))
    # the prefixes of a template: what ends before each slash, and the whole
    parts = F.split("_template", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    paths = stored(by.select("_host", "_template", "a", "m", F.posexplode(steps).alias("d", "prefix")).withColumn("parent", F.when(F.col("d") > 0, F.regexp_replace("prefix", "/[^/]*$", ""))), "paths")
    counts = [F.sum("a").alias("a"), F.sum("m").alias("m")]
    in_host = branches(paths.groupBy("_host", "prefix", "parent").agg(*counts), ["_host"], z)
    in_all = branches(paths.groupBy("prefix", "parent").agg(*counts), [], z)
    both = paths.join(in_host.withColumnsRenamed({"side": "hs", "a": "ha", "m": "hm"}).select("_host", "prefix", "hs", "ha", "hm"), ["_host", "prefix"])
    both = both.join(in_all.withColumnsRenamed({"side": "fs", "a": "fa", "m": "fm"}).select("prefix", "fs", "fa", "fm"), "prefix")
    chain = both.groupBy("_host", "_template").agg(F.sort_array(F.collect_list(F.struct("d", "hs", "ha", "hm", "fs", "fa", "fm"))).alias("nodes"))
    smoothed = lambda a, m, up: (a + strength * up) / (m + strength)

    def step(state: Column, x: Column) -> Column:
        free = F.when(x.fs == 0, state.free).otherwise(smoothed(x.fa, x.fm, state.free))
        start = F.when(x.fs == 0, state.host).otherwise(free)
        return F.struct(free.alias("free"), F.when(x.hs == 0, start).otherwise(smoothed(x.ha, x.hm, start)).alias("host"))

    begin = F.struct(F.lit(0.5).cast("double").alias("free"), F.lit(0.5).cast("double").alias("host"))
    scores = chain.select("_host", "_template", F.aggregate("nodes", begin, step)["host"].alias("_score"))
    return t.select("_host", "_shape", "_template").join(scores, ["_host", "_template"])


def judge(pages: DataFrame, rules=RULES, **options) -> DataFrame:
    """pages (url, any others) with _host, _path, _rule, _verdict, _template and _score."""
    df = with_rule(pages, rules).withColumn("_shape", F.regexp_replace(F.regexp_replace("_path", r"(?<=/)[^/]*[0-9][^/]*", "*"), "/+$", ""))
    scores = template_scores(df.select("_host", "_shape", "_by_rule"), **options)
    df = df.join(scores, ["_host", "_shape"])
    by_score = F.when(F.col("_score") < 0.5, "block").otherwise("allow")
    return df.withColumn("_verdict", F.coalesce("_by_rule", by_score)).select(*pages.columns, "_host", "_path", "_rule", "_verdict", "_template", "_score")


def report(pages: DataFrame) -> DataFrame:
    df = judge(pages.select("page_id", "url"))
    return df.select("page_id", *[F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict", "template", "score")])
