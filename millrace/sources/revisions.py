"""Pinned revisions of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that move.
BRANCHES = ("main", "master", "HEAD", "latest")


def is_immutable(revision: Column) -> Column:
    """A full hash: 40 to 64 hex digits."""
    return revision.rlike("^[0-9a-f]{40,64}$")


def is_mutable(revision: Column) -> Column:
    return revision.isin(*BRANCHES) | revision.startswith("refs/heads/")


def revision_problems(targets: DataFrame, found: DataFrame) -> DataFrame:
    """(source_id, problem) of targets (source_id, dataset, revision) that aren't pinned, or aren't at the revision that their hub reports in
    found (dataset, sha). Local datasets have no hub."""
    remote = targets.where(~F.col("dataset").startswith("local/"))
    df = remote.join(found.select("dataset", "sha"), "dataset", "left")
    problem = F.when(~is_immutable(F.col("revision")), "not_pinned").when(F.col("sha").isNull(), "not_found").when(F.col("sha") != F.col("revision"), "other_revision")
    return df.select("source_id", problem.alias("problem")).where("problem is not null")


def verified(targets: DataFrame, found: DataFrame) -> DataFrame:
    """targets; an error if any has a revision problem."""
    bad = revision_problems(targets, found).orderBy("source_id").limit(5).collect()
    if bad:
        raise ValueError("revisions can't be verified: " + ", ".join(f"{r.source_id} ({r.problem})" for r in bad))
    return targets
