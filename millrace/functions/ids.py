"""Content-based identities, hash ranks and hash splits. Nothing is drawn at random: every choice is a function of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTITION_SEED = "millrace-partition-v1"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def record_id(source: Column, upstream: Column, text: Column) -> Column:
    return F.concat(F.lit("rec_"), F.substring(sha256(F.concat_ws(":", source, upstream, sha256(text))), 1, 24))


def chunk_id(source: Column, parent: Column, index: Column, text: Column, policy_hash: Column) -> Column:
    return F.concat(F.lit("rec_"), F.substring(sha256(F.concat_ws(":", source, parent, index.cast("string"), sha256(text), policy_hash)), 1, 24))


def group_id(upstream: Column) -> Column:
    return F.concat(F.lit("grp_"), F.substring(sha256(upstream), 1, 20))


def hash_rank(*parts: Column | str) -> Column:
    """A sortable rank: the hex of a hash of the parts, joined by bars."""
    return sha256(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def threshold(share: str) -> str:
    """The 16 hex digits under which the first 64 bits of a hash lie with this share."""
    from decimal import Decimal

    return f"{min(int(Decimal(share) * 2**64), 2**64 - 1):016x}"


def permission(group: Column, seed: str = PARTITION_SEED, validation: str = "0.10", anneal: str = "0.02") -> Column:
    """train, anneal or validation, by the group's hash. Hex digits compare like the unsigned numbers that they stand for."""
    from decimal import Decimal

    h = F.substring(hash_rank(seed, group), 1, 16)
    both = str(Decimal(validation) + Decimal(anneal))
    return F.when(h < threshold(validation), "validation").when(h < threshold(both), "anneal").otherwise("train")


def unsigned(hex16: Column) -> Column:
    """16 hex digits as an exact unsigned number."""
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def weighted_priority(seed_and_parts: Column, weight_micros: Column) -> tuple[Column, Column]:
    """High and low half of (first 128 bits of the hash * 10^6) // weight; ascending order of both is the order of selection."""
    h = sha256(seed_and_parts)
    wide = lambda c: c.cast("decimal(38,0)")
    base, w = F.lit("18446744073709551616").cast("decimal(38,0)"), wide(weight_micros)
    high = wide(wide(unsigned(F.substring(h, 1, 16))) * F.lit(1_000_000))
    low = wide(wide(unsigned(F.substring(h, 17, 16))) * F.lit(1_000_000))
    rest = wide(high % w)
    total = wide(wide(rest * base) + low)
    quotient_high = wide(wide(high - rest) / w)
    quotient_low = wide(wide(total - wide(total % w)) / w)
    carry = wide(wide(quotient_low - wide(quotient_low % base)) / base)
    return wide(quotient_high + carry), wide(quotient_low % base)
