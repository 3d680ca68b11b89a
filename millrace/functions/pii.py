"""Masking of personal data by ordered patterns, with counts taken on the progressively masked text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns, in Java's syntax; W is a word character (letters, digits, underscore; no marks).
W = r"[\p{L}\p{N}_]"
EMAIL = r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+(?![\p{L}\p{N}_.+-])"
OCTET = r"(?:25[0-5]|2[0-4]\p{Nd}|1\p{Nd}{2}|[1-9]?\p{Nd})"
IPV4 = rf"(?<![\p{{Nd}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{Nd}}.])"
PHONE = rf"(?U)(?<!{W})(?:\+?\p{{Nd}}{{1,3}}[-.\s]?)?(?:\(?\p{{Nd}}{{2,5}}\)?[-.\s]?)?\p{{Nd}}{{6,10}}(?!{W})"
SECRET = r"(?i)(?:(?:api|access|secret)[_-]?key|token|password)(?U:\s*)[:=](?U:\s*)['\"]?[A-Za-z0-9_./+=-]{12,}"
LABELLED_PHONE = rf"(?iU)((?<!{W})(?:phone|telephone|tel|mobile|contact|call|fax)(?!{W})\s*[:#-]?\s*)(\+?\p{{Nd}}[\p{{Nd}}().\s-]{{5,}}\p{{Nd}})"
INTERNATIONAL_PHONE = rf"(?U)(?<!{W})\+\p{{Nd}}{{1,3}}(?:[\s.-]+\(?\p{{Nd}}{{2,5}}\)?){{2,}}(?!{W})"
HINDI_PHONE = (
    r"(?iU)((?:फोन|फ़ोन|मोबाइल|संपर्क|कॉल|फैक्स|टेलीफोन|दूरभाष|व्हाट्सऐप|वॉट्सऐप)\s*(?:नंबर|नम्बर|संख्या)?\s*[:#-]?\s*)"
    r"\(?\s*(\+?\p{Nd}[\p{Nd}().\s-]{5,}\p{Nd})\s*\)?"
)
ACCOUNT = (
    r"(?iU)((?:(?:bank\s+)?account|acct)\s*(?:number|no\.?|#)|(?:बैंक\s+)?(?:अकाउंट|खाता)\s*(?:नंबर|नम्बर|संख्या))"
    r"(\s*[:#-]?\s*)(\p{Nd}{8,20})"
)

EMAIL_STEP = ("email", EMAIL, "[EMAIL]")
SECRET_STEP = ("secret", SECRET, "[SECRET]")
IPV4_STEP = ("ipv4", IPV4, "[IP]")
PHONE_STEP = ("phone", PHONE, "[PHONE]")
LABELLED_STEP = ("phone", LABELLED_PHONE, "$1[PHONE]")
HINDI_STEP = ("phone", HINDI_PHONE, "$1[PHONE]")
INTERNATIONAL_STEP = ("phone", INTERNATIONAL_PHONE, "[PHONE]")
ACCOUNT_STEP = ("financial_account", ACCOUNT, "$1$2[BANK_ACCOUNT]")

#: The steps of a source class, in order; "general" is any class without a name here, "plain" the order for unknown sources.
POLICIES = {
    "plain": (EMAIL_STEP, IPV4_STEP, PHONE_STEP, SECRET_STEP),
    "general": (EMAIL_STEP, SECRET_STEP, IPV4_STEP, PHONE_STEP),
    "structured_numeric": (EMAIL_STEP, SECRET_STEP),
    "public_reference": (EMAIL_STEP, SECRET_STEP, LABELLED_STEP, INTERNATIONAL_STEP),
    "public_reference_v2": (EMAIL_STEP, SECRET_STEP, LABELLED_STEP, HINDI_STEP, INTERNATIONAL_STEP, ACCOUNT_STEP),
}


def scrub(df: DataFrame, policy: str = "plain", text: str = "text", out: str = "scrubbed") -> DataFrame:
    """df with the masked text `out` and a count `<kind>_count` of each of the policy's kinds."""
    value, counts = F.coalesce(F.col(text), F.lit("")), {}
    df = df.withColumn("_s0", value)
    steps = POLICIES.get(policy, POLICIES["general"])
    for i, (kind, pattern, mask) in enumerate(steps):
        df = df.withColumn(f"_n{i}", F.regexp_count(F.col(f"_s{i}"), F.lit(pattern)))  # a column, so that it's counted once
        found = F.col(f"_n{i}")
        counts[kind] = counts[kind] + found if kind in counts else found
        df = df.withColumn(f"_s{i + 1}", F.when(found > 0, F.regexp_replace(F.col(f"_s{i}"), pattern, mask)).otherwise(F.col(f"_s{i}")))
    df = df.withColumn(out, F.col(f"_s{len(steps)}")).withColumns({f"{k}_count": c.cast("long") for k, c in counts.items()})
    return df.drop(*[f"_{x}{i}" for i in range(len(steps) + 1) for x in "sn"])
