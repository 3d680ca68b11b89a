"""Normalization, masking, quality flags and bands, chunking: literal cases."""

import html
import re
import unicodedata

from pyspark.sql import functions as F

from millrace.functions import ids, pii, quality, text
from millrace.operators import chunking


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


def reference_normalize(t):
    """The rules of text.normalize, character by character."""
    t = unicodedata.normalize("NFC", html.unescape(t or ""))
    t = "".join("\n" if c == "\r" else c for c in t if not (c in "\ufeff\u200b\ufffd" or "\u202a" <= c <= "\u202e" or ((ord(c) < 32 or 127 <= ord(c) <= 159) and c not in "\n\r\t")))
    t = re.sub("(?i)" + "|".join(text.GHOST_TAGS), " ", t)
    t = re.sub(r"[^\S\r\n]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in t.splitlines())).strip()


def test_normalize(spark):
    cases = ["क्\u200dष A&amp;B", "a\r\n\r\n\r\nb", "x <|endoftext|> y [USER] z", "é \ufeff\u200b\x07 c", " a \t b \n\n\n\n c ", "### Instruction : do", None, "", "a\u2028b", "nbsp 　x"]
    for case in cases:
        assert one(spark, case, text.normalize(F.col("text"))) == reference_normalize(case), case


def scrubbed(spark, value, policy):
    return pii.scrub(spark.createDataFrame([(value,)], "text string"), policy).first()


def test_masking(spark):
    r = scrubbed(spark, "Mail a.b@c.org, call 9876543210, api_key=abcdef1234567890 at 10.0.0.1", "plain")
    assert r.scrubbed == "Mail [EMAIL], call [PHONE], [SECRET] at [IP]"
    assert (r.email_count, r.phone_count, r.secret_count, r.ipv4_count) == (1, 1, 1, 1)
    assert scrubbed(spark, "ISBN 9780306406157 and 10.0.0.1", "structured_numeric").scrubbed == "ISBN 9780306406157 and 10.0.0.1"
    r = scrubbed(spark, "OEIS 123456789; phone: 555-123-4567 or +91 98765 43210", "public_reference")
    assert r.scrubbed == "OEIS 123456789; phone: [PHONE] or [PHONE]" and r.phone_count == 2
    r = scrubbed(spark, "मोबाइल नंबर: 9876543210, bank account number: 123456789012", "public_reference_v2")
    assert r.scrubbed == "मोबाइल नंबर: [PHONE], bank account number: [BANK_ACCOUNT]" and r.financial_account_count == 1
    assert scrubbed(spark, None, "general").scrubbed == ""


def test_wikitables(spark):
    rows = [("before\n{| class=x\n| cell\n|}\n| align=left stray\n! head\nafter",), ("{| open\nnever closed",), ("plain\n\n\n\ntext",), (None,)]
    got = [tuple(r) for r in text.strip_wikitables(spark.createDataFrame(rows, "text string")).select("_clean", "_removed_lines", "_removed_blocks").collect()]
    assert got == [("before\nafter", 5, 1), ("", 2, 1), ("plain\n\ntext", 0, 0), ("", 0, 0)]


def test_flags_and_bands(spark):
    long = "\n\n".join(" ".join(f"w{chr(97 + (i * 31 + j * j) % 26)}{chr(97 + (i * 7 + j) % 26)}{chr(97 + j % 26)}ord" for j in range(40)) + "." for i in range(20))
    rows = [("Short one.",), ("X may refer to: one. " + "words of many kinds here. " * 20,), (long,), ("same line\n" * 80,)]
    df = quality.with_signals(spark.createDataFrame(rows, "text string"))
    df = quality.with_band(df.withColumn("flags", quality.flags_v1()), groups=quality.CAP_GROUPS_V1)
    got = [(r.flags, r.band, r.sampling_weight) for r in df.select("flags", "band", "sampling_weight").collect()]
    assert got[0][0][0] == "short_document" and got[0][1:] == ("B0", 0.25)
    assert "disambiguation_page" in got[1][0] and got[2][1:] == ("B4", 1.25)
    assert {"duplicate_lines", "repetitive_language"} <= set(got[3][0])


def test_chunks():
    body = "\n\n".join(" ".join(f"Sentence {i} {j} ends here." for j in range(8)) for i in range(8))
    for version in (1, 2):
        found = chunking.chunks("A title", body, 220, 60, version)
        assert len(found) > 4 and all(len(t) <= 220 and t.startswith("A title\n\n") for t, _ in found)
        words = [w for t, _ in found for w in t.removeprefix("A title\n\n").split()]
        assert words == body.split()
    taxa = "\n".join(f"Genus species{i} var. minor Author, 19{i:02d}" for i in range(20))
    assert {b for _, b in chunking.chunks("T", taxa, 220, 50)} == {"line"}
    t = "Seen by Dr. Who. J. Doe left. End"
    assert [t[a:b] for a, b in chunking.sentences(t, 0, len(t), True)] == ["Seen by Dr. Who.", "J. Doe left.", "End"]
    assert [b for _, b in chunking.chunks("", "x" * 450, 200, 10)] == ["character", "character", "paragraph"] and chunking.chunks("", " ", 200) == []


def test_hash_split_and_priority(spark):
    import hashlib

    df = spark.range(3000).select("id", ids.permission(F.col("id")).alias("p"), *[c.alias(n) for n, c in zip("hl", ids.weighted_priority(F.concat(F.lit("s|"), F.col("id").cast("string")), F.col("id") * 397 + 1), strict=True)])
    for r in df.collect():
        x = int.from_bytes(hashlib.sha256(f"millrace-partition-v1|{r.id}".encode()).digest()[:8], "big")
        assert r.p == ("validation" if x < int(0.1 * 2**64) else "anneal" if x * 100 < 12 * 2**64 else "train")
        q = int.from_bytes(hashlib.sha256(f"s|{r.id}".encode()).digest()[:16], "big") * 10**6 // (r.id * 397 + 1)
        assert (int(r.h), int(r.l)) == divmod(q, 2**64)
