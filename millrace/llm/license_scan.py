"""License scans by diagonal voting.

Rolling word k-gram hashes of every text are joined to the places of the same k-grams in templates: whole license texts,
the standard notices of licenses, and sentences that grant one. A match at word p of the text and word q of a template
votes for the diagonal p - q. Votes are counted by (text, template, diagonal); neighbouring diagonals (an inserted or lost
word shifts the rest) are merged into one alignment; and an alignment is verified by the share of the template's words that
its matching k-grams cover, all of whose words have been compared byte for byte: 9 in 10 of a sentence's, 6 in 10 of a
longer text's. A template that holds a license's name counts only in texts that hold it too. Sentences with a name are also
aligned word by word around each place of that name, and may differ by one to three words (`edits_allowed`).

Before the join a scan drops the k-grams that no template has, and finds the base phrases, comparing their words. The
join's other side is the templates: a fixed table of some thousand k-grams.

Defined cases: null or empty text has no words, no labels and score 0; rows equal in doc_id and text get equal results;
a notice repeated in a text counts once for its label; an empty table gives an empty result; columns besides doc_id and
text aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.decontamination import WindowSet
from millrace.llm.license_texts import TEXTS
from millrace.llm.shared import release, stored
from millrace.llm.words import ALNUM_WORDS, Words, window_starts, windows

# Phrases that name a license, and notices that grant one, as lower-case words.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NOTICES = (
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "licensed under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "no part of this publication may be reproduced without permission all rights reserved"),
)
# Names that these notices can't do without, by notice; a name that AFTER goes on is another license's.
NAMES = ("gnu general public license", "gnu lesser general public license", "gnu affero general public license", "apache license", "mit license", "mozilla public license", "cc by nc", "cc by sa", "cc by", "creative commons attribution", "bsd")
AFTER = {b"nc", b"sa", b"nd", b"noncommercial", b"sharealike", b"noderivatives", b"noderivs"}
K = 3
LONG = 25  # words from which a template is a text, not a sentence
STATE = "doc_id long, h long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, named array<int>, near array<struct<label:string,coverage:double>>, grams array<struct<p:int,x:long>>"


def _words(text: str) -> str:
    """A template as its lower-case words."""
    words = Words(pa.array([text]), ALNUM_WORDS, True)
    return b" ".join(words.bytes_of(i) for i in range(len(words))).decode()


#: All templates: sentences, then texts.
TEMPLATES = (*NOTICES, *((label, _words(text)) for label, text in TEXTS))


def _grams(notice: str, k: int) -> np.ndarray:
    return windows(Words(pa.array([notice]), ALNUM_WORDS, True).hashes(), k).astype(np.int64)


def edits_allowed(size: int) -> int:
    """How many words of a notice of so many may be changed, lost or inserted."""
    return 1 if size < 8 else 2 if size < 15 else 3


def edits(notice: list[bytes], text: list[bytes]) -> int:
    """The least number of changed, lost or inserted words between a notice's words and the first words of a text, however many."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(notice, 1):
        above, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return min(row)


def named_templates() -> list[tuple[int, str, list[bytes], list[bytes], list[bytes]]]:
    """(template, label, words before its name, the name, words after it) of the templates that hold a name."""
    out = []
    for i, (label, text) in enumerate(TEMPLATES):
        name = next((x for x in NAMES if f" {x} " in f" {text} "), None)
        if name:
            before, after = f" {text} ".split(f" {name} ", 1)
            out.append((i, label, before.encode().split(), name.encode().split(), after.encode().split()))
    return out


def _scan(k: int):
    def scan(batches):
        held = WindowSet([(None, text) for _, text in TEMPLATES], k)
        phrases = [(len(p.split()), p.encode(), _grams(p, len(p.split()))[0].astype(np.uint64), label) for p, label in PHRASES]
        notices = [(*x, _grams(b" ".join(x[3]).decode(), len(x[3]))[0].astype(np.uint64)) for x in named_templates()]
        for whole in batches:
            step = max(1, int(whole.num_rows * (4 << 20) / max(1, whole.nbytes)))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                words = Words(batch["text"], ALNUM_WORDS, True)
                hashes, row, rows = words.hashes(), words.row(), batch.num_rows
                count, first, last = np.zeros(rows, np.int64), [None] * rows, [None] * rows
                labels: list[set] = [set() for _ in range(rows)]
                for n, text, key, label in phrases:
                    h = windows(hashes, n)
                    for i in np.flatnonzero((h == key) & window_starts(words.first, n)[: len(h)]).tolist():
                        if b" ".join([words.bytes_of(j) for j in range(i, i + n)]) == text:
                            r = int(row[i])
                            p = i - int(words.first[r])
                            count[r] += 1
                            first[r] = p if first[r] is None else min(first[r], p)
                            last[r] = p if last[r] is None else max(last[r], p)
                            labels[r].add(label)
                named: list[set] = [set() for _ in range(rows)]
                near: list[dict] = [{} for _ in range(rows)]
                for notice, label, before, name, after, key in notices:
                    n, size = len(name), len(before) + len(name) + len(after)
                    h, most = windows(hashes, n), edits_allowed(size)
                    for i in np.flatnonzero((h == key) & window_starts(words.first, n)[: len(h)]).tolist():
                        if [words.bytes_of(j) for j in range(i, i + n)] == name:
                            r = int(row[i])
                            named[r].add(notice)
                            if size >= LONG:
                                continue
                            left = [words.bytes_of(j) for j in range(i - 1, max(int(words.first[r]), i - len(before) - most) - 1, -1)]
                            right = [words.bytes_of(j) for j in range(i + n, min(int(words.first[r + 1]), i + n + len(after) + most))]
                            far = edits(before[::-1], left) + edits(after, right)
                            if far <= most and not (right and right[0] in AFTER):
                                near[r][label] = max(near[r].get(label, 0.0), 1 - far / size)
                grams: list[list] = [[] for _ in range(rows)]
                for i, x in zip(*held.places(words, k), strict=True):
                    r = int(row[i])
                    grams[r].append({"p": i - int(words.first[r]), "x": x})
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"],
                        "h": batch["h"],
                        "n_words": pa.array(words.count, pa.int64()),
                        "n_base": pa.array(count),
                        "first_word": pa.array(first, pa.int64()),
                        "last_word": pa.array(last, pa.int64()),
                        "base_labels": pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                        "named": pa.array([sorted(x) for x in named], pa.list_(pa.int32())),
                        "near": pa.array([[{"label": x, "coverage": c} for x, c in sorted(d.items())] for d in near], pa.list_(pa.struct([("label", pa.string()), ("coverage", pa.float64())]))),
                        "grams": pa.array(grams, pa.list_(pa.struct([("p", pa.int32()), ("x", pa.int64())]))),
                    }
                )
        release()

    return scan


def template_places(spark: SparkSession, k: int = K) -> DataFrame:
    """(notice, label, size, x, q): the k-grams x of the templates at word q."""
    rows = [(i, label, len(text.split()), int(x), q) for i, (label, text) in enumerate(TEMPLATES) for q, x in enumerate(_grams(text, k).tolist())]
    return spark.createDataFrame(rows, "notice int, label string, size int, x long, q int")


def spans(state: DataFrame, k: int = K, gap: int = 3, covered: float = 0.9, covered_long: float = 0.6) -> DataFrame:
    """(doc_id, h, label, first, last, coverage) of verified alignments, from the scan's grams."""
    spark = state.sparkSession
    hits = state.where("size(grams) > 0").select("doc_id", "h", "named", F.explode("grams").alias("m")).select("doc_id", "h", "named", "m.p", "m.x")
    votes = hits.join(F.broadcast(template_places(spark, k)), "x").withColumn("d", F.col("p") - F.col("q"))
    nameless = [i for i in range(len(TEMPLATES)) if i not in {x[0] for x in named_templates()}]
    votes = votes.where(F.col("notice").isin(nameless) | F.expr("array_contains(named, notice)"))
    lines = votes.groupBy("doc_id", "h", "notice", "label", "size", "d").agg(F.collect_set("q").alias("q"), F.min("p").alias("first"), F.max(F.col("p") + k - 1).alias("last"))
    same = Window.partitionBy("doc_id", "h", "notice").orderBy("d")
    lines = lines.withColumn("band", F.sum((F.col("d") - F.coalesce(F.lag("d").over(same), F.col("d") - 1000) > gap).cast("int")).over(same))
    bands = lines.groupBy("doc_id", "h", "notice", "label", "size", "band").agg(F.array_distinct(F.flatten(F.collect_list("q"))).alias("q"), F.min("first").alias("first"), F.max("last").alias("last"))
    words = F.array_distinct(F.flatten(F.transform("q", lambda q: F.sequence(q, q + (k - 1)))))
    bands = bands.withColumn("coverage", F.size(words) / F.col("size"))
    least = F.when(F.col("size") < LONG, covered).otherwise(covered_long)
    return bands.where(F.col("coverage") >= least).select("doc_id", "h", "label", "first", "last", "coverage")


def scan_licenses(docs: DataFrame, k: int = K) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    state = stored(rows.mapInArrow(_scan(k), STATE), "grams")
    near = state.where("size(near) > 0").select("doc_id", "h", F.explode("near").alias("m")).select("doc_id", "h", "m.label", "m.coverage")
    found = spans(state, k).select("doc_id", "h", "label", "coverage").union(near).groupBy("doc_id", "h").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    found = found.withColumnsRenamed({"doc_id": "_doc_id", "h": "_h"})
    df = state.drop("grams", "named", "near").join(found, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))


def report(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
