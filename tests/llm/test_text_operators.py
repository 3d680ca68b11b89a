"""Substring dedup, n-gram Jaccard, decontamination, license scan and quality rules against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import decontamination, license_scan, ngram_jaccard, quality_rules, substring_dedup
from millrace.llm.words import Words, windows

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=False, pattern=SPACE_WORD):
    return pattern.findall((text or "").translate(LOWER) if lower else text or "")


def key(values):
    return sorted(values, key=repr)


def test_substring_dedup(docs, rows, no_docs):
    least = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - 12):
            if d is not None:
                k = tuple(w[i : i + 13])
                least[k] = min(least.get(k, d), d)
    expected = []
    for d, t, *_ in rows:
        w, gone = words(t), set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    result = substring_dedup.substring_dedup(docs, group_bytes=1 << 12)
    assert key(map(tuple, substring_dedup.digest(result).collect())) == key(expected)
    for r in result.collect():
        assert sum(s.length for s in r.removed) == r.n_removed and len(words(r.kept)) == r.n_words - r.n_removed
    assert substring_dedup.substring_dedup(no_docs).collect() == []


def brute_components(rows):
    sets = {}
    for d, t, *_ in rows:
        w = words(t, True)
        s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.setdefault(d, []).append(s)
    nodes = sorted((d for d in sets if d is not None))
    up = {d: d for d in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    by_set = {}
    for d in nodes:
        for s in sets[d]:
            by_set.setdefault(s, find(d))
    return [(d, len(s), (find(d) if d is not None else by_set.get(s) if s else None)) for d, ss in sets.items() for s in ss]


def test_ngram_jaccard(docs, rows, no_docs, monkeypatch):
    got = [tuple(r) for r in ngram_jaccard.ngram_jaccard(docs, group_bytes=1 << 12).collect()]
    assert key(got) == key(brute_components(rows))
    monkeypatch.setattr(ngram_jaccard, "HOT", 20)  # some classes meet their rows by broadcast, some by a shuffle
    assert key(tuple(r) for r in ngram_jaccard.ngram_jaccard(docs, group_bytes=1 << 12).collect()) == key(got)
    small = [tuple(r) for r in ngram_jaccard.ngram_jaccard(docs, group_bytes=1 << 12, max_sets=3).collect()]
    assert key(small) == key(got)  # blocks of a large component give the same
    assert ngram_jaccard.ngram_jaccard(no_docs).collect() == []


def test_keep_texts_of_null_and_repeated_ids(spark, docs, rows):
    import corpus_pipeline

    def want(rows):
        sets = []
        for i, (_, t, *_) in enumerate(rows):
            w = words(t, True)
            sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        group = list(range(len(rows)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group = [group[j] if g == group[i] else g for g in group]
        out = defaultdict(set)
        for g, (d, *_) in zip(group, rows, strict=True):
            out[g].add((d is None, d or 0))
        return Counter(None if min(ds)[0] else min(ds)[1] for ds in out.values())

    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == want(rows)
    r = random.Random(9)
    text = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(8)]
    near = [" ".join([*text[5].split()[:-k], *["zz"] * k]) for k in (4, 8)]  # near[1] links with text[5] through near[0] only
    own = [(3, text[0]), (4, text[0]), (4, text[1]), (None, text[2]), (None, text[3]), (None, text[3]), (None, text[0]), (7, text[4]), (7, text[4])]
    own += [(8, text[5]), (None, near[0]), (9, near[1]), (4, text[6])]
    for parts in (1, 5):
        kept = ngram_jaccard.keep_texts(spark.createDataFrame(own, "doc_id long, text string").repartition(parts), group_bytes=1 << 9)
        got = [tuple(x) for x in kept.collect()]
        assert key(got) == key([(3, text[0]), (4, text[1]), (4, text[6]), (None, text[2]), (None, text[3]), (7, text[4]), (8, text[5])])
    assert Counter(x[0] for x in got) == want(own)
    assert ngram_jaccard.keep_texts(docs.limit(0)).collect() == []


def test_links_against_all_pairs():
    r = random.Random(1)
    for _ in range(20):
        base = [r.getrandbits(40) for _ in range(60)]
        sets = [np.unique(np.array([x for x in base if r.random() > 0.1] + [r.getrandbits(40) for _ in range(r.randint(0, 12))], np.uint64)) for _ in range(30)]
        ids, size, stats = np.arange(30) + 5, np.array([len(s) for s in sets]), {}
        got = ngram_jaccard.link(ids, size, sets, 75, stats)
        label = list(range(30))
        for i in range(30):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if 100 * c >= 75 * (size[i] + size[j] - c):
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
        assert got.tolist() == [5 + x for x in label]
        assert stats.get("derived", 0) > 0


def test_decontamination(spark, docs, rows, no_docs):
    source = words(next(t for d, t, *_ in rows if d == 8), True, ALNUM_WORD)
    items = [(1, " ".join(source[2:20])), (2, "ONE"), (3, None), (4, ""), (10, "nothing of this stands anywhere else in them at all"), (None, " ".join(source[:12])), (5, " ".join(source[5:8]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for d, t, *_ in rows:
        w, hit, found = words(t, True, ALNUM_WORD), set(), set()
        for i, text in items:
            v = words(text, True, ALNUM_WORD)
            k = min(10, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else set()
            for j in range(len(w) - k + 1):
                if grams and tuple(w[j : j + k]) in grams:
                    hit.update(range(j, j + k))
                    found.add(i)
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        expected.append((d, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    assert key(map(tuple, decontamination.report(docs, bench).collect())) == key(expected)
    assert key(map(tuple, decontamination.report(docs, bench, block_bytes=60).collect())) == key(expected)
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not e[-1] for e in expected)
    cut = decontamination.remove_spans(docs, bench)
    assert cut.count() == len(rows)
    assert decontamination.report(no_docs, bench).collect() == [] and decontamination.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_window_sets_with_colliding_hashes(monkeypatch):
    """With hashes of three values only, the words alone decide."""
    monkeypatch.setattr(decontamination, "windows", lambda h, k: windows(h, k) % np.uint64(3))
    r = random.Random(7)
    for _ in range(30):
        make = lambda n: " ".join(r.choice(["aa", "bb", "Aa", "c", "ccc"]) for _ in range(n))
        items, texts = [(str(i), make(r.randint(0, 6))) for i in range(12)], [make(r.randint(0, 30)) for _ in range(5)]
        held = decontamination.WindowSet(items, 3)
        batch = Words(pa.array(texts), decontamination.ALNUM_WORDS, True)
        hit, found = held.hits(batch, len(texts))
        for row, text in enumerate(texts):
            w, want, names = text.lower().split(), set(), set()
            for name, item in items:
                v = item.lower().split()
                k = min(3, len(v))
                for j in range(len(w) - k + 1 if k else 0):
                    if any(w[j : j + k] == v[x : x + k] for x in range(len(v) - k + 1)):
                        want.update(range(j, j + k))
                        names.add(name)
            assert set(np.flatnonzero(hit[batch.first[row] : batch.first[row + 1]]).tolist()) == want and found[row] == names


def test_license_scan(spark, no_docs):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0. More words."),
        (2, "x y This work is licensed under the GNU General Public License, version 3."),
        (3, "Apache  LICENSE, and the mit-license; cc by"),
        (4, None),
        (5, ""),
        (6, "no license at all"),
        (None, "Released under the MIT License."),
        (7, "Licensed under CC BY-NC 4.0."),
        (1, "Licensed under the Apache License, Version 2.0. More words."),
        (8, "Permission is hereby granted, free of charge, to any (odd) person obtaining a copy of this software"),
    ]
    got = license_scan.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    phrases = dict(license_scan.PHRASES)
    for d, t in rows:
        w = words(t, True, ALNUM_WORD)
        at = [(i, phrases[p]) for p in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = ",".join(sorted({x for _, x in at}))
        r = [x for x in got if x.doc_id == d and x.n_words == len(w)][0]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(at), min(at)[0] if at else None, max(at)[0] if at else None, base)
        assert set(filter(None, base.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert len(got) == len(rows) and labels[7] == "cc-by,cc-by-nc" and labels[2] == "gpl" and labels[8] == "mit" and labels[6] == ""
    assert license_scan.report(no_docs).collect() == []


def test_license_notices_with_a_changed_lost_or_inserted_word(spark):
    texts = {
        "Licensed under the BSD 3-Clause License": "bsd",
        "licensed under a BSD license": "bsd",
        "Distributed under the GNU Lesser General Public License": "lgpl",
        "available under the GNU Affero General Public License": "agpl",
        "Licensed under the GNU Lesser General Public License version 3": "lgpl",
        "This source form is subject to the terms of the Mozilla Public License": "mpl",
        "available under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "licensed under cc by nc sa 4 0": "cc-by",
        "the BSD sockets are described here": "",
        "a GNU Lesser General Public License text is printed in this book": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.report(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    assert license_scan.edits([b"a", b"b", b"c"], [b"a", b"x", b"c", b"d"]) == 1 and license_scan.edits([b"a"], []) == 1


def brute_alignments(text, k=3, gap=3):
    """(label, coverage) of the templates that a text's diagonals verify, by loops."""
    w, out = words(text, True, ALNUM_WORD), []
    joined = f" {' '.join(w)} "
    for label, template in license_scan.TEMPLATES:
        v = template.split()
        name = next((x for x in license_scan.NAMES if f" {x} " in f" {template} "), None)
        if name and f" {name} " not in joined:
            continue
        at = defaultdict(set)
        for p in range(len(w) - k + 1):
            for q in range(len(v) - k + 1):
                if w[p : p + k] == v[q : q + k]:
                    at[p - q].add(q)
        band, last = set(), None
        best = 0.0
        for d in sorted(at):
            band = band if last is not None and d - last <= gap else set()
            band |= {x for q in at[d] for x in range(q, q + k)}
            last = d
            best = max(best, len(band) / len(v))
        if best >= (0.9 if len(v) < license_scan.LONG else 0.6):
            out.append((label, best))
    return out


def test_license_texts_by_brute_force(spark):
    r = random.Random(15)
    rows = []
    for label, text in license_scan.TEXTS:
        w = text.split()
        rows.append((label, "\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7))))  # reflowed
        rows.append((label, "Copyright someone\n" + " ".join(w[: int(0.8 * len(w))]) + " and then something else"))  # a part
        rows.append((label, " ".join(x for x in w if r.random() > 0.04)))  # words lost
        rows.append((label, text.upper()))
    rows += [(None, " ".join(r.choice(rows[0][1].split()) for _ in range(300))), (None, "the word software " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, (_, t) in enumerate(rows)], "doc_id long, text string, labels string, score double")
    got = {x.doc_id: x for x in license_scan.scan_licenses(docs).collect()}
    assert len(got) == len(rows)
    near = set()
    for i, (label, text) in enumerate(rows):
        found = brute_alignments(text) if len(text) < 10_000 else []
        assert {x for x, _ in found} <= set(got[i].labels)
        if label:
            assert label in got[i].labels and not {"gpl", "lgpl", "agpl"} - {label} & set(got[i].labels)
            assert got[i].score >= max((c for _, c in found), default=0.5) - 1e-9
        else:
            assert got[i].labels == [] and not found
        near |= set(got[i].labels) - {x for x, _ in found} - set(got[i].base_labels)
    assert near <= {"gpl", "lgpl", "agpl", "mpl", "apache"}  # sentences aligned around a name


def test_quality_rules(spark, docs, rows, no_docs):
    junk = [(1000 + i, "Xy Xy " * 200, "en", "s1", 1, 7, 9, "x") for i in range(8)] + [(2000 + i, "word*** other### more&&& " * 40 + str(i), "en", "s1", 1, 7, 9, "x") for i in range(8)]
    r = random.Random(4)
    prose = [(3000 + i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) + r.choice(["", "", "", "."]) for _ in range(150)), "en", "s1", 1, 7, 9, "x") for i in range(60)]
    every = rows + junk + prose
    df = spark.createDataFrame(every, docs.schema)
    got = defaultdict(list)
    for x in quality_rules.report(df).collect():
        got[x.doc_id].append(x)
    for d, t, *_ in every:
        w, t = words(t), t or ""
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert want in [tuple(x)[1:7] for x in got[d]]
    assert not any(x.kept for d in got for x in got[d] if x.base_failed or 1000 <= (d or 0) < 3000)
    assert all(x.kept for d in got for x in got[d] if (d or 0) >= 3000)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == sum(x.kept for d in got for x in got[d])
    assert quality_rules.report(no_docs).collect() == []


def test_label_model_follows_the_data():
    """Documents drawn with known rates of votes, at several shares of good ones: the estimate finds the share, and the posterior the class."""
    r = random.Random(5)
    kinds = [vote for vote, _ in quality_rules.RULES.values()]
    on_good = [0.95 if k > 0 else 0.02 for k in kinds]
    on_bad = [0.1 if k > 0 else 0.3 for k in kinds]
    for share in (0.02, 0.05, 0.5, 0.95):
        drawn = []
        for _ in range(4000):
            good = r.random() < share
            drawn.append((tuple(k if r.random() < (on_good if good else on_bad)[i] else 0 for i, k in enumerate(kinds)), good))
        patterns = sorted(Counter(votes for votes, _ in drawn).items())
        found, a, b = quality_rules.estimate(patterns)
        assert abs(found - share) < 0.03
        if 0.04 < share < 0.96:
            assert max(abs(x - y) for x, y in zip(a + b, on_good + on_bad, strict=True)) < 0.12
        wrong = sum((quality_rules.log_odds(found, a, b, votes) >= 0) != good for votes, good in drawn)
        assert wrong < 0.03 * len(drawn)
        right = quality_rules.accuracies(found, a, b)
        assert all(0 < x < 1 for x in right)


def test_label_model_brute_force(spark):
    """Posteriors of the query against the same sums in plain Python."""
    r = random.Random(9)
    texts = [" ".join(r.choice(["good", "words", "x***", "BAD", "end.", "why!", "q"]) for _ in range(r.choice([30, 80, 120]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality_rules.judge(df).collect()
    votes = {x.doc_id: tuple(x[f"_vote_{k}"] for k in quality_rules.RULES) for x in rows}
    share, a, b = quality_rules.estimate(sorted(Counter(votes.values()).items()))
    for x in rows:
        good, bad = share, 1 - share
        for i, v in enumerate(votes[x.doc_id]):
            good, bad = good * (a[i] if v else 1 - a[i]), bad * (b[i] if v else 1 - b[i])
        assert abs(x._posterior - good / (good + bad)) < 1e-9 and x._kept == (not x._base_failed and x._posterior >= 0.5)
    assert quality_rules.estimate([])[0] == pytest.approx(0.5)


@pytest.mark.parametrize("name", ["op4_mixing", "op5_decontamination"])
def test_query_equals_sql(spark, name):
    import os

    import duckdb

    from millrace.llm.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the tables aren't here")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder)
    result = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    plain = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(columns) == sorted(got.columns)
    assert key(plain(r[c] for c in columns) for r in got.collect()) == key(plain(r) for r in result.fetchall())


def test_pipeline_stages_with_awkward_tables(spark, docs, rows, no_docs, tmp_path):
    """Null and repeated ids, ties, extra and clashing columns, and empty tables pass all stages."""
    import corpus_pipeline

    spark.createDataFrame([(1, "nothing of this stands anywhere in the documents at all"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing = docs.withColumnsRenamed({"g": "score", "size": "template", "component": "n_words"})
    for table, some in ((docs, True), (clashing, True), (no_docs, False)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, table, str(tmp_path))
            found = out.collect()
            assert bool(found) == some, name
            if name != "tokens":
                assert out.columns == table.columns
    assert corpus_pipeline.STAGES[0][1](spark, no_docs, str(tmp_path)).collect() == []
    assert corpus_pipeline.STAGES[0][1](spark, clashing, str(tmp_path)).columns == clashing.columns
