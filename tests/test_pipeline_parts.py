"""Allocation, packing, batches, tokenizer, ledgers, deduplication and sources: literal cases."""

import io
import json
import random
import urllib.error
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import allocation, dedup, packing, tokenizer
from millrace.sources import jsonl, paged
from millrace.streaming import ledger


def test_allocation(spark):
    assert allocation.allocate(1001, {"a": "0.53", "b": "0.08", "c": "0.005", "d": "0.385"}) == {"a": 531, "b": 80, "c": 5, "d": 385}
    assert [s["target"] for s in allocation.schedule(262_144)] == [13_107, 144_179, 52_429, 47_186, 5_243]
    floors = allocation.enforce_floors({"general": 95, "indic": 3, "agentic": 2}, {"indic": "0.09", "agentic": "0.005"})
    assert floors == {"general": 89, "indic": 9, "agentic": 2} and sum(floors.values()) == 100
    for s in allocation.schedule(262_144, reserve_tiers={"verified_native", "translated"}):
        assert sum(s["lanes"].values()) == s["target"] and sum(s["tiers"].values()) == s["lanes"]["indic"]
        assert s["lanes"]["indic"] >= Decimal(s["target"]) * Decimal("0.08")
    rows = spark.createDataFrame([(f"r{i:02d}", i + 1) for i in range(20)], "record_id string, n int").withColumn("lane", F.lit("x"))
    band = {r.record_id: r.difficulty_band for r in allocation.difficulty_bands(rows, ["lane"], "n", "record_id").collect()}
    assert band["r00"] == "B0" and band["r19"] == "B5" and band["r10"] == "B2"
    with pytest.raises(ValueError):
        allocation.difficulty_bands(rows, ["lane"], "n", "record_id", (("B0", "0.5"), ("B1", "0.4"), ("B2", "1")))


def test_schedule_follows_the_supply(spark):
    kinds = "permission string, band string, lane string, tier string, loss long"
    lanes = [(p, b, lane, None, 500) for p in ("train", "anneal") for b in ("B0", "B1") for lane in ("general", "code")]
    tiers = [("train", b, "indic", t, 100) for b in ("B0", "B1") for t in allocation.TIERS] + [("anneal", "B1", "indic", "translated", 60), ("validation", "B0", "general", None, 10**6)]
    supply = spark.createDataFrame(lanes + tiers, kinds)
    stages = (("first", "0.9", 256, ("B0",), "train"), ("last", "0.1", 256, ("B1",), "anneal"))
    options = {"mixture": {"general": "0.6", "code": "0.3", "indic": "0.1"}, "floors": {"indic": "0.1"}}
    plan = allocation.executable_schedule(500, supply, stages, **options)
    assert [s["target"] for s in plan] == [450, 50] and plan[1]["tiers"] == {"translated": 5} and sum(plan[0]["tiers"].values()) == plan[0]["lanes"]["indic"] == 45
    with pytest.raises(ValueError, match="first: general asks for 540 of 500"):
        allocation.executable_schedule(1000, supply, stages, **options)
    rows = supply_problem = allocation.supply_problems(plan, [])
    assert len(rows) == 6 + len(plan[0]["tiers"]) + 1 and supply_problem[0][:3] == ("first", "general", None)
    records = spark.createDataFrame([(i, "indic", t, "B0", 10, 1_000_000, p) for i, (t, p) in enumerate((t, p) for t in ("a", "b") for p in ("train", "anneal") for _ in range(6))] + [(100 + i, "general", "a", "B0", 7, 1_000_000, "train") for i in range(5)], "record_id long, lane string, tier string, band string, loss long, weight_micros long, permission string")
    targets = spark.createDataFrame([("indic", "a", 25), ("indic", "b", 40), ("general", None, 20)], "lane string, tier string, target long")
    chosen = allocation.select_stage(records, "s", targets, ("B0",), "seed", "train")
    got = {(r.lane, r.tier): r.n for r in chosen.groupBy("lane", "tier").agg(F.sum("selected").alias("n")).collect()}
    assert got == {("indic", "a"): 25, ("indic", "b"): 40, ("general", "a"): 20} and not {r.record_id for r in chosen.collect()} & set(range(6, 12))
    wanted = targets.withColumn("stage", F.lit("s"))
    assert allocation.require_targets(chosen, wanted) is chosen
    with pytest.raises(ValueError, match="s general: 20 of 21"):
        allocation.require_targets(chosen, wanted.withColumn("target", F.expr("if(lane = 'general', 21, target)")))


def test_floors_equal_giving_one_by_one():
    r = random.Random(4)
    for _ in range(300):
        targets = {k: r.randint(0, 30) for k in "abcdef"[: r.randint(1, 6)]}
        floors = {k: r.choice(["0.05", "0.1", "0.3"]) for k in r.sample("abcdefg", r.randint(0, 3))}
        total, want, stuck = sum(targets.values()), dict(targets), False
        least = {k: -(-total * int(100 * Decimal(f)) // 100) for k, f in floors.items()}
        for lane in sorted(least):
            while want.get(lane, 0) < least[lane] and not stuck:
                rich = [(v, k) for k, v in want.items() if k != lane and v > least.get(k, 0)]
                stuck = not rich
                if rich:
                    want[max(rich)[1]] -= 1
                    want[lane] = want.get(lane, 0) + 1
        if stuck:
            with pytest.raises(ValueError):
                allocation.enforce_floors(targets, floors)
        else:
            assert allocation.enforce_floors(targets, floors) == want


def test_units_are_pythons(spark):
    import re

    texts = ["the cat sat, on", "क्\u200dष हिन्दी x\u200cy", "a_b  c\n\n!!\u200d?", "é1 ½²", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(F.regexp_extract_all("text", F.lit(tokenizer.UNIT), F.lit(0)).alias("u"))
    want = [re.findall(r"\s+|[\w\u200c\u200d]+|[^\w\s]+", t) for t in texts]
    assert len(want[0]) == 8 and [r.u for r in df.collect()] == want


def test_vocabulary_is_checked_on_load(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some plain words and words")], "doc_id long, text string")
    vocab = tokenizer.vocabulary(docs, 270)
    h = tokenizer.save_vocabulary(vocab, f"{tmp_path}/v")
    assert sorted(map(tuple, tokenizer.load_vocabulary(spark, f"{tmp_path}/v", h).collect())) == sorted(map(tuple, vocab.collect()))
    with pytest.raises(ValueError):
        tokenizer.load_vocabulary(spark, f"{tmp_path}/v", "sha256:other")
    vocab.where("id <> 268").withColumn("tokenizer_hash", F.lit(h)).write.parquet(f"{tmp_path}/w")
    with pytest.raises(ValueError):
        tokenizer.load_vocabulary(spark, f"{tmp_path}/w")


def test_selection_clips_the_last_and_reports_shortfall(spark):
    supply = spark.createDataFrame([(i, "a", "B0", 10, 1_000_000) for i in range(10)], "record_id long, lane string, band string, loss long, weight_micros long")
    target = spark.createDataFrame([("a", 35)], "lane string, target long")
    chosen = allocation.select_for_schedule(supply, [("one", target, ("B0",)), ("two", target, ("B0",))], "seed")
    got = chosen.collect()
    assert sorted(r.selected for r in got if r.stage == "one") == [5, 10, 10, 10] and len({r.record_id for r in got}) == 8
    want = spark.createDataFrame([("one", "a", 35), ("two", "a", 36)], "stage string, lane string, target long")
    assert [(r.stage, r.got) for r in allocation.shortfall(chosen, want).collect()] == [("two", 35)]


def test_packing():
    out = packing.pack([("a", "s", [1, 2, 3, 4, 5], [1] * 5), ("b", "s", [6, 7, 8], [0, 1, 1])], 4)
    assert [s["tokens"] for s in out] == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 0, 0]]
    assert [s["segments"] for s in out] == [[0] * 4, [0, 0, 1, 1], [0, 0, -1, -1]] and out[2]["positions"] == [0, 1, 0, 0]
    assert sum(s["loss_tokens"] for s in out) == 7 and [f[-1] for s in out for f in s["fragments"]] == [0, 1, 0, 1]
    with pytest.raises(ValueError):
        packing.pack([], 1)
    r = random.Random(1)
    for _ in range(100):  # token by token
        length = r.randint(2, 9)
        records = [(str(i), "s", [r.randint(1, 99) for _ in range(n)], [r.randint(0, 1) for _ in range(n)]) for i, n in enumerate(r.randint(0, 25) for _ in range(r.randint(0, 7)))]
        now: list[tuple] = []
        want = [now]
        for name, _, tokens, loss in records:
            for i, (t, m) in enumerate(zip(tokens, loss, strict=True)):
                if len(now) == length:
                    now = [(tokens[i - 1], 0, name)] if i else []
                    want.append(now)
                now.append((t, m, name))
        out = packing.pack(records, length)
        assert [[*zip(s["tokens"], s["loss"], strict=True)][: s["nonpadding"]] for s in out] == [[x[:2] for x in w] for w in want if w]
        for s, w in zip(out, [w for w in want if w], strict=True):
            names = [x[2] for x in w]
            assert s["segments"][: len(w)] == [sorted(set(names), key=names.index).index(x) for x in names] and s["segments"][len(w) :] == [-1] * (length - len(w))
            assert s["positions"][: len(w)] == [i - names.index(x) for i, x in enumerate(names)] and [(f[0], f[6] - f[5], f[4] - f[3] + f[7]) for f in s["fragments"]] == [(x, names.count(x), names.count(x)) for x in sorted(set(names), key=names.index)]
    for _ in range(200):
        length, sizes = r.randint(2, 9), [r.randint(0, 30) for _ in range(r.randint(0, 8))]
        out = packing.pack([(str(i), "s", [7] * n, [1] * n) for i, n in enumerate(sizes)], length)
        fill = done = again = 0
        for n in filter(None, sizes):
            if fill == length:
                done, fill = done + 1, 0
            rest = n - (length - fill)
            k = -(-rest // (length - 1)) if rest > 0 else 0
            fill = fill + n if rest <= 0 else 1 + rest - (k - 1) * (length - 1)
            done, again = done + k, again + k
        assert len(out) == done + (fill > 0) and sum(s["nonpadding"] for s in out) == sum(sizes) + again


def test_batches_use_each_sequence_once():
    r = random.Random(2)
    rows = [{"index": i, "length": 256, "lane": r.choice(["general", "indic", "agentic"]), "tier": None, "loss": r.choice([0, 20, 200, 250]), "nonpadding": 250, "sources": [r.choice("abc")]} for i in range(37)]
    stage = {"stage": "s", "length": 256, "target": 5000, "lanes": {"general": 4000, "indic": 800, "agentic": 200}, "tiers": {}}
    out = packing.select_batches(rows, stage, 1024)
    assert sorted(i for b in out for i in b["ids"]) == list(range(37)) and out == packing.select_batches(list(reversed(rows)), stage, 1024)
    assert packing.zero_share(1, 7, 4) == 1 and packing.zero_share(0, 5, 4) == 0 and packing.zero_share(9, 0, 4) == 3 and packing.zero_share(9, 1, 4) == 3
    c = lambda i, score, loss, density, deficit: {"id": i, "score": score, "metrics": {"loss": loss, "loss_density_ppm": density, "floor_deficit": deficit}}
    d = packing.decide([c(0, 5, 10, 400_000, 9), c(1, 4, 10, 400_000, 0), c(2, 99, 0, 0, 0), c(3, 1, 10, 500_000, 3)], 300_000, True)
    assert (d["accepted"]["id"], d["normal"], d["outcome"], d["rejected"], d["deferred"]) == (1, 0, "protected_floor_override", [2], [0, 3])
    assert packing.decide([c(0, 5, 0, 0, 0)], 300_000, True)["outcome"] == "sparse_fallback"


def test_tokenizer(spark):
    texts = ["def f(x):\n    return x\n", "हिन्दी में पाठ", "αβγ 🙂 emoji", "plain words and plain words", ""] * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocab = tokenizer.vocabulary(docs, 320)
    rows = vocab.collect()
    assert len(rows) == 320 == len({bytes(r.piece) for r in rows}) and sorted(r.id for r in rows) == list(range(320))
    assert sorted(map(tuple, tokenizer.vocabulary(docs.repartition(5), 320).collect())) == sorted(map(tuple, rows))
    got = tokenizer.encode(docs.withColumns({"kind": F.lit("plain"), "permission": F.lit("train")}), vocab).collect()
    assert all(r.lossless and len(r.tokens) == len(r.loss) and r.loss[0] == 0 and all(r.loss[1:]) for r in got)
    t = "q\n<reasoning>\nabc"
    assert [t[a:b] for a, b in tokenizer.supervised_spans(t, "reasoning")] == ["abc"]
    with pytest.raises(ValueError):
        tokenizer.supervised_spans("no marker", "translated")
    t = "x <observation>  kept</observation>"
    assert [t[a:b] for a, b in tokenizer.supervised_spans(t, "translated")] == ["kept"]
    t = "<user>\nhi\n<assistant>\nyes\n<tool>\nout <tool_call>c</tool_call>\n<assistant>\nend"
    assert [t[a:b] for a, b in tokenizer.supervised_spans(t, "agentic")] == ["yes\n", "<tool_call>c</tool_call>", "end"]
    assert tokenizer.supervised_spans("<user>\nhi", "agentic").tolist() == [] and tokenizer.supervised_spans(t, "plain") is None
    t = "<assistant>\né<tool_call>a</tool_call>\n<user>\nb"  # a call within a turn is no span of its own
    spans = [(0, 0), (0, 12), (12, 14), (14, 36), (36, 46), (46, 46)]
    assert tokenizer.loss_mask(t, spans, "agentic", "train") == ([0, 0, 1, 1, 0, 0], "assistant_origin_only")
    assert tokenizer.loss_mask(t, spans, "agentic", "never_train") == ([0] * 6, "never_train_zero_loss")
    assert tokenizer.loss_mask("x", [(0, 0), (0, 1), (1, 1)], "plain", "train") == ([0, 1, 1], "full_text_causal")
    assert tokenizer.loss_mask("<observation> ab</observation>", [(0, 0), (0, 14), (14, 16), (16, 30), (30, 30)], "translated", "train") == ([0, 0, 1, 0, 0], "translated_observation_only")
    df = spark.createDataFrame([([0, 1, 2, 3, 4], [0, 0, 1, 0, 1], 1)], "t array<int>, m array<int>, k int")
    a, b = tokenizer.clip_to_loss(F.col("t"), F.col("m"), F.col("k"))
    assert tuple(df.select(a, b).first()) == ([0, 1, 2], [0, 0, 1])


def test_cascade_near_duplicates_and_registry(spark):
    sentence = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"x {sentence} y"), (2, "clean text"), (3, "clean text"), (4, sentence), (5, "a Short Reference, of six words here"), (6, f"x {sentence} y")], "doc_id long, text string")
    evaluation = spark.createDataFrame([(sentence,), ("short reference of six words",), ("too few",)], "text string")
    got = {r.doc_id: r.status for r in dedup.cascade(docs, evaluation, ["doc_id"]).collect()}
    assert got == {1: "ngram_evaluation_overlap", 2: "admitted", 3: "duplicate", 4: "exact_evaluation_overlap", 5: "ngram_evaluation_overlap", 6: "ngram_evaluation_overlap"}
    w = [f"w{i}" for i in range(60)]
    chain = [(10, " ".join(w)), (11, " ".join(w[4:] + ["p", "q", "r", "s"])), (12, " ".join(w[8:] + ["p", "q", "r", "s", "t", "u", "v", "z"])), (13, " ".join(w)), (14, "alone")]
    label = {r.doc_id: r.component for r in dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), "doc_id").collect()}
    assert label == {10: 10, 11: 10, 12: 10, 13: 10, 14: 14}  # 10 and 12 are linked through 11 only
    entries = spark.createDataFrame([("e1", "a"), ("e1", "a"), ("e2", "a"), ("e2", "b")], "evaluation_id string, text string")
    assert {r.evaluation_id: r.conflict for r in dedup.registry(entries).collect()} == {"e1": False, "e2": True}


def _links_by_brute_force(rows):
    """Links between classes of equal word 3-gram sets, and from a class's least id to its others."""
    classes = {}
    for i, text in rows:
        if text is not None:
            w = text.lower().replace("ß", "ss").split() or [""]
            classes.setdefault(frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)]), []).append(i)
    out = [(min(ids), i, 0.0) for ids in classes.values() for i in ids if i != min(ids)]
    known = sorted((min(ids), s) for s, ids in classes.items())
    return sorted(out + [(a, b, round(1 - len(s & t) / len(s | t), 9)) for k, (a, s) in enumerate(known) for b, t in known[k + 1 :] if 5 * len(s & t) >= 4 * len(s | t)])


@pytest.mark.parametrize("block", [512, 7])
def test_minhash_links_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK_MEMBERS", block)
    r = random.Random(5)
    word = lambda: f"w{r.randrange(300)}"
    texts = [None, None, "", " ", "a", "A ", "a b", "b a", "a b c", "Straße a\tb", "strasse A b"]
    for _ in range(6):
        base = [word() for _ in range(r.randrange(20, 90))]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = word()
            texts += [" ".join(w)] * r.choice((1, 1, 3))
    texts += [" ".join(f"x{i}" for i in range(n)) for n in (10, 12, 13)]  # 8 of 10 grams, 8 of 11, 10 of 11
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = dedup.minhash_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id")
    assert sorted((x.a, x.b, round(x.distance, 9)) for x in got.collect()) == _links_by_brute_force(rows)


def test_minhash_query_has_copies_and_all_exact_pairs(spark, tmp_path):
    from millrace.plans.dedup_queries import j9_minhash_lsh

    rows = [(3, "one two three four"), (5, "ONE two  three four"), (9, "one two three four"), (11, "five six seven"), (12, "five six")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, j9_minhash_lsh(spark, str(tmp_path)).collect())) == [(3, 5, 0.0), (3, 9, 0.0)]


def test_ledger_stream_resumes(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10, 1, 1).selectExpr("id", "concat('p', id) as p").write.mode("append").parquet(f"{tmp_path}/in")
    args = (spark, f"{tmp_path}/in", "id long, p string", f"{tmp_path}/ledger", f"{tmp_path}/checkpoint", "r", "p", "id")
    with pytest.raises(Exception, match="planned stop"):
        ledger.append_stream(*args, until=2).awaitTermination()
    ledger.append_stream(*args).awaitTermination()
    got = ledger.read_ledger(spark, f"{tmp_path}/ledger").orderBy("place").collect()
    whole = ledger.chain([r.payload for r in got])
    assert len(got) == 30 and [(r.previous_hash, r.entry_hash) for r in got] == whole
    df = spark.createDataFrame([tuple(r)[:5] for r in got], ledger.ENTRY)
    assert ledger.verify(df).count() == 0 and ledger.verify(df.where("place <> 7")).collect()[0].place == 8


def test_ledger_stream_leaves_the_rows_to_the_executors(spark, tmp_path, monkeypatch):
    frame, seen = type(spark.range(1)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: seen.append(len(rows := collect(self))) or rows)
    spark.range(0, 500, 1, 1).selectExpr("id div 2 as id", "concat('p', id) as p").write.parquet(f"{tmp_path}/in")  # every place twice
    args = (spark, f"{tmp_path}/in", "id long, p string", f"{tmp_path}/ledger", f"{tmp_path}/checkpoint", "r", "p", "id")
    ledger.append_stream(*args).awaitTermination()
    spark.createDataFrame([(250, "x"), (251, None)], "id long, p string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ledger.append_stream(*args).awaitTermination()
    assert max(seen) <= 1
    got = {r.previous_hash: r for r in ledger.read_ledger(spark, f"{tmp_path}/ledger").collect()}
    payloads, at = [], ledger.GENESIS
    while at in got:
        payloads.append(got[at].payload)
        at = got[at].entry_hash
    assert payloads == [p for i in range(250) for p in sorted((f"p{2 * i}", f"p{2 * i + 1}"))] + ["x", None]
    spark.createDataFrame([(251, "y")], "id long, p string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="arrived behind place 251"):
        ledger.append_stream(*args).awaitTermination()
    assert ledger.read_ledger(spark, f"{tmp_path}/ledger").count() == 502


def test_resumed_stream_takes_ids_below_zero(spark, tmp_path):
    from millrace.plans.ledger_queries import l5_l6_resumed_stream

    spark.range(-7, 4).selectExpr("id as event_id", "id + 9 as user_id", "'t' as event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = l5_l6_resumed_stream(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(-7, 4))
    assert [(r.previous_hash, r.entry_hash) for r in got] == ledger.chain([f"{i},{i + 9},t" for i in range(-7, 4)])


def test_sources(spark, tmp_path):
    raw, lines, file = jsonl.canonical_lines([{"b": 1, "a": "é"}])
    assert (raw, lines, file) == jsonl.canonical_lines([{"a": "é", "b": 1}]) and len(lines) == 64
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": 1, "targets": [{"source_id": "a"}, {"source_id": "a"}]}))
    with pytest.raises(ValueError):
        jsonl.read_catalogue(spark, str(tmp_path / "c.json"))
    waits, answers = [], [urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"}, None), urllib.error.HTTPError("u", 503, "", {}, None), io.BytesIO(b'{"rows": []}')]

    def opener(_):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert paged.fetch("u", sleep=waits.append, opener=opener) == {"rows": []} and waits == [3.0, 7.0, 3.0, 6.0, 3.0]
    page = tmp_path / "page-0"
    page.write_text(json.dumps({"num_rows_total": 2, "rows": [{"row": {"x": 1}}, {"row": {"x": 2}}]}))
    reader = paged.PagedReader({"url": f"file://{tmp_path}/page-{{offset}}", "offsets": "0", "pause": "0", "total": "2"})
    assert list(reader.read(reader.partitions()[0])) == [(0, '{"x": 1}'), (1, '{"x": 2}')]
    assert jsonl.shard_bytes([1, 65535]) == b"\x01\x00\xff\xff"
    with pytest.raises(ValueError):
        jsonl.shard_bytes([1 << 16])


def test_fork_proofs_and_cross_check(spark):
    import hashlib

    rows = spark.createDataFrame([(r, i, f"{r}{i}") for r in ("a", "b") for i in range(6)], "run string, place long, payload string")
    old = ledger.chain_runs(rows)
    new = ledger.fork(old, 4, rows.select("run", "place", F.concat("payload", F.lit("!")).alias("payload"))).orderBy("run", "place").collect()
    for run in ("a", "b"):
        mine = [r for r in new if r.run == run]
        assert [r.payload for r in mine] == [f"{run}{i}" + "!" * (i > 3) for i in range(6)] and [(r.previous_hash, r.entry_hash) for r in mine] == ledger.chain([r.payload for r in mine])
    with pytest.raises(ValueError):
        ledger.fork(old.where("place <> 2"), 4, rows)
    sequences = spark.createDataFrame([(i, 10 * i, 9, [i, 1], [0, 1], [0, 0], [0, 1]) for i in range(5)], "sequence_index long, token_offset long, nonpadding long, tokens array<int>, loss array<int>, segments array<int>, positions array<int>")
    made = spark.createDataFrame([("s", 0, [3, 1], 5), ("s", 1, [0], 2), ("t", 0, [4, 2], 7)], "stage string, batch long, ids array<long>, loss long")
    proofs = {(r.stage, r.batch): r for r in ledger.batch_proofs(made, sequences).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    one = proofs["s", 0]
    assert one.spans == "30+9;10+9" and one.tokens_hash == sha(sha("3,1") + "|" + sha("1,1"))
    assert one.proof == sha("|".join(["s", "0", one.spans, one.tokens_hash, one.loss_hash, one.segments_hash, one.positions_hash]))
    a, b = ledger.consumption_and_learning(made, ledger.batch_proofs(made, sequences))
    assert ledger.cross_check(a, b).count() == 0 and ledger.verify(a).count() == ledger.verify(b).count() == 0
    found = ledger.cross_check(a.where("run = 's'"), b.where("place = 0").withColumn("payload", F.regexp_replace("payload", r"\|.{8}", "|xxxxxxxx")))
    assert sorted(map(tuple, found.collect())) == [("s", 0, "other_entry"), ("s", 1, "no_learning"), ("t", 0, "no_consumption")]
    assert sorted(map(tuple, packing.usage_problems(made.where("stage = 's'").union(made.where("batch = 1")), sequences).collect())) == [(0, "repeated"), (2, "lost"), (4, "lost")]


def test_shards_and_manifest_rules(spark):
    import numpy as np

    from millrace.operators import shards

    rows = [("l", "train", i, [2, 300 + i, 3], [0, 1, 1]) for i in range(10)] + [("l", "validation", 50, [2, 3], [0, 0])]
    indexed = shards.index(spark.createDataFrame(rows, "lane string, permission string, record_id long, tokens array<int>, loss array<tinyint>"), 4)
    assert {r.record_id: r.token_offset for r in indexed.collect()} == {**{i: 3 * i for i in range(10)}, 50: 0} and shards.offset_gaps(indexed).count() == 0
    parts = shards.segments(indexed, 8).orderBy("permission", "segment").collect()
    assert [r.records for r in parts] == [3, 3, 2, 2, 1] and np.frombuffer(bytes(parts[0].payload), "<u2").tolist() == [2, 300, 3, 2, 301, 3, 2, 302, 3]
    m = shards.manifest(shards.segments(indexed, 8))
    assert m.select(F.flatten(F.collect_list(shards.violations(m, ("l",))))).first()[0] == [] and {r.segments for r in m.collect()} == {4, 1}
    bad = m.where("permission = 'validation'").withColumn("loss_tokens", F.lit(9).cast("long")).withColumn("shard_hash", F.lit("md5:1"))
    assert bad.select(shards.violations(bad, ("other",)).alias("v")).first().v == ["unknown_lane", "hash_form", "loss_over_tokens", "loss_where_none_is_allowed"]


def test_revisions_projections_gates_and_canaries(spark):
    from millrace.functions import projections, quality, text
    from millrace.sources import revisions

    h = "0123456789abcdef" * 3
    targets = spark.createDataFrame([("a", "x/a", h), ("b", "x/b", "main"), ("c", "x/c", h), ("d", "x/d", h), ("e", "local/e", "v0")], "source_id string, dataset string, revision string")
    found = spark.createDataFrame([("x/a", h), ("x/b", "main"), ("x/c", h[::-1])], "dataset string, sha string")
    assert sorted(map(tuple, revisions.revision_problems(targets, found).collect())) == [("b", "not_pinned"), ("c", "other_revision"), ("d", "not_found")]
    with pytest.raises(ValueError, match="b \\(not_pinned\\)"):
        revisions.verified(targets, found)
    q = spark.createDataFrame([(" 1 + 1? ", "2\n")], "q string, a string").select(*projections.reasoning(F.col("q"), F.col("a"))).first()
    assert q.text == "<question>\n1 + 1?\n<reasoning>\n2" and len(q.upstream_id) == 64
    licenses = spark.createDataFrame([("MIT",), ("GPL-3.0",), (None,), ("apache-2.0",)], "license string")
    assert sorted(r.license for r in projections.license_gate(licenses, "license", ["mit", "Apache-2.0"]).collect()) == ["MIT", "apache-2.0"]
    table = "{| class=x\n" + "| cell\n" * 60 + "|}\n"
    docs = spark.createDataFrame([("short",), (table + "a few words",), ("words " * 80,), ("- " * 200,), (None,)], "text string")
    assert [r.reason for r in quality.gates_around_cleanup(docs).collect()] == ["too_short_before_cleanup", "too_short_after_cleanup", "pass", "no_language_content", "too_short_before_cleanup"]
    hindi = spark.createDataFrame([("\u0939\u093f\u0928\u094d\u0926\u0940 ab",)], "text string")
    assert hindi.select(quality.script_fraction(F.col("text"), "devanagari")).first()[0] == 3 / 5
    marked = text.marker_contexts(spark.createDataFrame([("aXX  b\nXX cXXXXd",), ("none",), (None,)], "text string"), "XX", 3, 2).collect()
    assert [r._contexts for r in marked] == [["aXX", "b XX c", "cXXXX"], [], []]
    docs = spark.createDataFrame([(1, "Some STRASSE here"), (2, "none"), (3, None), (4, "canary-1 canary-12")], "doc_id long, text string")
    canaries = spark.createDataFrame([("stra\u00dfe",), ("",), ("canary-1",), ("canary-12",)], "canary string")
    assert sorted(map(tuple, dedup.canary_hits(docs, canaries).collect())) == [(1, "strasse"), (4, "canary-1"), (4, "canary-12")]


def test_firewall_by_brute_force(spark):
    r = random.Random(21)
    word = lambda: r.choice("abcd")
    items = [[word() for _ in range(r.choice([3, 5, 6, 9, 13, 16]))] for _ in range(12)]
    rows = [(i, [word() for _ in range(r.randint(0, 60))]) for i in range(80)]
    want = set()
    for i, w in rows:
        for v in items:
            k = min(13, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k >= 5 else set()
            if any(tuple(w[j : j + k]) in grams for j in range(len(w) - k + 1)):
                want.add(i)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(None, "x"), (200, None)], "doc_id long, text string")
    got = dedup.overlapping(docs, spark.createDataFrame([(" ".join(v),) for v in items], "text string"), "doc_id")
    assert {x.doc_id for x in got.collect()} == want and 5 < len(want) < 80


def test_evaluation_registry(spark):
    kinds = "evaluation_id string, benchmark_id string, version string, text string"
    old = dedup.register(spark.createDataFrame([], kinds), spark.createDataFrame([("e2", "b", "1", "two"), ("e1", "b", "1", "one")], kinds))
    again = dedup.register(old, spark.createDataFrame([("e1", "b", "1", "one")], kinds))
    assert again.count() == 2 and dedup.registry_hash(again) == dedup.registry_hash(old.repartition(3))
    more = dedup.register(old, spark.createDataFrame([("e3", "b", "1", "three")], kinds))
    assert dedup.registry_hash(more) != dedup.registry_hash(old)
    with pytest.raises(ValueError, match="e1"):
        dedup.register(old, spark.createDataFrame([("e1", "b", "1", "other")], kinds))
    docs = spark.createDataFrame([(1, "one"), (2, "One"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in dedup.blocked(docs, old).collect()] == [1]


def test_pages_are_cached_and_loaded_by_name(spark, tmp_path):
    (tmp_path / "page-0").write_text(json.dumps({"num_rows_total": 3, "rows": [{"row": {"x": 1}}, {"row": {"x": 2}}]}))
    (tmp_path / "page-2").write_text(json.dumps({"num_rows_total": 3, "rows": [{"row": {"x": 3}}]}))
    spark.dataSource.register(paged.PagedSource)
    options = {"url": f"file://{tmp_path}/page-{{offset}}", "offsets": "0,2", "pause": "0", "total": "3", "cache": f"{tmp_path}/cache"}
    load = lambda: sorted(map(tuple, spark.read.format("paged_rows").options(**options).load().collect()))
    want = [(0, '{"x": 1}'), (1, '{"x": 2}'), (2, '{"x": 3}')]
    assert load() == want
    (tmp_path / "page-0").unlink()
    assert load() == want  # from the cache
    waits, answers = [], [urllib.error.URLError("down"), TimeoutError(), io.BytesIO(b"{}")]

    def opener(_):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert paged.fetch("u", sleep=waits.append, opener=opener) == {} and waits == [3.0, 3.0, 3.0, 6.0, 3.0]
