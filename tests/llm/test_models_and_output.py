"""Toxicity, mixing, url filter, language model, token output and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from millrace.llm import lm_scoring, mixing, token_output, toxicity, url_filter
from millrace.llm.words import ALNUM_WORDS, Words, window_starts, windows


def key(values):
    return sorted(values, key=repr)


def test_words_match_python():
    texts = ["A b\tc", None, "", "  x ", "é漢 Zz", "end", "\x1c\x85 q"]
    column = pa.array(["pad", *texts])[1:]  # an array with an offset
    w = Words(column, lower=True)
    assert [[w.bytes_of(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)] == [["a", "b", "c"], [], [], ["x"], ["é漢", "zz"], ["end"], ["\x1c\x85", "q"]]
    assert len(Words(pa.array(["a1-b_c"]), ALNUM_WORDS)) == 3
    h = Words(pa.array(["a b a b", "a b"])).hashes()
    assert h[0] == h[2] == h[4] != h[1] and windows(h, 2)[0] == windows(h, 2)[2]
    assert window_starts(np.array([0, 4, 6]), 2).tolist() == [True, True, True, False, True, False]
    assert len(set(Words(pa.array([f"w{i}" for i in range(50_000)])).hashes().tolist())) == 50_000


def test_mixing(spark, docs, rows, no_docs):
    got = mixing.mix_sources(docs).collect()
    size = Counter()
    for _, t, _, source, *_ in rows:
        size[source] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total = sum(size.values())
    open_, target = set(order), {}
    while open_:  # share, stop at the cap, share the excess again
        left = 1.5 * total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        for s in over or open_:
            target[s] = 2 * size[s] if over else share[s]
        open_ = set() if not over else open_ - set(over)
    most = max(r._size for r in got)
    taken = Counter()
    for r in got:
        assert r._source_size == size[r.source] and math.isclose(r._target, target[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert r._taken in (0, r._size, 2 * r._size)
        taken[r.source] += r._taken
    assert all(abs(taken[s] - target[s]) <= most for s in order) and sum(taken.values()) <= 1.5 * total
    again = mixing.mix_sources(docs.repartition(5), slots=16, bins=64).collect()
    pick = lambda rs: Counter((r.doc_id, r._size, r._taken) for r in rs)
    assert pick(again) == pick(got)  # the same whatever the layout
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r._taken // r._size for r in got if r._size)
    assert mixing.mix_sources(no_docs).collect() == []


def test_url_filter(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "http://sub.example.org/en/2#y", "http://x.com/fr/1", "http://com/de/", "http://x.com/es/4", "ftp://net/a/b", "nothing", None, "http://x.org", "http://x.org?y", "://h/p", "http://anexample.org/es/1"]
    r = random.Random(2)
    urls += [f"http://h{r.randint(0, 3)}.{d}/{p}/{r.randint(1, 999)}" for d in ("org", "com", "net", "example.org") for p in ("en", "fr", "de", "es") for _ in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: x for x in url_filter.report(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else None
        host = path = ""
        if rest is not None:
            end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, want[1])
        assert got[i].verdict == want[0] if fits else got[i].verdict in ("allow", "block")
    net = {p: Counter(x.verdict for x in got.values() if x.host.endswith("net") and x.path.startswith(f"/{p}/")) for p in ("fr", "es")}
    assert net["fr"]["allow"] == 40 and net["es"]["block"] >= 0 and url_filter.report(pages.limit(0)).collect() == []
    assert {x.verdict for x in url_filter.report(pages.where("url like '%net%'")).collect()} == {"allow"}  # no labelled page


def brute_templates(pages, support=8, share=0.02, strength=4.0, z=2.0):
    """Template and score of each (host, path, label or None), by loops over dictionaries."""
    shapes = []
    for host, path, _ in pages:
        while path.endswith("/"):
            path = path[:-1]
        segments = path.split("/")
        shapes.append((host, tuple(segments[:1] + ["*" if re.search("[0-9]", x) else x for x in segments[1:]])))
    prefix = [""] * len(pages)
    done = [len(x[1]) <= 1 for x in shapes]
    depth = 1
    while not all(done):
        here = [(h, prefix[i], x[depth]) if not done[i] and len(x) > depth else None for i, (h, x) in enumerate(shapes)]
        live = [k for k in here if k]
        a, b, c, d = Counter(live), Counter(k[:2] for k in live), Counter(k[1:] for k in live), Counter(k[1] for k in live)
        old = list(prefix)
        for i, k in enumerate(here):
            if done[i]:
                continue
            if not k or d[old[i]] < support:
                prefix[i], done[i] = old[i] + "/*" * (len(shapes[i][1]) - depth), True
            else:
                kept = (a[k] >= support and a[k] >= share * b[k[:2]]) or (c[k[1:]] >= support and c[k[1:]] >= share * d[k[1]])
                prefix[i] = old[i] + "/" + (k[2] if kept else "*")
        depth += 1

    def nodes(key):
        n = {}
        for (h, _, label), t in zip(pages, prefix, strict=True):
            parts = t.split("/")
            for j in range(1, len(parts) + 1):
                k = (h if key else None, "/".join(parts[:j]))
                x = n.setdefault(k, [0, 0])
                x[0] += label == "allow"
                x[1] += label is not None
        far = lambda x, p: abs(x[0] - x[1] * p) > z * math.sqrt(x[1] * p * (1 - p))
        up = lambda k: (k[0], k[1].rsplit("/", 1)[0]) if k[1] else None
        side, pool = {}, {}
        for k, x in n.items():
            above = n[up(k)] if up(k) else None
            p = above[0] / max(1, above[1]) if above else 0
            side[k] = 1 if above is None else 0 if not (x[1] and far(x, p)) else 1 if x[0] > x[1] * p else -1
            if above is not None and side[k]:
                y = pool.setdefault((up(k), side[k]), [0, 0])
                y[0], y[1] = y[0] + x[0], y[1] + x[1]
        out = {}
        for k, x in n.items():
            y = pool.get((up(k), side[k])) if up(k) else None
            out[k] = (side[k], *(y if y and not far(x, y[0] / max(1, y[1])) else x))
        return out

    by_host, free = nodes(True), nodes(False)
    result = []
    for (host, _, _), t in zip(pages, prefix, strict=True):
        f = e = 0.5
        parts = t.split("/")
        for j in range(1, len(parts) + 1):
            q = "/".join(parts[:j])
            (hs, ha, hm), (fs, fa, fm) = by_host[host, q], free[None, q]
            f = (fa + strength * f) / (fm + strength) if fs else f
            e = f if fs else e
            e = (ha + strength * e) / (hm + strength) if hs else e
        result.append((t, e))
    return result


def test_url_templates_and_scores_by_brute_force(spark):
    r = random.Random(12)
    urls = []
    for _ in range(500):
        host = r.choice(["a.com", "b.com", "c.org", "d.net", "e.net", "x.example.org"])
        path = "/" + r.choice(["fr", "de", "es", "en", "shop"]) + "".join("/" + r.choice(["p", "q", "item", str(r.randint(1, 99)), "rare" + r.choice("abcdefghij")]) for _ in range(r.randint(0, 9)))
        urls.append(f"http://{host}{path}{r.choice(['', '/', '?x=1'])}")
    urls += ["http://d.net" + "/deep" * 12 + f"/{i}" for i in range(9)] + [None, "http://a.com", urls[0], urls[0]]
    pages = spark.createDataFrame([(i if i else None, u, "other", "t", 1.0) for i, u in enumerate(urls)], "page_id long, url string, verdict string, template string, score double")
    got = url_filter.judge(pages).collect()
    assert got[0].asDict().keys() == {*pages.columns, "_host", "_path", "_rule", "_verdict", "_template", "_score"}
    label = {x.url: x._verdict if x._rule else None for x in got}
    want = dict(zip(urls, brute_templates([(x._host, x._path, label[x.url]) for x in sorted(got, key=lambda x: x.page_id or 0)]), strict=True))
    assert len(got) == len(urls) and any(x._template.count("/") > 9 for x in got)
    for x in got:
        t, e = want[x.url]
        assert x._template == t and math.isclose(x._score, e, abs_tol=1e-9) and (x._rule or x._verdict == ("block" if e < 0.5 else "allow"))


def brute_ctw(texts, ask, depth=lm_scoring.DEPTH):
    """log10 P of the texts in `ask`, by the recursive definition over dictionaries."""
    from functools import lru_cache

    counts = {}
    seq = lambda t: ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).encode() + b"\0"

    def steps(t):
        s = seq(t)
        for i, byte in enumerate(s):
            back = bytes(s[i - 1 - k] if i - 1 - k >= 0 else 0 for k in range(depth))
            for level in range(8):
                yield back, (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1

    for t in texts:
        for back, mark, bit in steps(t):
            for d in range(depth + 1):
                counts.setdefault((back[:d], mark), [0, 0])[bit] += 1
    children = {}
    for context, mark in counts:
        if context:
            children.setdefault((context[:-1], mark), []).append((context, mark))
    kt = lambda n0, n1: math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(node):
        own = kt(*counts[node])
        if len(node[0]) == depth:
            return own, 1.0
        below = sum(weighted(c)[0] for c in children[node])
        both = max(own, below) + math.log(math.exp(own - max(own, below)) + math.exp(below - max(own, below))) - math.log(2)
        return both, math.exp(own - math.log(2) - both)

    out = []
    for t in ask:
        total = 0.0
        for back, mark, bit in steps(t):
            p, seen = 0.5, False
            for d in range(depth, -1, -1):
                node = (back[:d], mark)
                if node in counts:
                    n = counts[node]
                    q = (n[bit] + 0.5) / (sum(n) + 1)
                    stop = weighted(node)[1]
                    p, seen = (stop * q + (1 - stop) * p if seen else q), True
            total += math.log10(p)
        out.append(total)
    return out


def test_lm_scoring(docs, rows, no_docs):
    short = [r for r in rows if len(r[1] or "") < 900]
    df = docs.where("coalesce(length(text), 0) < 900")
    got = lm_scoring.score_texts(df, group_bytes=1 << 12, slice_bytes=500).collect()  # several groups of several slices
    train = [r for r in short if not lm_scoring.is_held_out(r[0])]
    c = Counter(w for r in train for w in [*(r[1] or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    expected = []
    for r, score in zip(short, brute_ctw([x[1] for x in train], [x[1] for x in short]), strict=True):
        w = [*(r[1] or "").lower().split(), None]
        expected.append((r[0], lm_scoring.is_held_out(r[0]), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), score))
    order = lambda x: (x[0] is None, x[0] or 0, x[2], round(x[6], 2))
    for a, b in zip(sorted((tuple(x)[:7] for x in got), key=order), sorted(expected, key=order), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-4)
    assert any(x.held_out for x in got) and lm_scoring.score_texts(no_docs).collect() == []


def test_predictions_add_up_to_one():
    column = pa.array(["abracadabra", "abba", None])
    words = Words(column)
    keys, _ = lm_scoring.byte_keys(words.data, words.offsets)
    key_, n = np.unique(keys, return_counts=True)
    depths = lm_scoring.trees(key_, n, 0)
    for context in (keys[3], keys[8], np.uint64(0)):
        every = (context >> np.uint64(8) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** lm_scoring.log_probability(every, depths)).sum(), 1, rel_tol=1e-9)


def test_token_output(docs, rows, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows]
    got = sorted(token_output.report(docs).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key((d, len(x), crc(x)) for d, x in ids)
    assert token_output.report(no_docs).collect() == []


def test_pieces_give_the_tokenizers_own_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    parts = ["a", "the", "Ü", " ", "  ", "\n", "\t", "é", "×", "÷", "'s", "'", "don't", ".", "!!", "&&&", "<|endoftext|>", "|", "12", "3.5", " ", "　", "中", "🙂", " x", "_", "-", "\x85", "\x1c", "İ", "ñ,", "'ll", "\x00", " unusuallylongword", " exactlysixteen.", " seventeenletters"]
    for e in (token_output.Encoder(), token_output.Encoder(slots=4, most_ids=50)):  # the second one forgets all the time
        for _ in range(60):
            texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(20)] + [None, ""]
            ids, n = e.encode(pa.array(texts, pa.string()))
            want = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
            assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
        assert e.table.shape == (e.slots, 3) and len(e.flat) < 1 << 20


def test_long_texts_are_encoded_in_steps(monkeypatch):
    monkeypatch.setattr(token_output, "STEP", 7)
    e = token_output.Encoder()
    texts = ["word and, more words " * 50, None, "x" * 300, "end"]
    ids, n = e.encode(pa.array(texts))
    want = [e.tokenizer.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def unfolded(x, rules, terminals=300):
    return token_output.unfold(np.asarray(x, np.uint32), rules, terminals)


def test_repair_round_trip():
    r = random.Random(6)
    for terminals in (300, 70_000):  # pairs of 32 and of 64 bits
        for _ in range(60):
            x = np.array([r.choice([0, 1, 1, 1, 2, 3, terminals - 1]) for _ in range(r.randint(0, 400))], np.uint32)
            rules, lengths, symbols = token_output.compress(x, terminals, least=2)
            assert np.array_equal(unfolded(symbols, rules, terminals), x) and len(lengths) == len(rules)
            assert [len(unfolded([terminals + i], rules, terminals)) for i in range(len(rules))] == lengths.tolist()
            shard = token_output.Shard(token_output.write_shard([None], np.array([len(x)]), x, terminals))
            assert np.array_equal(shard.ids(), x)
            i = r.randint(0, len(x))
            n = r.randint(0, len(x) - i)
            assert np.array_equal(shard.slice(i, n), x[i : i + n])


def test_repair_goes_on_until_no_pair_is_frequent():
    r = random.Random(11)
    passage = [r.randint(1, 40_000) for _ in range(1000)]
    copies = np.array([x for _ in range(64) for x in [*passage, 0]], np.uint32)
    rules, _, symbols = token_output.compress(copies, 50_257)  # the values that files are written with
    assert np.array_equal(unfolded(symbols, rules, 50_257), copies) and len(symbols) <= 64 * 4
    words = [[r.randint(1, 300) for _ in range(r.randint(1, 30))] for _ in range(200)]
    mixed = np.array([x for _ in range(6000) for x in [*r.choice(words), *([0] if r.random() < 0.05 else [])]], np.uint32)
    noise = np.array([r.choice([0, 1, 1, 1, 2, 2, 3]) for _ in range(20_000)], np.uint32)
    for x in (mixed, noise):
        for most in (3, 8192):
            rules, lengths, symbols = token_output.compress(x, 301, most=most)
            places = Counter(zip(symbols.tolist(), symbols[1:].tolist(), strict=False))
            assert max(n for (a, b), n in places.items() if a and b) < 8 and len({tuple(x) for x in rules.tolist()}) == len(rules)
            assert np.array_equal(unfolded(symbols, rules, 301), x)
            assert lengths.tolist() == [len(unfolded([301 + i], rules, 301)) for i in range(len(rules))]


def test_ranges_over_shards_and_partitions(spark, docs, rows, tmp_path):
    folder = f"{tmp_path}/tokens"
    token_output.write_tokens(docs, folder, shard_ids=500, part_bytes=10_000)
    shards = spark.read.schema(token_output.SHARD).parquet(folder)
    assert shards.select("part").distinct().count() > 2 and shards.count() > shards.select("part").distinct().count()
    whole = token_output.read_range(spark, folder, 0, 1 << 30)
    got = sorted(token_output.read_tokens(spark, folder).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((x[0] for x in rows), key=lambda i: (i is not None, i or 0))
    for x in got:
        assert zlib.crc32(whole[x.start : x.start + x.n_tokens].astype("<u4").tobytes()) == x.ids_crc32
    for start, n in ((0, 1), (490, 30), (3, 5000), (len(whole) - 2, 9)):
        assert np.array_equal(token_output.read_range(spark, folder, start, n), whole[start : start + n])


def test_one_id_fills_many_partitions(spark, tmp_path):
    many = spark.range(0, 400, 1, 3).selectExpr("cast(null as long) as doc_id", "'the same text every time' as text")
    token_output.write_tokens(many, f"{tmp_path}/t", part_bytes=1000)
    parts = spark.read.schema(token_output.SHARD).parquet(f"{tmp_path}/t").groupBy("part").count().count()
    got = token_output.read_tokens(spark, f"{tmp_path}/t").collect()
    assert parts > 3 and len(got) == 400 and len({x.start for x in got}) == 400 and len({x.ids_crc32 for x in got}) == 1


def test_toxicity(spark, no_docs):
    r = random.Random(7)
    good = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words, toxic = [r.choice(good) for _ in range(r.randint(5, 120))], int(i % 4 == 0)
        for _ in range(1 + len(words) // 40):
            if toxic:
                words[r.randrange(len(words))] = r.choice(["zonk", "zonkig", "Brutzel"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(900, None), (901, ""), (None, "zonk"), (3, rows[3][1])]
    labels += [(5, None), (None, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.report(docs, known).collect()
    truth = dict(labels[:900])
    out = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(got) == len(rows) and sum(x.predicted == truth[x.doc_id] for x in out) >= 0.95 * len(out)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    again = {x.doc_id: x.score for x in toxicity.report(docs.repartition(7), known).collect() if x.doc_id is not None}
    assert all(abs(again[x.doc_id] - x.score) < 1e-3 for x in got if x.doc_id is not None)
    assert toxicity.report(no_docs, known).collect() == [] and {x.predicted for x in toxicity.report(docs, known.limit(0)).collect()} == {0}


def test_toxicity_gradients():
    """Every gradient against the difference of losses."""
    r = np.random.default_rng(3)
    model = toxicity.Model(buckets=50, d=4, f=3)
    for name in ("embedding", "filters", "bias", "weight", "offset"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    model.embedding += r.standard_normal(model.embedding.shape) * 0.5
    model.weight += r.standard_normal(model.weight.shape) * 0.3
    rows = [r.integers(0, 50, (n, 5)).astype(np.uint16) for n in (3, 70, 0, 150, 1, 64)]
    toxic, share = np.array([1, 0, 1, 1, 0, 0]), np.array([1.0, 0.5, 1.0, 1.0, 0.5, 0.5])

    def loss():
        z = toxicity._logits(model, rows)
        return (np.logaddexp(0, np.where(toxic == 1, -z, z)) * share).mean() + 0.5e-4 * (model.weight**2).sum()

    grads, buckets, embedding = toxicity._gradients(model, rows, toxic, share)
    whole = np.zeros_like(model.embedding)
    whole[buckets] = embedding
    for parameter, g in zip([model.filters, model.bias, model.weight, model.offset, model.embedding], [*grads, whole], strict=True):
        flat, want = parameter.reshape(-1), np.asarray(g).reshape(-1)
        for i in r.choice(len(flat), min(25, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - want[i]) < 1e-5 + 1e-3 * abs(want[i])


def test_toxicity_long_texts_and_clashing_columns(spark):
    r = random.Random(13)
    rows = [(i, " ".join(r.choice(["zonk", "brutz"] if i % 2 and r.random() < 0.3 else ["calm", "words", "here", "and"]) for _ in range(40)), 0.5, 1, "x") for i in range(200)]
    rows += [(1000, "calm words " * 30_000, 0.5, 1, "x"), (1001, "zonk brutz " * 30_000, 0.5, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic int, predicted string")
    labels = spark.createDataFrame([(x[0], x[0] % 2, "q") for x in rows], "doc_id long, toxic int, text string")
    got = {x.doc_id: x for x in toxicity.report(docs, labels).collect()}
    assert len(got) == 202 and got[1000].predicted == 0 and got[1001].predicted == 1
    model = toxicity.fit(docs, labels, class_bytes=2000)  # a handful of texts
    assert toxicity.score_toxicity(docs, model).count() == 202


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    docs = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) + r.choice(["", "", "", "."]) for _ in range(120)), "en", f"s{i % 3}", 1) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "s1", 1) for i in range(5)] + [(200, "Bad Bad " * 100, "en", "s1", 1), (201, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    leak = " ".join(docs[9][1].split()[10:30])
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = [x.doc_id for x in left.select("doc_id").collect()]
    assert set(seen["quality"]) == set(range(60)) | set(range(100, 105))
    assert sorted(seen["near_duplicates"]) == list(range(60))
    assert sorted(seen["decontaminate"]) == [i for i in range(60) if i != 9]
    assert max(Counter(seen["mix"]).values()) <= 2 and 9 not in seen["mix"]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in final) == Counter(seen["mix"])
