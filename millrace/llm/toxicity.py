"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Alphanumeric lower-case words and their beginnings of 4 to 7 bytes (stems that several words share) are hashed into
`buckets` embeddings, which are added up. Filters of several widths slide over the whole text. Responses are
max-pooled over the text, and over each segment of 64 words with the mean of the segments, so that a word that slips
into a long text weighs less than one that runs through it. A logistic layer scores the pooled values.

Training takes at most `per_class` labelled documents a class and `class_bytes` of their texts (those of the smallest hash
of doc_id: the same on every run; texts over `text_bytes` aren't trained on), as whole texts of word buckets; some 1.7 bytes
a byte of text, 110 MB at the most, reach the driver. One dimension of the embeddings starts at how much more often than by
chance a bucket stands in toxic texts; embeddings, filters and weights are trained by Adam, and every fifth text is kept
out to choose the epoch and the thresholds, which are calibrated by language.
The language is detected from the text's own function words, so lang, source, labels and doc_id are no inputs; a score
of 0.5 is each language's threshold.

Defined cases: null, empty or wordless texts get the score of an empty text; documents without a label aren't trained
on; several labels of a document all count; with no label of either class every score is 0.5 or under it; repeated rows
score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import U64
from millrace.llm.words import ALNUM_WORDS, Words, mix

BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
BEGINNINGS = (4, 5, 6, 7)
SEGMENT = 64
# Frequent function words of the languages that get a threshold of their own.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as are be this by at or from",
    "fr": "le la les de des du et en un une est que qui dans pour sur pas au aux",
    "de": "der die das und den von zu mit sich des auf ist im dem nicht ein eine auch",
    "es": "el la los las de del y en un una es que por con para se no su al",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def word_buckets(column, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of each word and of its beginnings (words, 1 + beginnings), the rows' first words, and each row's language (an index of LANGUAGES)."""
    words = Words(column, ALNUM_WORDS, True)
    hashes = words.hashes()
    votes = np.zeros((len(words.count), len(FUNCTION_WORDS)), np.int64)
    row = words.row()
    for j, text in enumerate(FUNCTION_WORDS.values()):
        known = np.sort(Words(pa.array([text]), ALNUM_WORDS, True).hashes())
        i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        votes[:, j] = np.bincount(row[known[i] == hashes], minlength=len(words.count))
    language = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(FUNCTION_WORDS)) if len(votes) else np.zeros(0, np.int64)
    x = np.empty((len(words), 1 + len(BEGINNINGS)), np.uint16)
    x[:, 0] = mix(hashes) % U64(buckets)
    for j, most in enumerate(BEGINNINGS):
        x[:, 1 + j] = mix(words.hashes(most) ^ U64(most)) % U64(buckets)
    return x, words.first, language


class Model:
    """embedding (buckets, d); filters (d, columns): for each width and each of its offsets f columns; bias (widths * f);
    weight (2 * widths * f) of the pooled values; threshold by language."""

    def __init__(self, buckets: int = BUCKETS, d: int = 8, f: int = 6, seed: int = 7):
        r = np.random.default_rng(seed)
        self.f = f
        self.embedding = (r.standard_normal((buckets, d)) * 0.02).astype(np.float32)
        self.filters = (r.standard_normal((d, sum(WIDTHS) * f)) * 0.2).astype(np.float32)
        self.filters[0] = np.abs(self.filters[0]) + 0.2
        self.bias = np.full(len(WIDTHS) * f, -1.0, np.float32)
        self.weight = np.full(2 * len(WIDTHS) * f, 0.2, np.float32)
        self.offset = np.full(1, -1.0, np.float32)
        self.threshold = np.zeros(len(LANGUAGES))

    def layout(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows are laid out in whole segments, max(WIDTHS) - 1 zero words before each, so that no window spans two rows: the place of each word, each row's first segment, and the number of segments."""
        n = np.diff(first)
        segments = np.maximum(1, -(-(n + max(WIDTHS) - 1) // SEGMENT))
        begin = np.concatenate([[0], np.cumsum(segments)])
        return np.repeat(begin[:-1] * SEGMENT + max(WIDTHS) - 1 - first[:-1], n) + np.arange(first[-1]), begin[:-1], int(begin[-1])

    def pooled(self, x: np.ndarray, first: np.ndarray, where: bool = False):
        """For each row the largest response of each filter, and the mean over its segments of each segment's largest one."""
        place, begin, segments = self.layout(first)
        e = np.zeros((segments * SEGMENT + max(WIDTHS), self.embedding.shape[1]), self.embedding.dtype)
        if len(x):
            own = self.embedding[x[:, 0]]
            for j in range(1, x.shape[1]):
                own += self.embedding[x[:, j]]
            e[place] = own
        z = e @ self.filters
        m, f, at, best, places = segments * SEGMENT, self.f, 0, [], []
        for width in WIDTHS:
            y = z[:m, at : at + f].copy()
            for j in range(1, width):
                y += z[j : m + j, at + j * f : at + (j + 1) * f]
            at += width * f
            y = y.reshape(segments, SEGMENT, f)
            best.append(y.max(axis=1))
            if where:
                places.append(y.argmax(axis=1) + np.arange(segments)[:, None] * SEGMENT)
        s = np.maximum(np.concatenate(best, axis=1) + self.bias, 0)
        if not len(begin):
            return np.zeros((0, 2 * s.shape[1]), np.float32)
        count = np.diff(np.append(begin, segments)).astype(np.float32)[:, None]
        out = np.concatenate([np.maximum.reduceat(s, begin, axis=0), np.add.reduceat(s, begin, axis=0) / count], axis=1)
        return (out, s, places, e, begin, count) if where else out

    def logit(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (self.pooled(x, first) @ self.weight + self.offset).astype(np.float64)

    def score(self, x, first, language) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x, first) - self.threshold[language], -500, 500)))


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _logits(model: Model, rows: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([model.logit(*_joined(rows[i : i + 256])) for i in range(0, len(rows), 256)])


def _gradients(model: Model, rows: list[np.ndarray], toxic: np.ndarray, share: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of filters, bias, weight and offset; and the buckets that matter with the gradients of their embeddings."""
    x, first = _joined(rows)
    h, s, places, e, begin, count = model.pooled(x, first, True)
    p = 1 / (1 + np.exp(-np.clip(h @ model.weight + model.offset, -50, 50)))
    g = ((p - toxic) * share / len(rows)).astype(model.weight.dtype)
    half = s.shape[1]
    row = np.repeat(np.arange(len(rows)), count[:, 0].astype(np.int64))
    top, mean = np.outer(g, model.weight[:half]), np.outer(g, model.weight[half:]) / count
    top_here = s == h[row, :half]
    ties = np.add.reduceat(top_here.astype(np.float32), begin, axis=0)[row]
    ds = (mean[row] + np.where(top_here, top[row] / ties, 0)) * (s > 0)
    filters, at, f = np.zeros_like(model.filters), 0, model.f
    words = np.full(len(e), -1, np.int64)
    words[model.layout(first)[0]] = np.arange(len(x))
    where, pull = [], []
    for k, width in enumerate(WIDTHS):
        d = ds[:, k * f : (k + 1) * f]
        for j in range(width):
            column = slice(at + j * f, at + (j + 1) * f)
            filters[:, column] = np.einsum("sf,sfd->df", d, e[places[k] + j])
            where.append((places[k] + j).ravel())
            pull.append((d[:, :, None] * model.filters[:, column].T[None]).reshape(-1, e.shape[1]))
        at += width * f
    word, pulled = words[np.concatenate(where)], np.concatenate(pull)
    used = (word >= 0) & pulled.any(axis=1)
    buckets, inverse = np.unique(x[word[used]], return_inverse=True)  # a word's buckets are added up, so each gets its gradient
    embedding = np.zeros((len(buckets), e.shape[1]), e.dtype)
    np.add.at(embedding, inverse.reshape(-1), np.repeat(pulled[used], x.shape[1], axis=0))
    return [filters, ds.sum(axis=0), h.T @ g + 1e-4 * model.weight, g.sum(keepdims=True)], buckets, embedding


def train(rows: list[np.ndarray], toxic: np.ndarray, language: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, embedding_rate: float = 0.003, seed: int = 7) -> Model:
    """A model of texts given as word buckets, with their labels (0 or 1) and languages. Every fifth text is kept out to choose the epoch and to calibrate."""
    model = Model(seed=seed)
    if len(rows) < 10 or min(toxic.sum(), (1 - toxic).sum()) < 2:
        model.weight[:] = 0
        model.offset[:] = 0
        model.threshold[:] = 1e-9
        return model
    kept = np.arange(len(rows)) % 5 == 4
    if not 0 < toxic[kept].sum() < kept.sum():
        kept[:] = False
    learn = np.flatnonzero(~kept)
    check = np.flatnonzero(kept) if kept.any() else learn
    # embeddings: how much more often a word stands in toxic texts than by chance, shrunk by two assumed texts
    seen = np.zeros((2, len(model.embedding)))
    for i in learn:
        seen[toxic[i], np.unique(rows[i])] += 1
    chance = seen.sum(axis=0) * toxic[learn].mean()
    model.embedding[:, 0] = np.log((seen[1] + 2) / (chance + 2))
    r = np.random.default_rng(seed)
    parameters = [model.filters, model.bias, model.weight, model.offset]
    state = [(np.zeros_like(q), np.zeros_like(q)) for q in parameters]
    moments = np.zeros_like(model.embedding), np.zeros_like(model.embedding)
    share = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    best, step = (np.inf, []), 0
    for _ in range(epochs):
        order = r.permutation(learn)
        for part in (order[i : i + batch] for i in range(0, len(order), batch)):
            step += 1
            grads, buckets, pulled = _gradients(model, [rows[i] for i in part], toxic[part], share[part])
            for q, gq, (m, v) in zip(parameters, grads, state, strict=True):
                m += 0.1 * (gq - m)
                v += 0.01 * (gq * gq - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            m, v = (t[buckets] for t in moments)  # only the buckets of this batch move
            m, v = m + 0.1 * (pulled - m), v + 0.01 * (pulled * pulled - v)
            moments[0][buckets], moments[1][buckets] = m, v
            model.embedding[buckets] -= embedding_rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        z = _logits(model, [rows[i] for i in check])
        loss = float((np.logaddexp(0, np.where(toxic[check] == 1, -z, z)) * share[check]).mean())
        if loss < best[0]:
            best = (loss, [q.copy() for q in [*parameters, model.embedding]])
    for q, old in zip([*parameters, model.embedding], best[1], strict=True):
        q[:] = old
    calibrate(model, [rows[i] for i in check], toxic[check], language[check])
    return model


def calibrate(model: Model, rows: list[np.ndarray], toxic: np.ndarray, language: np.ndarray, least: int = 20) -> None:
    """Sets each language's threshold to the middle of the widest range with the fewest errors on these texts; a language with under
    `least` toxic or clean ones gets that of all texts."""
    logit = _logits(model, rows)

    def best(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z, kind="stable")
        z, y = z[order], y[order]
        wrong = np.cumsum(y) + (1 - y).sum() - np.cumsum(1 - y)  # with the threshold just above each
        few = np.flatnonzero(wrong == wrong.min())
        above = np.append(z[1:], z[-1] + 1)
        i = few[(above - z)[few].argmax()]
        return float((z[i] + above[i]) / 2)

    every = best(logit, toxic)
    for k in range(len(LANGUAGES)):
        mine = language == k
        enough = mine.any() and min(toxic[mine].sum(), (1 - toxic[mine]).sum()) >= least
        model.threshold[k] = best(logit[mine], toxic[mine]) if enough else every


def _as_buckets(batches):
    for batch in batches:
        x, first, language = word_buckets(batch["text"])
        raw = [x[a:b].astype("<u2").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.record_batch({"x": pa.array(raw, pa.binary()), "language": pa.array(language, pa.int32()), "toxic": batch["toxic"].cast(pa.int32())})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, class_bytes: int = 32 << 20, text_bytes: int = 256 << 10) -> Model:
    """A model from the documents that have a label in labels (doc_id, toxic)."""
    known = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(1).unionAll(pick(0))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows
    size = F.octet_length(F.coalesce("text", F.lit("")))
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.withColumn("size", size).where(F.col("size") <= text_bytes).withColumn("upto", upto).where(F.col("upto") <= class_bytes)
    got = sample.select("text", "toxic").mapInArrow(_as_buckets, "x binary, language int, toxic int").orderBy("x", "toxic").collect()
    return train([np.frombuffer(r.x, "<u2").reshape(-1, 1 + len(BEGINNINGS)) for r in got], np.array([r.toxic for r in got], np.int64), np.array([r.language for r in got], np.int64))


def _score(model):
    def score(batches):
        m = model.value
        for whole in batches:
            step = max(1, int(whole.num_rows * (2 << 20) / max(1, whole.nbytes)))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x, first, language = word_buckets(batch["text"])
                yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(m.score(x, first, language), pa.float64())})

    return score


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text); 0.5 and over is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: some MB
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), "doc_id long, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(~held_out()))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
