"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.common import held_out_column, materialise, ship_package, with_text_columns

#: At most this many labelled rows of each class, of at most MAX_BYTES bytes, train the filters, on their whole texts.
SAMPLE_PER_CLASS = 3000
MAX_BYTES = 1 << 20
#: Of the labelled rows one in CALIBRATE is kept out of the fit and chooses thresholds, together with all that the sample leaves.
CALIBRATE = 5
#: Documents of the sample that a feature must occur in: what occurs in fewer would only be learnt by heart.
LEAST_DOCS = 3
BUCKETS = 1 << 18
DIM, FILTERS, WIDTHS = 12, 10, (1, 2, 3)
UPDATES, EPOCHS, BATCH, BATCH_WORDS, RATE, SEED = 300, 5, 64, 150_000, 0.08, 5
#: Words convolved at once; longer texts go through in overlapping segments.
SEGMENT = 40_000
BINS = 1000
THRESHOLD = 0.7
#: Frequent function words by language, fixed values: the language that calibrates a score is read off the text.
LANGUAGE_WORDS = {
    "en": "the of and to in is that for it with as was on be are this by".split(),
    "de": "der die und den das von zu mit sich des auf für ist im dem nicht ein".split(),
    "fr": "le les des du une est et dans qui par pour sur au pas elle avec ne".split(),
    "es": "el los las del que y con por una para su al lo como se es un".split(),
}
LANGUAGES = [*LANGUAGE_WORDS, "other"]


def _buckets(word: bytes) -> list[int]:
    """A word's hashed features: itself and its first four, five and six bytes."""
    w = word.strip(b".,!?;:\"'()[]*#$%&|-")
    return [xxhash.xxh64_intdigest(bytes([65 + k]) + (w[:k] if k else w)) % BUCKETS for k in (0, 4, 5, 6)]


@dataclass
class TextCnn:
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> TextCnn:
        # unseen buckets stay zero, so that unknown words add nothing
        return cls(
            np.zeros((BUCKETS, DIM), np.float32),
            [rng.normal(0, 0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS],
            [np.full(FILTERS, 0.01, np.float32) for _ in WIDTHS],
            rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
            -1.0,
        )


class Vocabulary(dict):
    """Words met by a task, numbered, with their features; started anew when it is full. Number 0 pads."""

    def __init__(self, model: TextCnn, limit: int = 60_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.votes = {w.encode(): i for i, ws in enumerate(LANGUAGE_WORDS.values()) for w in ws}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.parts: list[list[int]] = [[0, 0, 0, 0]]
        self.language: list[int] = [-1]
        self.ready = np.zeros((1, DIM), np.float32)
        self.spoken = np.full(1, -1)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.parts)
        self.parts.append(_buckets(word))
        self.language.append(self.votes.get(word, -1))
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def vectors(self) -> np.ndarray:
        done = len(self.ready)
        if done < len(self.parts):
            new = self.model.embedding[np.array(self.parts[done:])].sum(axis=1)
            self.ready = np.vstack([self.ready, new])
            self.spoken = np.concatenate([self.spoken, np.array(self.language[done:])])
        return self.ready


PAD = max(WIDTHS) - 1


def _stream(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents with padding before, between and behind them, one more at the end so that every bound is a window; where each begins and ends."""
    gap = np.zeros(PAD, np.int64)
    parts, at, begins, ends = [gap], PAD, [], []
    for d in docs:
        parts += [d, gap]
        begins.append(at)
        ends.append(at + len(d))
        at += len(d) + PAD
    return np.concatenate([*parts, gap[:1]]), np.array(begins), np.array(ends)


def _pooled(model: TextCnn, x: np.ndarray, begins: np.ndarray, ends: np.ndarray, positions: bool = False, head: np.ndarray | bool = True, tail: np.ndarray | bool = True):
    """The largest response of every filter in each document, and where it is. x: vectors of the stream.

    ``head`` and ``tail`` say which pieces begin and end their texts: only there a window reaches into the padding.
    """
    best, where = [], []
    head, tail = (np.broadcast_to(np.asarray(e, np.int64), begins.shape) for e in (head, tail))
    for f, b in zip(model.filters, model.bias, strict=True):
        k = len(f)
        n = len(x) - k + 1
        resp = x[:n] @ f[0]
        for j in range(1, k):
            resp += x[j : j + n] @ f[j]
        low = begins - (k - 1) * head
        bounds = np.stack([low, np.maximum(ends - (k - 1) * (1 - tail), low + 1)], axis=1).ravel()
        if positions:
            at = np.stack([a + resp[a:z].argmax(axis=0) for a, z in bounds.reshape(-1, 2)])
            where.append(at)
            best.append(np.take_along_axis(resp, at, axis=0) + b)
        else:
            best.append(np.maximum.reduceat(resp, np.minimum(bounds, n - 1), axis=0)[::2] + b)
    return np.hstack(best), where


def _batches(order: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Groups of at most BATCH documents and, but for a single longer one, BATCH_WORDS words."""
    begin, size = 0, 0
    for i, j in enumerate(order.tolist()):
        if i > begin and (i - begin == BATCH or size + len(docs[j]) > BATCH_WORDS):
            yield order[begin:i]
            begin, size = i, 0
        size += len(docs[j])
    if len(order):
        yield order[begin:]


def train(texts: list[str], labels: list[int], seed: int = SEED) -> TextCnn:
    """Fit by Adagrad on the log loss, classes weighted alike; gradients reach only the pooled windows."""
    rng = np.random.default_rng(seed)
    model = TextCnn.fresh(rng)
    vocabulary = Vocabulary(model, limit=1 << 40)
    docs = [vocabulary.numbers((t or "").encode("utf-8", "surrogatepass").lower().split()) for t in texts]
    parts = np.array(vocabulary.parts)
    known = np.zeros(BUCKETS, np.int64)
    for d in docs:
        known[np.unique(parts[d])] += 1
    known = known >= LEAST_DOCS
    known[parts[0]] = False
    y = np.array(labels, np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    seen_e = np.full(BUCKETS, 1e-6, np.float32)
    seen_f = [np.full_like(f, 1e-3) for f in model.filters]
    seen_b = [np.full_like(b, 1e-3) for b in model.bias]
    seen_o, seen_c = np.full_like(model.out, 1e-3), 1e-3
    epochs = max(EPOCHS, -(-UPDATES * BATCH // max(1, len(docs))))  # small samples are gone through more often
    for epoch in range(epochs):
        rate = RATE / (1 + epoch * 2 / epochs)
        for pick in _batches(rng.permutation(len(docs)), docs):
            stream, begins, ends = _stream([docs[j] for j in pick])
            vec = model.embedding[parts[stream]].sum(axis=1)
            vec[stream == 0] = 0
            top, where = _pooled(model, vec, begins, ends, positions=True)
            h = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.offset, -30, 30)))
            g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dh = g[:, None] * model.out * (top > 0)
            d_out = h.T @ g + 1e-4 * model.out
            rows, grads = [], []
            for k, f in enumerate(model.filters):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                df = np.empty_like(f)
                for j in range(len(f)):
                    at = where[k] + j
                    df[j] = np.einsum("bfd,bf->df", vec[at], d)
                    rows.append(stream[at].ravel())
                    grads.append((d[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                df += 1e-4 * f
                seen_f[k] += df * df
                model.filters[k] = f - rate * df / np.sqrt(seen_f[k])
                db = d.sum(axis=0)
                seen_b[k] += db * db
                model.bias[k] = model.bias[k] - rate * db / np.sqrt(seen_b[k])
            seen_o += d_out * d_out
            model.out = model.out - rate * d_out / np.sqrt(seen_o)
            seen_c += float(g.sum()) ** 2
            model.offset -= rate * float(g.sum()) / seen_c**0.5
            row, grad = np.concatenate(rows), np.vstack(grads)
            real = (row != 0) & (np.abs(grad).max(axis=1) > 0)
            touched, owner = parts[row[real]].ravel(), np.repeat(np.flatnonzero(real), parts.shape[1])
            touched, owner = touched[known[touched]], owner[known[touched]]
            where_e, inverse = np.unique(touched, return_inverse=True)
            de = np.zeros((len(where_e), DIM), np.float32)
            np.add.at(de, inverse.ravel(), grad[owner])
            seen_e[where_e] += (de * de).mean(axis=1)
            model.embedding[where_e] -= rate * de / np.sqrt(seen_e[where_e])[:, None]
    return model


def _raw(model: TextCnn, batches: Iterator[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The classifier's probabilities and the languages read off the texts, of each batch."""
    vocabulary = Vocabulary(model)
    for b in batches:
        top = np.full((len(b), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        votes = np.zeros((len(b), len(LANGUAGE_WORDS)), np.int64)
        docs, owners, edges, size = [], [], [], 0

        def convolve(docs, owners, edges, top=top, votes=votes):
            stream, begins, ends = _stream(docs)
            vec = vocabulary.vectors()[stream]
            head, tail = np.array(edges).T
            got, _ = _pooled(model, vec, begins, ends, head=head, tail=tail)
            np.maximum.at(top, owners, got)
            spoken = vocabulary.spoken[stream]
            own = np.minimum(ends, begins + SEGMENT)  # the words behind belong to the next piece as well
            cells = np.repeat(np.array(owners), own - begins)
            inside = np.concatenate([np.arange(a, z) for a, z in zip(begins, own, strict=True)])
            lang = spoken[inside]
            np.add.at(votes, (cells[lang >= 0], lang[lang >= 0]), 1)

        for i, x in enumerate(b):
            words = (x or "").encode("utf-8", "surrogatepass").lower().split()
            for s in range(0, max(1, len(words)), SEGMENT):
                docs.append(vocabulary.numbers(words[s : s + SEGMENT + PAD]))
                owners.append(i)
                edges.append((s == 0, s + SEGMENT + PAD >= len(words)))
                size += len(docs[-1])
                if size >= SEGMENT:
                    convolve(docs, owners, edges)
                    docs, owners, edges, size = [], [], [], 0
                    if len(vocabulary) > vocabulary.limit:
                        vocabulary.reset()
        if docs:
            convolve(docs, owners, edges)
        logit = np.maximum(top, 0) @ model.out + model.offset
        language = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(LANGUAGE_WORDS))
        yield 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(float))), language.astype(np.int32)


def choose_threshold(negatives: np.ndarray, positives: np.ndarray) -> float:
    """The bin edge with the best F1, in the middle of the best stretch; 0.5 without positives."""
    if positives.sum() == 0 or negatives.sum() == 0:
        return 0.5
    hit = positives[::-1].cumsum()[::-1]
    false = negatives[::-1].cumsum()[::-1]
    f1 = 2 * hit / (hit + false + positives.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(np.clip((best[0] + best[-1]) / 2 / BINS, 0.02, 0.98))


def scored_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns, or those of ``keep``, as _0, _1, ...; the id among them) with ``score``: texts are never shuffled. See ``classify``."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    y = y.where(~held_out_column(F.col("id"), 3, 1))
    # the sample is chosen by id and length before any text moves
    short = rows.select("id", F.octet_length("x").alias("n")).where(F.coalesce("n", F.lit(0)) <= MAX_BYTES)
    ids = short.join(y, "id").groupBy("id").agg(F.first("y").alias("y")).withColumn("h", F.xxhash64(F.lit(SEED), "id")).where(F.pmod("h", F.lit(CALIBRATE)) != 0)
    chosen = [r for v in (0, 1) for r in ids.where(F.col("y") == v).orderBy("h", "id").limit(SAMPLE_PER_CLASS).select("id", "y").collect()]
    picked = spark.createDataFrame([(r[0],) for r in chosen], f"id {kind}")
    said = {r[0]: r[1] for r in chosen}
    # of an id with several texts one trains, so that no more texts reach the driver than were chosen
    texts = rows.where(F.coalesce(F.octet_length("x"), F.lit(0)) <= MAX_BYTES).withColumn("x", F.coalesce("x", F.lit(""))).join(F.broadcast(picked), "id")
    sample = sorted((r[0], r[1], said[r[0]]) for r in texts.groupBy("id").agg(F.min("x")).collect())
    model = train([r[1] for r in sample], [r[2] for r in sample]) if sample else TextCnn.fresh(np.random.default_rng(SEED))
    shared = spark.sparkContext.broadcast(model)

    scored = materialise(with_text_columns(docs, text_col, "p double, language int", lambda texts: _raw(shared.value, texts), keep), "toxicity-raw")
    own = scored.select(F.col(f"_{(keep or docs.columns).index(id_col)}").alias("id"), "p", "language")
    bins = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int")
    kept_out = own.join(F.broadcast(picked), "id", "left_anti").join(y, "id")
    counts = kept_out.groupBy("language", bins.alias("bin"), "y").count().collect()
    table = np.zeros((2, len(LANGUAGES), BINS))
    for language, b, v, n in counts:
        table[int(v > 0), language, b] += n
    overall = choose_threshold(*table.sum(axis=1))
    enough = table[1].sum(axis=1) >= 20
    t = F.element_at(F.array(*(F.lit(choose_threshold(*table[:, i]) if enough[i] else overall) for i in range(len(LANGUAGES)))), F.col("language") + 1)
    # stretch probabilities so that the language's own threshold becomes THRESHOLD
    p = F.col("p")
    score = F.when(p < t, THRESHOLD * p / t).otherwise(THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t))
    return scored.withColumn("score", score).drop("p", "language")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row, from the whole text alone.

    Labels are learnt from rows whose crc32 of the id mod 3 is not 1: filters from a bounded sample
    (SAMPLE_PER_CLASS rows a class, of at most MAX_BYTES bytes, whole texts), thresholds of every language
    from all labelled rows that the filters did not see, one in CALIBRATE at least. The language is read off the text's function words. Scores are stretched so that the
    language's threshold is 0.7. Null text counts as empty and gets the score of a text without words; repeated ids are each scored;
    null ids never train. Without labels of both classes the untrained filters score near 0.27. Empty input gives no rows.
    """
    out = scored_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("x")), labels.withColumnRenamed(id_col, "id"), label_col, "id", "x", ["id"])
    held = F.coalesce(held_out_column(F.col("_0"), 3, 1), F.lit(False))
    return out.select(F.col("_0").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
