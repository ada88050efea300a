"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.common import held_out_column, materialise, ship_package, with_text_columns

N_STATS = 24
COMPONENTS = 320
RIDGE = 1e-3
BINS = 2000
SEED = 9
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\/=+_`", np.uint8)


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; all finite, for empty text too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    count = Counter(words)
    lines = raw.split(b"\n")
    lengths = list(map(len, words))
    upper, lower, digits = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[48:58].sum())
    other = int(byte[128:].sum())
    letters = max(1, upper + lower + other)
    p = byte[byte > 0] / size
    top = max(count.values(), default=0)
    return np.array(
        [
            math.log1p(len(raw)),
            math.log1p(n),
            sum(lengths) / max(1, n),
            math.log1p(max(lengths, default=0)),
            len(count) / max(1, n),
            math.log1p(len(count)) / math.log1p(n) if n else 1.0,
            top / max(1, n),
            sum(map(eq, words, words[1:])) / max(1, n),
            upper / letters,
            digits / size,
            int(byte[32]) / size,
            int(byte[46] + byte[44] + byte[59] + byte[58]) / size,
            int(byte[33] + byte[63]) / size,
            int(byte[124]) / size,
            int(byte[_SYMBOLS].sum()) / size,
            other / size,
            int(byte[34] + byte[39] + byte[40] + byte[41]) / size,
            math.log1p(len(lines)),
            1 - len(set(lines)) / len(lines),
            math.log1p(len(raw) / len(lines)),
            sum(x[-1:] in b".!?:" and x != b"" for x in lines) / len(lines),
            float(-(p * np.log(p)).sum()) if len(p) else 0.0,
            math.sqrt(int(byte[_SYMBOLS].sum()) / size),
            math.sqrt(int(byte[124]) / size),
        ]
    )


def _statistics(batches: Iterator[list[str | None]]) -> Iterator[tuple[list[list[float]]]]:
    for texts in batches:
        yield ([statistics(x).tolist() for x in texts],)


class FourierRidge:
    """Standardised statistics, cosine features of a Gaussian kernel, linear weights, monotone calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, components: int = COMPONENTS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        d = len(mean)
        self.w = rng.normal(size=(d, components)) / math.sqrt(d)
        self.b = rng.uniform(0, 2 * math.pi, components)
        self.weights = np.zeros(components + d + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), z / 10, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # a thousandth of the score keeps the order inside flat calibrated stretches
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and non-decreasing means of the pooled blocks, x ascending."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _equations(model: FourierRidge):
    """One row of summed normal equations for each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                f = model.features(np.stack(b["stats"].to_numpy()))
                y = b["y"].to_numpy(float)
                part = np.vstack([f.T @ f, f.T @ y])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"sums": [total.ravel().tobytes()]})

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for b in batches:
        for body in b["sums"]:
            part = np.frombuffer(body, float)
            total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"sums": [total.tobytes()]})


def fit(stats: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id") -> FourierRidge:
    """Fit on every labelled row of ``stats`` (id, stats) that is not held out (crc32 of the id mod 3 is 1).

    Labels of one id are averaged; null labels and ids are left out. Without labelled rows every score is that of label 1's prior, 0.5.
    """
    each = [f for i in range(N_STATS) for f in (F.avg(F.col("stats")[i]), F.stddev_pop(F.col("stats")[i]))]
    found = stats.agg(*(f.alias(f"m{i}") for i, f in enumerate(each))).first()
    mean, scale = np.zeros(N_STATS), np.ones(N_STATS)
    for i in range(N_STATS):
        m, s = found[2 * i], found[2 * i + 1]
        if m is not None:
            mean[i], scale[i] = m, s if s > 1e-9 else 1.0
    model = FourierRidge(mean, scale)
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    train = materialise(stats.join(y, "id").where(~held_out_column(F.col("id"), 3, 1)).select("stats", "y"), "quality-train")
    # partial sums are added up in a few tasks that stream them, then on the driver
    parts = train.mapInPandas(_equations(model), "sums binary").repartition(4).mapInPandas(_summed, "sums binary").collect()
    if not parts:
        model.weights[-1] = 0.5
        return model
    total = sum(np.frombuffer(bytes(p[0]), float) for p in parts).reshape(-1, len(model.weights))
    n = total[len(model.weights) - 1, -1]
    model.weights = np.linalg.solve(total[:-1] + RIDGE * n * np.eye(len(model.weights)) / len(model.weights), total[-1])

    def raw(batches):
        for b in batches:
            yield pd.DataFrame({"bin": np.clip(np.floor((model.raw(np.stack(b["stats"].to_numpy())) + 1) * BINS / 3), 0, BINS).astype(int), "y": b["y"]}) if len(b) else pd.DataFrame({"bin": [], "y": []})

    bins = train.mapInPandas(raw, "bin int, y double").groupBy("bin").agg(F.avg("y"), F.count("*")).orderBy("bin").collect()
    a = np.array(bins, float)
    model.knots = isotonic((a[:, 0] + 0.5) * 3 / BINS - 1, a[:, 1], a[:, 2])
    return model


def scored_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (its columns as _0, _1, ...) with ``score``: texts are read once and never shuffled. See ``classify``."""
    ship_package(docs.sparkSession)
    stats = materialise(with_text_columns(docs, text_col, "stats array<double>", _statistics), "quality-stats")
    model = fit(stats.select(F.col(f"_{docs.columns.index(id_col)}").alias("id"), "stats"), labels, label_col, id_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("stats").flatten()).reshape(b.num_rows, -1)
                kept = [n for n in b.schema.names if n != "stats"]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(model.score(x))], [*kept, "score"])

    fields = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)), "score double"])
    return stats.mapInArrow(scored, fields)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score, predicted of every row; the score comes from statistics of the whole text alone.

    Null text counts as empty. Repeated ids are each scored, a null id is held out of nothing but never trains.
    Empty input gives no rows; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("x"))
    stats = materialise(with_text_columns(rows, "x", "stats array<double>", _statistics, ["id"]).withColumnRenamed("_0", "id"), "quality-stats")
    model = fit(stats, labels, label_col, id_col)

    def scored(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": model.score(np.stack(b["stats"].to_numpy())) if len(b) else []})

    out = stats.mapInPandas(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    held = F.coalesce(held_out_column(F.col("id"), 3, 1), F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
