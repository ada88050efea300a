"""Vector code compression: product codes whose nearest entries are found behind segment-mean lower bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.llm.common import materialise, ship_package

#: Vectors looked at together.
BLOCK = 4096
#: A label with more than one in SPREAD of all rows gets its sum by broadcast: there are at most SPREAD of them.
SPREAD = 1000


class Bounds:
    """Lower bounds of squared distances to the entries of one codebook, by means of ever shorter blocks and the norms of what they leave.

    Over a block of b components, |x - c|^2 is at least b (mean x - mean c)^2, and the residuals differ by at least the difference of their
    norms. Norms are floating point; a margin beyond their error keeps every bound below the distance.
    """

    def __init__(self, entries: np.ndarray):
        self.entries, d = entries, entries.shape[1]
        self.widths = [w for w in (d, -(-d // 2), -(-d // 4)) if w > 1] if d > 1 else []
        self.widths = list(dict.fromkeys(self.widths))
        self.of_entries = [self._reduced(entries, w) for w in self.widths]

    @staticmethod
    def _reduced(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Block sums over the square root of their length, and the norm of the residual."""
        cuts = np.arange(0, x.shape[1], width)
        lengths = np.diff(np.r_[cuts, x.shape[1]])
        means = np.add.reduceat(x, cuts, axis=1) / np.sqrt(lengths)
        squares = (x.astype(float) ** 2).sum(axis=1)
        return means, np.sqrt(np.maximum(squares - (means**2).sum(axis=1), 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, ties to the lower index."""
        n, k = len(x), len(self.entries)
        best, at = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        # each residual norm is off by at most the root of its square's error
        scale = (x.astype(float) ** 2).sum(axis=1)[:, None] + (self.entries.astype(float) ** 2).sum(axis=1)[None]
        slack = 1e-6 * scale + 1e-3
        for step, (width, of_entries) in enumerate(zip(self.widths, self.of_entries, strict=True)):
            mean, rest = self._reduced(x, width)
            gap = ((mean[row] - of_entries[0][entry]) ** 2).sum(axis=1) + (rest[row] - of_entries[1][entry]) ** 2
            bound = gap - slack[row, entry]
            if step == 0:  # the entry that looks nearest sets a first distance that others must not exceed
                first = bound.reshape(n, k).argmin(axis=1)
                best, at = ((x - self.entries[first]) ** 2).sum(axis=1), first
            near = bound <= best[row]
            row, entry = row[near], entry[near]
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        # by row, distance and index: the first of each row is its nearest
        order = np.lexsort((entry, exact, row))
        row, entry, exact = row[order], entry[order], exact[order]
        heads = np.flatnonzero(np.r_[True, np.diff(row) != 0]) if len(row) else row
        best[row[heads]], at[row[heads]] = exact[heads], entry[heads]
        return at, best


def _limit(width: int) -> int:
    """Integers are held within this, so that squared distances of whole vectors fit in a long."""
    return int((2.0**62 / max(1, width)) ** 0.5 / 2)


def _integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """One row of integers for each vector, zeros behind shorter ones."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float)
    out = np.zeros((len(vectors), width), np.int64)
    most = _limit(width)
    values = np.clip(np.floor(flat * scale), -most, most).astype(np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _assigned(x: np.ndarray, books: list[Bounds]) -> tuple[np.ndarray, np.ndarray]:
    found = [b.nearest(part) for b, part in zip(books, np.split(x, len(books), axis=1), strict=True)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _part_sums(width: int, scale: int, books: Callable[[], np.ndarray]):
    """For each part and entry the sum of the parts assigned to it, and their number, of a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = books()
        bounds = [Bounds(b) for b in start]
        parts, entries, size = start.shape
        total, number = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for begin in range(0, b.num_rows, BLOCK):
                x = _integers(b.column("v").slice(begin, BLOCK), width, scale)
                code, _ = _assigned(x, bounds)
                for p, part in enumerate(np.split(x, parts, axis=1)):
                    np.add.at(total[p], code[:, p], part)
                    number[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(number)
        yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": number[part, entry], "total": [r.tolist() for r in total[part, entry]]})

    return run


def _codes(width: int, scale: int, books: Callable[[], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [Bounds(b) for b in books()]
        for b in batches:
            for begin in range(0, b.num_rows, BLOCK):
                rows = b.slice(begin, BLOCK)
                code, error = _assigned(_integers(rows.column("v"), width, scale), bounds)
                text = ["".join(f"{e:02x}" for e in r) for r in code.tolist()]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rows.schema.names if c != "v"), pa.array(text), pa.array(error.sum(axis=1))], [*(c for c in rows.schema.names if c != "v"), "code", "error"])

    return run


def _usable(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> tuple[np.ndarray, int]:
    """(codebooks of shape parts x entries x size, width) of ``vectors`` (id, v), all usable."""
    spark = vectors.sparkSession
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = parts * max(1, -(-longest // parts))
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    if not first:
        return np.zeros((parts, 0, width // parts), np.int64), width
    x = _integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width, scale)
    books = x.reshape(len(x), parts, width // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = vectors.select("v").mapInArrow(_part_sums(width, scale, lambda shared=shared: shared.value), "part bigint, entry bigint, n bigint, total array<bigint>")
        summed = sums.groupBy("part", "entry").agg(F.sum("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(width // parts)))).collect()
        books = books.copy()
        for part, entry, n, total in summed:
            books[part, entry] = np.array(total, np.int64) // n
    return books, width


def with_label_sums(rows: DataFrame, label: str, value: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal labels, nulls together. Frequent labels meet their sums by broadcast, so that no task gets all their rows."""
    sums = materialise(rows.groupBy(F.col(label).alias("_l")).agg(F.sum(value).alias(into), F.count("*").alias("_n")), "label-sums")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    often = F.broadcast(sums.where(F.col("_n") * SPREAD >= total).drop("_n"))
    met = rows.join(often, rows[label].eqNullSafe(often["_l"]), "left")
    seldom = sums.where(F.col("_n") * SPREAD < total).drop("_n")
    rest = met.where(F.col(into).isNull()).drop("_l", into)
    return met.where(F.col(into).isNotNull()).drop("_l").unionByName(rest.join(seldom, rest[label].eqNullSafe(seldom["_l"])).drop("_l"))


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every vector of finite components.

    Components become integers floor(scale * x), vectors ``parts`` equal parts, each with a codebook that starts as that part of the rows of
    the smallest ids. A round assigns parts to their nearest entries (ties to the lower index) and moves entries to floor(sum / count);
    entries of nothing stay. Tasks send one sum for each part and entry, so only ``parts * entries`` rows reach the driver.

    Rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors end in zeros, up to the longest one's
    length, itself rounded up to a multiple of ``parts``. Null ids come last, rows of one id are ordered by their vectors. Integers beyond
    +-sqrt(2^62 / length) / 2 count as that (2^27 for 64 components), so that errors fit in a long. With fewer rows than ``entries`` the
    codebooks are shorter. Empty input gives no rows; further columns are not returned.
    """
    ship_package(vectors.sparkSession)
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    own = vectors.where(_usable(F.col(vector_col))).select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    books, width = fit(own, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    shared = own.sparkSession.sparkContext.broadcast(books)
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("id", "label"))
    coded = materialise(own.mapInArrow(_codes(width, scale, lambda: shared.value), f"{kinds}, code string, error bigint"), "vector-codes")
    out = with_label_sums(coded, "label", "error", "label_error")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql(rounds: int = 6) -> str:
    """The same by plain distances to all entries."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} as materialized (select r, p, e, sum((x - y) * (x - y)) as d from x join c{r} using (p, i) group by r, p, e),
a{r} as materialized (select r, p, arg_min(e, (d, e)) as e, min(d) as d from d{r} group by r, p)""")
        if r < rounds:
            steps.append(f"""c{r + 1} as materialized (select p, e, i, case when n is null then y else (s - ((s % n) + n) % n) // n end as y
from c{r} left join (select p, e, i, sum(x)::bigint as s, count(*) as n from x join a{r} using (r, p) group by p, e, i) m using (p, e, i))""")
    return f"""with v as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, embedding from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select 8 * greatest(1, ((max(len(embedding)) + 7) // 8)) as width from v),
x as materialized (select r, i // (width // 8) as p, i % (width // 8) as i, coalesce(floor(4096 * embedding[i + 1]::double), 0)::bigint as x from (select r, embedding, width, unnest(range(width)) as i from v, w)),
c0 as materialized (select p, r - 1 as e, i, x as y from x where r <= 16),
{", ".join(steps)},
coded as (select r, string_agg(format('{{:02x}}', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by r),
books as (select sha256(string_agg(y::varchar, ',' order by p, e, i)) as codebooks_sha256 from c{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join v using (r), books"""


ORACLE_SQL = oracle_sql()
