"""Near-duplicate embeddings by NN-descent on bit sketches, with exact threshold links."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenforge.llm.common import discard, materialise, ship_package
from lumenforge.llm.components import connected_components

THRESHOLD = 0.9
SKETCH_WORDS = 4
#: Neighbours a vector keeps while the graph is refined, orders that seed it, and neighbours taken in each order.
NEIGHBOURS, ORDERS, STEP = 8, 24, 2
ROUNDS = 2
#: Neighbours taken in each order of a sweep, chance that a pair at the threshold shares no order's prefix, and sweeps before giving up.
SWEEP_STEP, SEED_MISS, SWEEPS = 4, 0.01, 12
#: Vectors compared at once when a saturated neighbourhood is filled, linked vectors that audit recall, and those without a link for each of them.
BLOCK, AUDIT, AUDIT_ALONE, AUDIT_RECALL = 512, 256, 4, 0.99
SEED = 3


def _matrix(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).normal(size=(dim, 64 * SKETCH_WORDS))


def bit_limit(threshold: float) -> int:
    """Differing sketch bits that a pair at the threshold stays under, but for a chance of one in a billion (six deviations)."""
    n = 64 * SKETCH_WORDS
    p = math.acos(threshold) / math.pi
    return min(n, math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p))))


def orders_for(bits: int, threshold: float) -> int:
    """Orders in which a pair at the threshold shares a prefix of ``bits`` bits at least once, but for a chance of SEED_MISS."""
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return ORDERS if shared >= 1 else max(ORDERS, math.ceil(math.log(SEED_MISS) / math.log1p(-shared)))


def _sketched(orders: int, round_no: int):
    """Adds the sketch's words and, for each order, a code of 32 sketch bits chosen at random."""
    rng = np.random.default_rng(1000 + 97 * round_no)
    chosen = [rng.permutation(64 * SKETCH_WORDS)[:32] for _ in range(orders)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mats: dict[int, np.ndarray] = {}
        for b in batches:
            words = np.zeros((len(b), SKETCH_WORDS), np.int64)
            codes = np.zeros((len(b), orders), np.int64)
            sizes = np.array([len(v) for v in b["vec"]])
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                m = mats.setdefault(d, _matrix(d))
                x = np.stack([np.asarray(b["vec"].iloc[i], float) for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)  # huge components stay finite
                bits = x @ m > 0
                words[at] = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                for t, c in enumerate(chosen):
                    codes[at, t] = bits[:, c] @ (1 << np.arange(32, dtype=np.int64))
            yield pd.DataFrame({"rep": b["rep"], **{f"s{k}": words[:, k] for k in range(SKETCH_WORDS)}, "codes": list(codes)})

    return run


_WORDS = [f"s{k}" for k in range(SKETCH_WORDS)]


def _differ(a: str, b: str) -> Column:
    """Differing bits of two sketch structs."""
    out = F.lit(0)
    for w in _WORDS:
        out = out + F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    return out.cast("int")


def _neighbours(step: int):
    """Pairs of rows at most ``step`` apart, of rows that arrive sorted by order and code."""
    names = ["rep", *_WORDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            rows = b if last is None else pd.concat([last, b], ignore_index=True)
            new = 0 if last is None else len(last)
            last = rows.tail(step)
            order, values = rows["order"].to_numpy(), rows[names].to_numpy(np.int64)
            out = []
            for k in range(1, step + 1):
                j = np.arange(max(k, new), len(rows))
                j = j[order[j] == order[j - k]]
                out.append(np.hstack([values[j - k], values[j]]))
            yield pd.DataFrame(np.concatenate(out), columns=[f"{x}_{n}" for x in "ab" for n in names])

    return run


def _seeds(sketches: DataFrame, step: int = STEP) -> DataFrame:
    """(u, v, su, sv): vectors near each other in one of the orders.

    Orders are dealt to tasks by range, so copies with one code spread over many; the few pairs across a task's border are left to other orders.
    """
    rows = sketches.select("rep", *_WORDS, F.posexplode("codes").alias("order", "code"))
    rows = rows.repartitionByRange("order", "code", "rep").sortWithinPartitions("order", "code", "rep")
    fields = ", ".join(f"{x}_{n} long" for x in "ab" for n in ["rep", *_WORDS])
    pairs = rows.select("order", "rep", *_WORDS).mapInPandas(_neighbours(step), fields)
    return pairs.select(F.col("a_rep").alias("u"), F.col("b_rep").alias("v"), *(F.struct(*(F.col(f"{x}_{w}").alias(w) for w in _WORDS)).alias(y) for x, y in (("a", "su"), ("b", "sv"))))


def _best(pairs: DataFrame, limit: int = 0) -> DataFrame:
    """The nearest of each vector, of pairs taken in both directions: (u, v, su, sv, d, rank, room).

    A list has room for NEIGHBOURS, or for ``room`` where that comes with the pairs. A list that is saturated, that is full to the last place with vectors
    within ``limit`` bits, gets twice the room for the next round.
    """
    if "room" not in pairs.columns:
        pairs = pairs.withColumn("room", F.lit(NEIGHBOURS))
    turned = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("sv").alias("su"), F.col("su").alias("sv"), F.lit(NEIGHBOURS).alias("room"))
    both = pairs.select("u", "v", "su", "sv", "room").union(turned).withColumn("d", _differ("su", "sv"))
    both = both.groupBy("u", "v").agg(F.first("su").alias("su"), F.first("sv").alias("sv"), F.first("d").alias("d"), F.max("room").alias("room"))
    mine = Window.partitionBy("u")
    kept = both.withColumn("rank", F.row_number().over(mine.orderBy("d", "v"))).withColumn("room", F.max("room").over(mine)).where(F.col("rank") <= F.col("room"))
    full = (F.count("*").over(mine) == F.col("room")) & (F.max("d").over(mine) <= limit)
    return kept.withColumn("room", F.when(full, 2 * F.col("room")).otherwise(F.col("room")))


def _descend(graph: DataFrame, limit: int) -> DataFrame:
    """One round: the nearest neighbours of all neighbours compete for the lists."""
    hop = graph.where(F.col("rank") <= NEIGHBOURS).select(F.col("u").alias("m"), F.col("v").alias("w"), F.col("sv").alias("sw"))
    far = graph.select("u", "v", "su", "room").join(hop, F.col("v") == F.col("m")).where("u != w").select("u", F.col("w").alias("v"), "su", F.col("sw").alias("sv"), "room")
    return _best(graph.select("u", "v", "su", "sv", "room").union(far), limit)


def _apart(pairs: DataFrame, comp: DataFrame, limit: int) -> DataFrame:
    """Pairs of different components whose sketches do not rule a link out."""
    own = comp.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    pairs = pairs.where((F.col("u") != F.col("v")) & (_differ("su", "sv") <= limit))
    pairs = pairs.join(own, "u", "left").join(own.toDF("v", "cv"), "v", "left")
    return pairs.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v", "su", "sv")


def _swept(sketches: DataFrame, graph: DataFrame, comp: DataFrame, limit: int) -> list[DataFrame]:
    """Pairs (u, v, su, sv) between components, from fresh orders and then through ``graph``.

    All of them are to be checked; only the nearest of each vector lead on.
    """
    found = [materialise(_apart(_seeds(sketches, SWEEP_STEP), comp, limit), "nn-far")]
    hop = graph.where(F.col("d") <= limit).select(F.col("u").alias("m"), F.col("v").alias("w"), F.col("sv").alias("sw"))
    for _ in range(ROUNDS):
        step = _best(found[-1]).join(hop, F.col("v") == F.col("m")).select("u", F.col("w").alias("v"), "su", F.col("sw").alias("sv"))
        found.append(materialise(_apart(step, comp, limit), "nn-far"))
    return found


def _scaled(vectors) -> np.ndarray:
    """Rows divided by their largest component, so that huge ones stay finite."""
    x = np.stack([np.asarray(v, float) for v in vectors])
    return x / np.abs(x).max(axis=1, keepdims=True)


def _balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of at most BLOCK vectors of one component, of rows sorted by component and code, with centre and largest angle to it."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    seq, rest = 0, None

    def made(rows: pd.DataFrame, number: int) -> tuple:
        x = _scaled(rows["vec"])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        centre = unit.sum(axis=0)
        size = np.linalg.norm(centre)
        angle = float(np.arccos(np.clip(unit @ (centre / size), -1, 1)).max()) if size > 1e-9 else math.pi
        return int(rows["component"].iloc[0]), (part << 32) + number, int(rows["copies"].sum()), rows["rep"].tolist(), rows["copies"].tolist(), x.tobytes(), (centre / max(size, 1e-9)).tolist(), angle

    names = ["component", "block", "total", "reps", "copies", "body", "centre", "angle"]
    for b in batches:
        rows = b if rest is None else pd.concat([rest, b], ignore_index=True)
        component = rows["component"].to_numpy()
        begins = np.concatenate(([0], np.flatnonzero(component[1:] != component[:-1]) + 1))
        cuts = [c for i, z in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)], strict=True) for c in range(i, z, BLOCK)]
        out = []
        for i, z in zip(cuts, cuts[1:], strict=False):
            out.append(made(rows.iloc[i:z], seq))
            seq += 1
        rest = rows.iloc[cuts[-1] :] if len(rows) else None
        if out:
            yield pd.DataFrame(out, columns=names)
    if rest is not None and len(rest):
        yield pd.DataFrame([made(rest, seq)], columns=names)


def _compared(threshold: float):
    """Links between two blocks, counted for every vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                x, y = (np.frombuffer(body).reshape(len(reps), -1) for body, reps in ((r.body_i, r.reps_i), (r.body_j, r.reps_j)))
                norm = [np.sqrt((z * z).sum(axis=1)) for z in (x, y)]
                near = (x @ y.T) / np.outer(*norm) >= threshold
                if r.i == r.j:
                    np.fill_diagonal(near, False)
                out = [pd.DataFrame({"rep": r.reps_i, "links": near @ np.asarray(r.copies_j)})]
                if r.i != r.j:
                    out.append(pd.DataFrame({"rep": r.reps_j, "links": near.T @ np.asarray(r.copies_i)}))
                yield pd.concat(out)

    return run


def _counted(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): how many vectors each member links with, all of them in its own component.

    Blocks of like vectors have a centre and the largest angle to it. Two blocks further apart than the link's angle and theirs hold no link; where
    the link's angle takes in both whole, all pairs are links; only the others are compared, vector by vector.
    """
    rows = members.repartitionByRange("component", "code", "rep").sortWithinPartitions("component", "code", "rep")
    fields = "component long, block long, total long, reps array<long>, copies array<long>, body binary, centre array<double>, angle double"
    balls = materialise(rows.select("component", "rep", "copies", "vec").mapInPandas(_balls, fields), "nn-blocks")
    sides = [balls.select("component", F.col("block").alias(x), F.col("total").alias(f"total_{x}"), F.col("centre").alias(f"centre_{x}"), F.col("angle").alias(f"angle_{x}")) for x in "ij"]
    met = sides[0].join(sides[1], "component").where("i <= j")
    dot = F.aggregate(F.zip_with("centre_i", "centre_j", lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    apart = F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    reach, link = F.col("angle_i") + F.col("angle_j"), math.acos(threshold)
    met = met.select("i", "j", "total_i", "total_j", apart.alias("apart"), reach.alias("reach")).where(F.col("apart") - F.col("reach") <= link + 1e-6)
    met = materialise(met.withColumn("whole", F.col("apart") + F.col("reach") <= link - 1e-6), "nn-met")

    whole = met.where("whole")
    whole = whole.select(F.col("i").alias("block"), F.col("total_j").alias("links")).union(whole.where("i != j").select("j", "total_i")).groupBy("block").agg(F.sum("links").alias("links"))
    # a vector does not link with itself: its own copies are counted by the caller
    taken = balls.join(whole, "block").select(F.explode(F.arrays_zip("reps", "copies")).alias("z"), "links", "block")
    own = met.where("whole and i = j").select(F.col("i").alias("block"), F.lit(1).alias("own"))
    taken = taken.join(own, "block", "left").select(F.col("z.reps").alias("rep"), (F.col("links") - F.when(F.col("own") == 1, F.col("z.copies")).otherwise(0)).alias("links"))

    packed = [balls.select(F.col("block").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("reps", "copies", "body"))) for x in "ij"]
    pairs = met.where("not whole").select("i", "j").join(packed[0], "i").join(packed[1], "j")
    counted = pairs.mapInPandas(_compared(threshold), "rep long, links long")
    return counted.union(taken).groupBy("rep").agg(F.sum("links").alias("links"))


def _cosine(a: str, b: str) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def unit(x):  # scaled by the largest component
        return F.transform(x, lambda v: v / F.array_max(F.transform(x, F.abs)))

    x, y = unit(F.col(a)), unit(F.col(b))
    return F.when(F.size(a) == F.size(b), dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)))


def near_duplicate_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id, kept of every row; links are pairs with a cosine of at least ``threshold``, in double.

    Equal vectors are one class. Lists of neighbours are seeded from random orders of 256-bit
    sketches and refined through joins with neighbours' neighbours; edges under the sketch's bound of the threshold are checked
    on the vectors, and kept edges make components. A list that is saturated with close vectors gets twice the room in the next round; a large group's
    lists still cannot hold all of its links. So sweeps follow, with
    fresh orders, that check every pair of different components the sketches do not rule out, however many a vector has. They go on until one finds no link between components and the audit meets AUDIT_RECALL; if SWEEPS of them do not
    get there, an error is raised. The number of orders grows with the table. The vectors of a component are compared by
    blocks, so every link within it counts; links that no path of found edges joins are missed.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of different sizes do
    not link. Repeated ids count as vectors of their own; the smallest id of a component, null last, names it. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"))
    sound = F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.withColumn("vec", F.when(sound, F.transform("vec", lambda v: v + 0.0)))
    grouped = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    classes = materialise(grouped.select(F.xxhash64("low", "vec").alias("rep"), "low", "copies", "vec"), "nn-classes")
    n = classes.count()
    bits = max(4, min(24, math.ceil(math.log2(max(2, n))) - 3))
    limit = bit_limit(threshold)

    sketch_fields = "rep long, " + ", ".join(f"{w} long" for w in _WORDS) + ", codes array<long>"
    only = classes.select("rep", "vec")
    orders = orders_for(bits, threshold)

    def sketched(turn: int) -> DataFrame:
        return materialise(only.mapInPandas(_sketched(orders, turn), sketch_fields), "nn-sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        close = pairs.where(_differ("su", "sv") <= limit).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        va, vb = (only.select(F.col("rep").alias(x), F.col("vec").alias(f"v{x}")) for x in "ab")
        return materialise(close.join(va, "a").join(vb, "b").where(_cosine("va", "vb") >= threshold).select("a", "b"), "nn-links")

    sketches = sketched(0)
    graph = materialise(_best(_seeds(sketches), limit), "nn-graph")
    for _ in range(ROUNDS):
        nxt = materialise(_descend(graph, limit), "nn-graph")
        discard(graph)
        graph = nxt
    last = sketches
    comp = materialise(connected_components(verified(graph)), "nn-components")
    recall = 0.0
    for turn in range(1, 1 + SWEEPS):
        sketches = sketched(turn)
        far = _swept(sketches, graph, comp, limit)
        links = verified(reduce(DataFrame.union, far))
        for x in far:
            discard(x)
        discard(last)
        last = sketches
        # the stars of the components stand for the links found before
        joined = links.count()
        if joined:
            stars = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = materialise(connected_components(stars.union(links)), "nn-components")
        elif (recall := _audited(classes, comp, threshold)) >= AUDIT_RECALL:
            break
    else:
        recall = _audited(classes, comp, threshold)
        if recall < AUDIT_RECALL:
            raise RuntimeError(f"{recall:.4f} of links found after {SWEEPS} sweeps, less than {AUDIT_RECALL}")
    print(f"near_duplicate_embeddings: {n} vectors, {orders} orders, {turn} sweeps, audited recall {recall:.4f}", file=sys.stderr)

    codes = last.select(F.col("rep").alias("coded"), F.col("codes")[0].alias("code"))
    members = classes.join(comp, classes.rep == comp.node).select("rep", "component", "copies", "vec")
    counted = _counted(members.join(codes, members.rep == codes.coded).drop("coded"), threshold)

    lows = classes.join(comp, classes.rep == comp.node).groupBy("component").agg(F.min("low").alias("component_low"))
    named = classes.join(comp, classes.rep == comp.node, "left").join(lows, "component", "left").join(counted, "rep", "left")
    named = named.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_low", "low").alias("component_id"))
    linked = rows.where("vec is not null").join(named, "vec").select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _audited(classes: DataFrame, comp: DataFrame, threshold: float) -> float:
    """The estimated share of links that lie within a component, a mean over vectors that have links.

    AUDIT vectors in a component and AUDIT_ALONE times as many outside of any are compared with all vectors; those outside stand
    for all that were left out, so a missed pair weighs as much as it would in the whole table.
    """
    placed = classes.join(comp, classes.rep == comp.node, "left").select("rep", "vec", "component")
    size = {True: comp.count()}
    size[False] = classes.count() - size[True]
    asked = []
    for linked, most in ((True, AUDIT), (False, AUDIT * AUDIT_ALONE)):
        part = placed.where(F.col("component").isNotNull() == linked)
        asked += part.orderBy(F.xxhash64(F.lit(7), "rep"), "rep").limit(most).collect()
    if not asked:
        return 1.0
    queries = [(r[0], np.asarray(r[1], float)) for r in asked]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            x = [np.asarray(v, float) for v in b["vec"]]
            rep, component = b["rep"].to_numpy(), b["home"].to_numpy()
            for d in {len(v) for v in x}:
                at = np.array([i for i, v in enumerate(x) if len(v) == d])
                mine = np.stack([x[i] / np.abs(x[i]).max() for i in at])
                mine /= np.linalg.norm(mine, axis=1, keepdims=True)
                own = [(r, q / np.abs(q).max()) for r, q in queries if len(q) == d]
                if own:
                    near = np.stack([q / np.linalg.norm(q) for _, q in own]) @ mine.T >= threshold
                    i, j = np.nonzero(near)
                    asks = np.array([r for r, _ in own], np.int64)[i]
                    other = asks != rep[at[j]]
                    out.append(pd.DataFrame({"q": asks[other], "c": component[at[j]][other]}).groupby(["q", "c"]).size().reset_index(name="n"))
            yield pd.concat(out) if out else pd.DataFrame({"q": [], "c": [], "n": []}, dtype="int64")

    met = placed.select("rep", "vec", F.coalesce("component", "rep").alias("home")).mapInPandas(run, "q long, c long, n long")
    home = {r["rep"]: r["component"] for r in asked}
    total, found = dict.fromkeys(home, 0), dict.fromkeys(home, 0)
    for q, c, k in met.groupBy("q", "c").agg(F.sum("n")).collect():
        total[q] += k
        found[q] += k * (c == home[q])
    vectors = share = 0.0
    for linked in (True, False):
        mine = [q for q, c in home.items() if (c is not None) == linked]
        scale = size[linked] / max(1, len(mine))
        vectors += scale * sum(total[q] > 0 for q in mine)
        share += scale * sum(found[q] / total[q] for q in mine if total[q])
    return share / vectors if vectors else 1.0
