"""Embedding near-dedup with a forest of random-projection trees.

Each tree splits its rows again and again at the median of a random projection;
rows near a split go to both sides (spill). Splits are fitted on bounded samples,
round by round: the whole forest is a table of path and median, sent to all tasks,
and one pass routes every vector through all trees. Vectors then meet in leaves,
once, where cosines in double precision are compared. A pair counts in the first
leaf that it shares, so a leaf emits no pairs: only each vector's number of links
and a spanning forest of them leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import components, cut

#: Trees; rows wanted in a leaf; rows compared at once; rows of a fitting sample; levels fitted in a round.
TREES, LEAF, BLOCK, SAMPLE, LEVELS = 12, 384, 2048, 8192, 8
#: Splits of the whole forest (12 bytes each), which bounds what is sent. Beyond them leaves grow and are compared in blocks.
MAX_SPLITS = 1 << 22
_TREE = 48  # bits of a path: a leaf's number is its tree and its path


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id``, ``h1, h2`` (hashes of the vector) and ``v`` (scaled by a power of two to a greatest component of 1 to 2, in the precision
    of the column); ``v`` is null if it can't link.

    That holds for null, empty and zero vectors and for null or non-finite components.
    """
    kind = "float" if df.schema[vec_col].dataType.elementType == T.FloatType() else "double"
    d = df.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda c: c.cast("double") + F.lit(0.0)).alias("x"))
    d = d.withColumn("top", F.array_max(F.transform("x", lambda c: F.abs(c))))
    fine = F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.col("top") > 0)
    return d.select("id", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit("second"), "x").alias("h2"), F.when(fine, F.transform("x", lambda c: (c / F.pow(2.0, F.floor(F.log2("top")))).cast(kind))).alias("v"))


def _matrices(lists: pa.Array):
    """Row numbers and unit vectors of each length that occurs in an Arrow list column."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, begin = lists.flatten().to_numpy(), np.cumsum(size) - size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        v = flat[begin[rows][:, None] + np.arange(d)].astype(float)
        yield rows, v / np.sqrt((v * v).sum(1))[:, None]


def _plane(tree: int, path: int, dim: int) -> np.ndarray:
    r = np.random.default_rng([tree, path & 0xFFFFFFFF, path >> 32, dim]).standard_normal(dim)
    return r / np.linalg.norm(r)


class Forest:
    """Medians by dimension, tree and path (1 is the root, 2 p and 2 p + 1 lie below p), as sorted arrays."""

    def __init__(self, spill: float):
        self.spill, self.parts = spill, {}  # (dim, tree) -> paths, medians

    def __len__(self):
        return sum(len(p) for p, _ in self.parts.values())

    def add(self, rows) -> None:
        new: dict = {}
        for r in rows:
            paths, mids = new.setdefault((r["dim"], r["tree"]), ([], []))
            paths += r["paths"]
            mids += r["mids"]
        for key, (paths, mids) in new.items():
            old = self.parts.get(key, (np.zeros(0, np.int64), np.zeros(0)))
            paths, mids = np.append(old[0], np.array(paths, np.int64)), np.append(old[1], np.array(mids, float))
            order = np.argsort(paths)
            self.parts[key] = paths[order], mids[order]

    def leaves(self, v: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf numbers of the unit vectors ``v``; rows within the margin of a split go both ways."""
        dim, rows_out, leaf_out = v.shape[1], [], []
        margin = self.spill / math.sqrt(dim)
        for tree in range(trees):
            paths, mids = self.parts.get((dim, tree), (np.zeros(0, np.int64), np.zeros(0)))
            todo = [(1, np.arange(len(v)))]
            while todo:
                p, rows = todo.pop()
                if not len(rows):
                    continue
                k = int(np.searchsorted(paths, p))
                if k == len(paths) or paths[k] != p:
                    rows_out.append(rows)
                    leaf_out.append(np.full(len(rows), (tree << _TREE) | p))
                    continue
                at = v[rows] @ _plane(tree, p, dim) - mids[k]
                todo += [(2 * p, rows[at <= margin]), (2 * p + 1, rows[at > -margin])]
        return np.concatenate(rows_out), np.concatenate(leaf_out)


def fit_splits(v: np.ndarray, tree: int, path: int, share: float, leaf: int, margin: float) -> tuple[list[int], list[float]]:
    """Paths and medians below ``path`` from a sample that is ``share`` of its rows, until leaves hold ``leaf`` rows.

    Sample rows spill as all rows will. No split where the sample is short or
    where most rows are within the margin, so that both sides would get nearly all.
    """
    paths, mids = [], []
    todo = [(path, np.arange(len(v)))]
    while todo:
        p, rows = todo.pop()
        if len(rows) < 8 or len(rows) <= leaf * share or p.bit_length() >= path.bit_length() + LEVELS:
            continue
        at = v[rows] @ _plane(tree, p, v.shape[1])
        mid = float(np.median(at))
        low, high = rows[at <= mid + margin], rows[at > mid - margin]
        if len(low) + len(high) > 1.5 * len(rows):
            continue
        paths.append(p)
        mids.append(mid)
        todo += [(2 * p, low), (2 * p + 1, high)]
    return paths, mids


def grow(classes: DataFrame, threshold: float, trees: int, leaf: int, spill: float) -> tuple[Forest, DataFrame]:
    """Fit the forest round by round: count leaves, then split those with too many rows on a sample of each.

    Returns it with the counts of its leaves that still hold more than ``2 * leaf`` rows.
    """
    spark, forest = classes.sparkSession, Forest(spill * math.sqrt(max(0.0, 2 - 2 * threshold)))
    stuck: set = set()
    kind = classes.schema["v"].dataType.simpleString()

    def routed(pick=None):
        sent, wanted = spark.sparkContext.broadcast(forest), spark.sparkContext.broadcast(pick)

        def run(batches):
            for b in batches:
                for rows, v in _matrices(b.column(1)):
                    r, at = sent.value.leaves(v, trees)
                    dim = v.shape[1]
                    if pick is None:
                        k, n = np.unique(at, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), dim, np.int32)), pa.array(k), pa.array(n)], ["dim", "leaf", "n"])
                        continue
                    size = np.array([wanted.value.get((dim, x), 0) for x in at.tolist()], np.int64)
                    h = b.column(0).to_numpy()[rows][r].view(np.uint64) ^ (at.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    h = ((h >> np.uint64(29)) ^ h) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)
                    some = np.flatnonzero(h.astype(float) * size < float(1 << 53) * SAMPLE * (size > 0))
                    for a in range(0, len(some), 4096):
                        i = some[a : a + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(at[i]), pa.array(size[i]), b.column(1).take(pa.array(rows[r[i]]))], ["dim", "leaf", "size", "v"])

        return classes.select("h1", "v").mapInArrow(run, "dim int, leaf long, n long" if pick is None else f"dim int, leaf long, size long, v {kind}")

    def fit(table: pa.Table) -> pa.Table:
        dim, at, size = (table.column(c)[0].as_py() for c in ("dim", "leaf", "size"))
        v = next(_matrices(table.column("v").combine_chunks()))[1]
        tree, path = at >> _TREE, at & ((1 << _TREE) - 1)
        paths, mids = fit_splits(v, tree, path, min(1.0, len(v) / size), leaf, forest.spill / math.sqrt(dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "tree": pa.array([tree], pa.int32()), "leaf": pa.array([at], pa.int64()), "paths": pa.array([paths], pa.list_(pa.int64())), "mids": pa.array([mids], pa.list_(pa.float64()))})

    while True:
        sizes = cut(routed().groupBy("dim", "leaf").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * leaf), "sizes")
        if len(forest) >= MAX_SPLITS:
            return forest, sizes
        big = sizes.orderBy(F.desc("n"), "dim", "leaf").limit(MAX_SPLITS >> LEVELS).collect()  # so that a round's splits stay bounded
        pick = {(r["dim"], r["leaf"]): r["n"] for r in big if (r["dim"], r["leaf"]) not in stuck}
        if not pick:
            return forest, sizes
        rows = routed(pick).groupBy("dim", "leaf").applyInArrow(fit, "dim int, tree int, leaf long, paths array<long>, mids array<double>").collect()  # bounded splits
        stuck |= {(r["dim"], r["leaf"]) for r in rows if not r["paths"]}
        forest.add([r for r in rows if r["paths"]])


#: Most leaves (the largest) that get a core; the others are compared in blocks.
CORES = 2048


def with_cores(classes: DataFrame, forest: Forest, sizes: DataFrame, threshold: float, trees: int) -> DataFrame:
    """``classes`` with ``core``: the number of the first crowded leaf whose rows' mean direction is within half the threshold's angle, else -1.

    Angles obey the triangle inequality, so any two vectors of one core are
    linked, whatever lies between them: a core's links are counted, not compared.
    """
    half = math.cos(math.acos(min(1.0, threshold)) / 2 - 1e-7) if threshold < 1 else 2.0
    crowded = {(r["dim"], r["leaf"]) for r in sizes.orderBy(F.desc("n"), "dim", "leaf").limit(CORES).collect()}
    if not crowded:
        return classes.withColumn("core", F.lit(-1).cast("long"))
    spark = classes.sparkSession
    sent, wanted = spark.sparkContext.broadcast(forest), spark.sparkContext.broadcast(crowded)

    def sums(batches):
        total: dict = {}
        for b in batches:
            for _, v in _matrices(b.column(0)):
                r, at = sent.value.leaves(v, trees)
                for x in np.unique(at).tolist():
                    if (v.shape[1], x) in wanted.value:
                        total[v.shape[1], x] = total.get((v.shape[1], x), 0) + v[r[at == x]].sum(0)
        for (dim, x), t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([x], pa.int64()), pa.array([t.tolist()], pa.list_(pa.float64()))], ["dim", "leaf", "t"])

    parts = classes.select("v").mapInArrow(sums, "dim int, leaf long, t array<double>").select("dim", "leaf", F.posexplode("t").alias("i", "x"))
    means = parts.groupBy("dim", "leaf", "i").agg(F.sum("x").alias("x")).groupBy("dim", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("t")).collect()  # CORES vectors at most
    pivots: dict = {}
    for r in means:
        t = np.array(r["t"])
        if np.linalg.norm(t) > 0:
            pivots.setdefault(r["dim"], {})[r["leaf"]] = t / np.linalg.norm(t)
    centre = spark.sparkContext.broadcast(pivots)

    def cores(batches):
        for b in batches:
            core = np.full(b.num_rows, -1, np.int64)
            for rows, v in _matrices(b.column("v")):
                r, at = sent.value.leaves(v, trees)
                for x in sorted(centre.value.get(v.shape[1], {}), reverse=True):  # the least number is written last
                    mine = r[at == x]
                    core[rows[mine[v[mine] @ centre.value[v.shape[1]][x] >= half]]] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(core)], [*b.schema.names, "core"])

    d = classes.select("h1", "h2", "copies", "v")
    return cut(d.mapInArrow(cores, f"h1 long, h2 long, copies long, v {d.schema['v'].dataType.simpleString()}, core long"), "cores")


def core_links(cored: DataFrame) -> DataFrame:
    """``h1, h2, far, r1, r2`` of the vectors of each core: all of the others, and the least of them."""
    dim = F.size("v")
    total = cored.where("core >= 0").groupBy(dim.alias("dim"), "core").agg(F.sum("copies").alias("all"), F.min(F.struct("h1", "h2")).alias("top"))
    d = cored.where("core >= 0").select("h1", "h2", "copies", dim.alias("dim"), "core").join(total, ["dim", "core"])
    return d.where("all > copies").select("h1", "h2", (F.col("all") - F.col("copies")).alias("far"), F.col("top.h1").alias("r1"), F.col("top.h2").alias("r2"))


def dealt(placed: DataFrame, crowded: DataFrame, block: int) -> DataFrame:
    """``placed`` once for each pair of blocks, ``lo`` and ``hi``, that needs the row.

    In a crowded leaf the largest core's rows are linked already, so only rows
    outside it are compared, with each other and with those inside: r (r + 2 l)
    / block + r + l rows at most for r outside and l inside.
    """
    cores = placed.join(crowded.select("dim", "leaf"), ["dim", "leaf"], "left_semi").groupBy("dim", "leaf", "core").agg(F.count(F.lit(1)).alias("c"))
    inside = F.when(F.col("core") >= 0, F.struct("c", "core"))
    plan = cores.groupBy("dim", "leaf").agg(F.sum("c").alias("n"), F.max(inside).alias("top"))
    held = F.coalesce(F.col("top.c"), F.lit(0))
    plan = cut(plan.select("dim", "leaf", F.coalesce("top.core", F.lit(-2).cast("long")).alias("top"), F.ceil((F.col("n") - held) / block).cast("int").alias("nr"), F.ceil(held / block).cast("int").alias("nl")), "plan")  # few; Spark broadcasts it if it is small
    every = placed.join(plan, ["dim", "leaf"], "left").withColumns({"nr": F.coalesce("nr", F.lit(1)), "nl": F.coalesce("nl", F.lit(0)), "out": F.coalesce(F.col("core") != F.col("top"), F.lit(True))})
    deal = lambda n: F.pmod(F.xxhash64("h2", "h1"), F.greatest(F.col(n), F.lit(1))).cast("int")
    every = every.withColumn("mine", F.when(F.col("out"), deal("nr")).otherwise(F.col("nr") + deal("nl")))
    last = F.when(F.col("out"), F.col("nr") + F.col("nl") - 1).otherwise(F.col("nr") - 1)
    every = every.withColumn("other", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    return every.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("nr", "nl", "top", "out", "other")


def _placed(classes: DataFrame, forest: Forest, trees: int) -> DataFrame:
    """One row for each vector and leaf: ``dim, leaf, h1, h2, copies, core, v`` and ``before``, the vector's leaves of lower number."""
    sent = classes.sparkSession.sparkContext.broadcast(forest)
    names = ["dim", "leaf", "h1", "h2", "copies", "core", "before", "v"]

    def run(batches):
        for b in batches:
            for rows, v in _matrices(b.column(4)):
                for a in range(0, len(rows), 512):
                    r, at = sent.value.leaves(v[a : a + 512], trees)
                    order = np.lexsort((at, r))
                    r, at = r[order], at[order]
                    nth = np.arange(len(r)) - np.searchsorted(r, r)  # leaves before this one
                    ends = np.append(0, np.cumsum(nth))
                    first = np.repeat(np.arange(len(r)) - nth, nth)
                    before = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[first + np.arange(len(first)) - np.repeat(ends[:-1], nth)]))
                    mine = rows[a + r]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), v.shape[1], np.int32)), pa.array(at), *(b.column(i).take(pa.array(mine)) for i in range(4)), before, b.column(4).take(pa.array(mine))], names)

    return classes.select("h1", "h2", "copies", "core", "v").mapInArrow(run, f"dim int, leaf long, h1 long, h2 long, copies long, core long, before array<long>, v {classes.schema['v'].dataType.simpleString()}")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row number reachable over the links ``(i, j)`` among ``n`` rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(threshold: float):
    """Links within one leaf, or between two blocks of it, as counts and a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        (rows, v), = _matrices(table.column("v").combine_chunks())
        mine, lo, hi = table.column("mine").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = (np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)) if lo != hi else (rows, rows)
        i, j = np.nonzero(v[left] @ v[right].T >= threshold - 1e-9)
        i, j = left[i], right[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        core = table.column("core").to_numpy()
        i, j = (x[(core[i] < 0) | (core[i] != core[j])] for x in (i, j))  # those of one core are counted there
        same = np.concatenate([np.einsum("ij,ij->i", v[i[a : a + 65_536]], v[j[a : a + 65_536]]) >= threshold for a in range(0, len(i), 65_536)]) if len(i) else np.zeros(0, bool)
        i, j = i[same], j[same]
        if len(i):  # a pair counts in the first of the leaves that it shares
            some, code = np.unique(np.concatenate([i, j]), return_inverse=True)
            before = table.column("before").combine_chunks().take(pa.array(some))
            size = before.value_lengths().to_numpy(zero_copy_only=False)
            known, column = np.unique(before.flatten().to_numpy(), return_inverse=True)
            member = np.zeros((len(some), len(known)), np.float32)
            member[np.repeat(np.arange(len(some)), size), column] = 1
            shared = member @ member.T
            first = shared[code[: len(i)], code[len(i) :]] == 0
            i, j = i[first], j[first]
        h1, h2, copies = (table.column(c).to_numpy() for c in ("h1", "h2", "copies"))
        far = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        linked, root = np.flatnonzero(far), _roots(len(rows), i, j)
        top = root[linked]
        return pa.table({"h1": h1[linked], "h2": h2[linked], "far": far[linked].astype(np.int64), "r1": h1[top], "r2": h2[top]})

    return run


def leaf_links(classes: DataFrame, threshold: float, trees: int = TREES, leaf: int = LEAF, spill: float = 0.5, block: int = BLOCK) -> DataFrame:
    """``h1, h2, far, r1, r2``: links of each vector found in a leaf (copies counted) and the vector that it hangs on there.

    ``classes(h1, h2, copies, v)`` holds different vectors. ``spill`` is the
    half-width of the overlap in units of the typical projected distance of a
    pair at the threshold. A leaf that could not be split, as its rows are too
    alike, counts the links of its core (``with_cores``) and compares what lies
    outside in pairs of blocks.
    """
    forest, sizes = grow(classes, threshold, trees, leaf, spill)
    crowded = sizes.where(F.col("n") > block)
    cored = with_cores(classes, forest, crowded, threshold, trees)
    every = _placed(cored, forest, trees)
    every = every.withColumns({c: F.lit(0) for c in ("mine", "lo", "hi")}) if crowded.isEmpty() else dealt(every, crowded, block)
    found = every.groupBy("dim", "leaf", "lo", "hi").applyInArrow(compare(threshold), "h1 long, h2 long, far long, r1 long, r2 long")
    return found.unionByName(core_links(cored))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Per row ``id, n_links, component_id, kept``.

    Vectors link when their cosine is at least ``threshold``; equal vectors
    collapse into a class first and are counted, not compared. Null, zero and
    non-finite vectors link with nothing; vectors of different length never
    link. Repeated rows each count. Other columns are ignored.
    """
    every = cut(unit_vectors(df, id_col, vec_col), "vectors")
    valid = every.where("v is not null")
    classes = cut(valid.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"), F.first("v").alias("v")), "classes")
    found = cut(leaf_links(classes, threshold, trees, leaf, block=block), "links")
    node, link = F.struct("h1", "h2"), F.struct(F.col("r1").alias("h1"), F.col("r2").alias("h2"))
    roots = components(found.select(node.alias("a"), link.alias("b")))
    linked = found.groupBy(node.alias("node")).agg(F.sum("far").alias("far"))
    of = classes.select(node.alias("node"), "copies", "rep").join(roots, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "root").select("node.h1", "node.h2", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), "component_id")
    return (every.join(of, (every.h1 == of.h1) & (every.h2 == of.h2) & every.v.isNotNull(), "left")
            .select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
