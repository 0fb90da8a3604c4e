"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, stars.

Equal shingle sets collapse into one class first. In every bucket one member
is the centre and the others are candidates with it alone, confirmed on full
sets. Only buckets whose members then belong to several components go on: they
are compared block by block inside tasks, which emit a link only where it joins
two components; where thousands stay apart they are first parted by the rare
shingles that linked sets must share. So no linked pair that shares a bucket is left apart, and no
bucket emits its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import components, cut
from evenkeel.llm.words import M1, WordHashes, mix, shingles, words_of

BANDS, ROWS = 40, 6


class OnePermutation:
    """Signature of a sorted set of 64-bit hashes: least hash of each of ``bins`` ranges.

    An empty bin takes the value of the filled bin that comes first in a random
    order of its own (densification by independent probes).
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.order = np.random.default_rng(seed).random((self.bins, self.bins), np.float32)
        self.tag = np.arange(1, bands + 1, dtype=np.uint64) * M1

    def signature(self, u: np.ndarray) -> np.ndarray:
        bin_of = ((u >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
        filled = bin_of[first].astype(np.int64)
        sig = np.zeros(self.bins, np.uint64)
        sig[filled] = u[first]
        if len(filled) < self.bins:
            hole = np.ones(self.bins, bool)
            hole[filled] = False
            empty = np.flatnonzero(hole)
            sig[empty] = sig[filled[self.order[np.ix_(empty, filled)].argmin(1)]]
        return sig

    def buckets(self, u: np.ndarray) -> np.ndarray:
        sig = self.signature(u).reshape(self.bands, self.rows)
        acc = self.tag.copy()
        for i in range(self.rows):
            acc = mix(acc * M1 + sig[:, i])
        return acc.view(np.int64)


def with_text_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Two 64-bit hashes of the text, to find the same text again without carrying it."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("k1", F.xxhash64(t)).withColumn("k2", F.xxhash64(F.lit("second"), t))


def sketch(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int, k: int) -> DataFrame:
    """``id, k1, k2, n_shingles, f1, f2`` (fingerprint of the set) and ``buckets`` for each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        oph, hashes = OnePermutation(bands, rows), WordHashes()
        for b in batches:
            n, f, parts = [], [], []
            for t in b.column(3):
                u = shingles(hashes.of(words_of(t.as_py())), k)
                n.append(len(u))
                f.append(xxhash.xxh3_128_digest(u.tobytes()))
                parts.append(oph.buckets(u) if len(u) else np.zeros(0, np.int64))
            f = np.frombuffer(b"".join(f), np.int64).reshape(-1, 2)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))],
                ["id", "k1", "k2", "n_shingles", "f1", "f2", "buckets"])

    return with_text_key(df, text_col).select(id_col, "k1", "k2", text_col).mapInArrow(
        run, f"id {kind}, k1 long, k2 long, n_shingles long, f1 long, f2 long, buckets array<long>")


def confirm(edges: DataFrame, texts: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """The edges ``(a, b)`` whose full sets have ``den * |A and B| >= num * |A or B|``."""

    def run(batches):
        hashes, last, kept = WordHashes(), None, None
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x = x.as_py()
                if x != last:
                    last, kept = x, shingles(hashes.of(words_of(x)), k)
                other = shingles(hashes.of(words_of(y.as_py())), k)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                ok.append(den * both >= num * (len(kept) + len(other) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    node = "struct<f1:bigint,f2:bigint>"
    full = (edges.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"))
    return full.select("a", "b", "ta", "tb").mapInArrow(run, f"a {node}, b {node}")


def _joined(rows: list[tuple], num: int, den: int, k: int, hashes: WordHashes) -> list[tuple]:
    """Links ``(node, node)`` that join the components of ``rows (mine, node, comp, text)``, across the two halves if there are two."""
    sets = [shingles(hashes.of(words_of(r[3])), k) for r in rows]
    size = np.array([len(u) for u in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # columns for hashes of two sets at least
    owner = np.repeat(np.arange(len(rows)), size)
    some = times[code] > 1
    owner, column = owner[some], shared[code[some]]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for a in range(0, int(shared[-1]) + 1, 4096):
        here = (column >= a) & (column < a + 4096)
        m = np.zeros((len(rows), 4096), np.float32)
        m[owner[here], column[here] - a] = 1
        both += m @ m.T
    i, j = np.nonzero(np.triu(den * both.astype(np.int64) >= num * (size[:, None] + size[None, :] - both.astype(np.int64)), 1))
    up = {r[2]: r[2] for r in rows}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    halves, out = len({r[0] for r in rows}) > 1, []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = top(rows[x][2]), top(rows[y][2])
        if a != b and not (halves and rows[x][0] == rows[y][0]):
            up[a] = b
            out.append((rows[x][1], rows[y][1]))
    return out


def dealt(members: DataFrame, block: int = 256) -> DataFrame:
    """``bucket, lo, hi, mine, node, comp``: members of the buckets that hold several components, once for each task that needs them.

    A bucket's largest component is joined already, so only the members outside
    it are compared, with each other and with those inside. Where ``index`` says
    which members are to be compared, with each other and with the rest, that holds. Both kinds are
    dealt to blocks by hash. With r members outside and l inside that makes
    ``r (r + 2 l) / block + r + l`` rows at most: in proportion to the bucket,
    as ``parted`` leaves buckets of no more than ``WIDE`` outside but for shared rare shingles.
    """
    if "index" not in members.columns:
        members = members.withColumn("index", F.lit(None).cast("boolean"))
    comps = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.count_if("index").alias("i"), F.count("index").alias("given"))
    per = comps.groupBy("bucket").agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k"), F.sum("i").alias("i"), F.sum("given").alias("given")).where("k > 1")
    r = F.when(F.col("given") > 0, F.col("i")).otherwise(F.col("size") - F.col("top.c"))
    per = per.where(r > 0).select("bucket", F.col("top.comp").alias("top"), F.ceil(r / block).cast("int").alias("nr"), F.ceil((F.col("size") - r) / block).cast("int").alias("nl"))
    m = members.join(per, "bucket").withColumn("out", F.coalesce("index", F.col("comp") != F.col("top")))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    m = m.withColumn("mine", F.when(F.col("out"), deal("nr")).otherwise(F.col("nr") + deal("nl")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("nr") + F.col("nl") - 1).otherwise(F.col("nr") - 1))))
    return m.select("bucket", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "comp")


def inside(members: DataFrame, texts: DataFrame, num: int, den: int, k: int, block: int = 256) -> DataFrame:
    """Links ``(a, b)`` between components within buckets, from ``members(bucket, node, comp)``.

    A task compares two blocks of a bucket, sets against sets as a matrix
    product; only links that join two components leave it.
    """
    key = ["bucket", "lo", "hi"]
    m = dealt(members, block).join(texts, "node")
    m = m.select(*key, "mine", "node.f1", "node.f2", F.col("comp.f1").alias("c1"), F.col("comp.f2").alias("c2"), "text").repartition(*key).sortWithinPartitions(*key)
    node = pa.struct([("f1", pa.int64()), ("f2", pa.int64())])

    def run(batches):
        hashes, last, rows = WordHashes(), None, []

        def links():
            found = _joined(rows, num, den, k, hashes) if len({r[2] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([dict(zip(("f1", "f2"), p[s])) for p in found], node) for s in (0, 1)], ["a", "b"])

        for b in batches:
            for bucket, lo, hi, mine, f1, f2, c1, c2, text in zip(*(c.to_pylist() for c in b.columns)):
                if last != (bucket, lo, hi):
                    if rows:
                        yield links()
                    last, rows = (bucket, lo, hi), []
                rows.append((mine, (f1, f2), (c1, c2), text))
        if rows:
            yield links()

    out = "struct<f1:bigint,f2:bigint>"
    return m.mapInArrow(run, f"a {out}, b {out}")


#: Members that the stars may leave apart in a bucket before it is parted by rare shingles.
WIDE = 1024


def rare_buckets(members: DataFrame, texts: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """``bucket, node, comp, index``: the members of crowded buckets by the rare shingles that they share.

    Order all shingles in one way; here by how many of these sets hold them. Of
    two sets that link, the larger has among its first ``n - ceil(n t) + 1``
    one of the smaller's first ``n - ceil(2 n t / (1 + t)) + 1`` (``index``), t
    the similarity. So pages of one template whose own parts differ, which meet in
    buckets by the thousand, don't meet here, and no link is lost. Shingles that
    only one component holds or that index none give no bucket, and those of
    the same sets one. Work and rows are in proportion to the texts.
    """
    node = "struct<f1:bigint,f2:bigint>"

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(hashes.of(words_of(t.as_py())), k).view(np.int64) for t in b.column(2)]
            ends = np.concatenate([[0], np.cumsum([len(u) for u in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["node", "comp", "tokens"])

    held = cut(members.select("node", "comp").distinct().join(texts, "node").select("node", "comp", "text").mapInArrow(run, f"node {node}, comp {node}, tokens array<long>"), "tokens")
    each = held.select("node", F.explode("tokens").alias("t"))
    common = each.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    ranked = each.join(common, "t").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ts"))  # one text's shingles
    first = lambda a, b: F.size("ts") - F.expr(f"(size(ts) * {a} + {b - 1}) div {b}") + 1
    ranked = ranked.select("node", F.posexplode(F.slice("ts", F.lit(1), first(num, den).cast("int"))).alias("at", "x"), first(2 * num, den + num).alias("few"))
    posts = cut(ranked.where("x.c > 1").select("node", F.col("x.t").alias("t"), (F.col("at") < F.col("few")).alias("index")).join(held.select("node", "comp"), "node"), "posts")
    h = F.xxhash64("node", "index")
    same = posts.groupBy("t").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.bool_or("index").alias("some")).where("a <> b and some")
    return posts.join(same.groupBy("n", "s", "x").agg(F.min("t").alias("t")).select("t"), "t").select(F.col("t").alias("bucket"), "node", "comp", "index")


def parted(members: DataFrame, texts: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """``members`` with those buckets that the stars left in more than ``WIDE`` pieces outside the largest component replaced by ``rare_buckets``."""
    comps = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    wide = cut(comps.groupBy("bucket").agg((F.sum("c") - F.max("c")).alias("r")).where(F.col("r") > WIDE).select("bucket"), "wide")
    if wide.isEmpty():
        return members
    return members.join(wide, "bucket", "left_anti").withColumn("index", F.lit(None).cast("boolean")).unionByName(rare_buckets(members.join(wide, "bucket", "left_semi"), texts, num, den, k))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 4, den: int = 5, bands: int = BANDS, rows: int = ROWS, k: int = 5) -> DataFrame:
    """Per row: ``id, k1, k2, n_shingles, root, component_id, kept``.

    Rows link when the Jaccard similarity of their sets of ``k``-word shingles
    is at least num/den. component_id is the least id reachable by links, the
    row's own id included; root stands for the group, null without shingles. Null and blank texts have no shingles and link with
    nothing; a null id never is a component id unless all are null there.
    Repeated rows each get a row; other columns are ignored. The chance to
    miss a pair of similarity s is ``(1 - s**rows) ** bands``.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    seen = cut(sketch(docs, "_id", "_text", bands, rows, k), "sketch").withColumn("node", F.struct("f1", "f2"))
    full = seen.where("n_shingles > 0")
    classes = cut(full.groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")).alias("rep"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets")), "classes")
    rep = classes.select("node", "n", F.col("rep.id").alias("id"), F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"))

    each = classes.select("node", "n", F.explode("buckets").alias("bucket"))
    members = cut(each.join(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "n")).alias("centre")).where("c > 1").drop("c"), "bucket"), "members")
    wanted = rep.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("id").alias("wid"), "k1", "k2")
    texts = cut(with_text_key(docs, "_text").join(wanted, ["k1", "k2"]).where(F.col("_id").eqNullSafe(F.col("wid")))
                .select("node", F.coalesce("_text", F.lit("")).alias("text")).dropDuplicates(["node"]), "texts")

    star = members.select("node", "n", F.col("centre.node").alias("centre"), F.col("centre.n").alias("cn")).where(
        (F.col("node") != F.col("centre")) & (F.least("n", "cn") * den >= F.greatest("n", "cn") * num))  # else the sizes alone rule it out
    links = cut(confirm(star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), texts, num, den, k), "links")
    root = components(links)
    members = cut(members.where(F.col("node") != F.col("centre.node")).select("bucket", "node").join(root, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp")), "members")
    rest = cut(inside(parted(members, texts, num, den, k), texts, num, den, k), "links")
    if not rest.isEmpty():
        root = components(links.unionByName(rest))

    of_class = rep.join(root, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = of_class.groupBy("root").agg(F.min("id").alias("component_id"))
    of_node = of_class.join(least, "root").select("node", "root", "component_id")
    return seen.join(of_node, "node", "left").select(
        "id", "k1", "k2", "n_shingles", "root", F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
