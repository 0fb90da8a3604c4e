import numpy as np

from evenkeel.llm import forest
from tests.llm.brute import Union


def brute(rows, threshold):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u, n = Union(), {i: 0 for i, _ in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in ok}
    for i, v in ok:
        for j, w in ok:
            if i < j and len(v) == len(w) and unit[i] @ unit[j] >= threshold:
                u.join(i, j)
                n[i] += 1
                n[j] += 1
    return {i: (n.get(i, 0), u.find(i)) for i, _ in rows}


def test_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 16))
    near = np.concatenate([base[:60] + 0.05 * rng.standard_normal((60, 16)), base[:1] + 0.08 * rng.standard_normal((150, 16)), np.repeat(base[5:6], 40, 0)])
    vecs = [v.astype(np.float32).tolist() for v in np.concatenate([base, near])]
    vecs += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1e30] * 16, [1e-30] * 16]
    rows = [(i, v, 1) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, size int")
    want = brute([(i, np.float32(v).tolist() if v and None not in v else v) for i, v, _ in rows], 0.95)
    got = {r.id: r for r in forest.near_vectors(df, leaf=40).collect()}
    links = sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * links > 0
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= len(rows) - 2
    assert all(r.kept == (r.id == r.component_id) for r in got.values())


def test_empty(spark):
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_clusters_blocks_and_linear_output(spark):
    """A corpus with clusters, one of them a third of all rows: recall, exact counts, and no pairs leave a leaf."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1500, 24))
    centre = rng.standard_normal((60, 24))
    small = np.repeat(centre, 20, 0) + 0.12 * rng.standard_normal((1200, 24))
    hot = rng.standard_normal(24) + 0.03 * rng.standard_normal((1300, 24))
    vecs = np.concatenate([base, small, hot]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r.id: r for r in forest.near_vectors(df, leaf=100, block=256).collect()}
    counts = np.array([got[i].n_links for i in range(len(vecs))])
    assert (counts <= links).all() and counts.sum() >= 0.99 * links.sum()
    assert (counts[-1300:] == links[-1300:]).all()  # all share every leaf
    assert len({got[i].component_id for i in range(2700, 4000)}) == 1
    classes = forest.unit_vectors(df, "vec_id", "embedding").withColumn("copies", forest.F.lit(1).cast("long"))
    assert forest.leaf_links(classes, 0.95, leaf=100, block=256).count() < 40 * len(vecs) < counts.sum()


def test_recall_on_given_vectors_with_planted_neighbours(spark):
    """All given vectors, with a near one for every tenth."""
    given = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").collect()], float)
    rng = np.random.default_rng(4)
    step = rng.standard_normal(given[::10].shape)
    near = given[::10] / np.linalg.norm(given[::10], axis=1)[:, None] + 0.25 * step / np.linalg.norm(step, axis=1)[:, None]
    vecs = np.concatenate([given, near])
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in forest.near_vectors(df).collect()}
    counts = np.array([got[i] for i in range(len(vecs))])
    assert links.sum() > 200 and (counts <= links).all() and counts.sum() >= 0.99 * links.sum()


def test_near_alike_vectors_are_dealt_in_proportion(spark):
    """20,000 vectors around one direction, most within half the angle of 0.95: no copies for blocks of the core, whole counts."""
    rng = np.random.default_rng(12)
    n, dim = 20_000, 16
    axis = rng.standard_normal(dim)
    vecs = axis / np.linalg.norm(axis) + 0.025 * rng.standard_normal((n, dim)) * np.where(np.arange(n)[:, None] % 50 == 0, 3, 1)
    vecs = np.concatenate([vecs, rng.standard_normal((500, dim))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1)[:, None]
    links = np.concatenate([(unit[a:a + 2000] @ unit.T >= 0.95).sum(1) for a in range(0, len(unit), 2000)]) - 1
    classes = forest.unit_vectors(df, "vec_id", "embedding").withColumn("copies", forest.F.lit(1).cast("long")).cache()
    grown, sizes = forest.grow(classes, 0.95, 4, forest.LEAF, 0.5)
    crowded = sizes.where(f"n > {forest.BLOCK}")
    assert crowded.count() >= 4
    cored = forest.with_cores(classes, grown, crowded, 0.95, 4)
    placed = forest._placed(cored, grown, 4)
    assert cored.where("core >= 0").count() > 0.9 * n
    assert forest.dealt(placed, crowded, forest.BLOCK).count() < 2 * placed.count()
    got = {r.id: r for r in forest.near_vectors(df, trees=4).collect()}
    counts = np.array([got[i].n_links for i in range(len(vecs))])
    assert (counts <= links).all() and counts.sum() >= 0.999 * links.sum()
    assert len({got[i].component_id for i in range(n) if links[i] > 0}) == 1


def test_cores_and_copies_count_each_link_once(spark):
    rng = np.random.default_rng(13)
    hot = rng.standard_normal(12) + 0.05 * rng.standard_normal((900, 12))
    edge = hot[0] + 0.3 * rng.standard_normal((300, 12))
    vecs = np.concatenate([hot, edge, np.repeat(hot[:5], 30, 0), rng.standard_normal((100, 12))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    unit = vecs.astype(float) / np.linalg.norm(vecs.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r.id: r.n_links for r in forest.near_vectors(df, leaf=40, block=128).collect()}
    counts = np.array([got[i] for i in range(len(vecs))])
    assert (counts <= links).all() and counts.sum() >= 0.99 * links.sum()
