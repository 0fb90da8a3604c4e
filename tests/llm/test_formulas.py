"""Densities and cosine hashes against their plain formulas, and one very long text through every scoring and linking operator."""

import math

import numpy as np
from pyspark.sql import functions as F

from evenkeel.llm import licences, media, neardup, ppm, quality, toxicity


def test_quality_scores_are_log_density_differences(spark):
    rng = np.random.default_rng(3)
    d = len(quality.NAMES)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, d)) * np.where(y[:, None], 2.0, 1.0) + y[:, None] * 0.3
    x[:, 2] = 7.0  # a constant statistic
    m = quality.fit(spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x)], "y int, x array<double>").repartition(4), shrink=0.2, ridge=1e-2)
    sd = x.std(0)
    z = np.clip((x - x.mean(0)) / np.where(sd < 1e-6, 1.0, sd), -quality.CLIP, quality.CLIP)
    log = []
    for c in (0, 1):
        part = z[y == c]
        cov = np.cov(part.T, bias=True)
        cov = 0.8 * cov + 0.2 * np.diag(np.diag(cov)) + 1e-2 * np.eye(d)
        off = z - part.mean(0)
        log.append(math.log(len(part) / len(z)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-9)


def test_hash_is_that_of_a_direct_cosine_sum():
    rng = np.random.default_rng(4)
    n = media.SIDE
    for shape in ((n, n, 3), (n, n, 1), (2 * n, 3 * n, 3)):
        px = rng.integers(0, 256, shape).astype(np.uint8)
        grey = px.astype(float).mean(2)
        small = grey.reshape(n, shape[0] // n, n, shape[1] // n).mean((1, 3))
        k = np.arange(8)
        low = np.zeros((8, 8))
        for u in k:
            for v in k:
                low[u, v] = sum(small[a, b] * math.cos(math.pi * (2 * a + 1) * u / (2 * n)) * math.cos(math.pi * (2 * b + 1) * v / (2 * n)) for a in range(n) for b in range(n))
                low[u, v] *= (math.sqrt(1 / n) if u == 0 else math.sqrt(2 / n)) * (math.sqrt(1 / n) if v == 0 else math.sqrt(2 / n))
        low = np.round(low, 6).ravel()
        want = np.packbits(low > np.median(low[1:])).tobytes()
        assert bin(int.from_bytes(want) ^ int.from_bytes(media.dct_hash(px))).count("1") <= 1  # a coefficient that is the median itself may fall to either side


def test_a_very_long_text(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in rng.integers(0, 5000, 150_000)]
    long = " ".join(words)
    other = " ".join(words[:140_000])
    rows = [(0, long), (1, long + " end"), (2, other)] + [(i, f"short text number {i} with words") for i in range(3, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    near = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, num=85, den=100).collect()}
    assert near[0][1] == near[1][1] == near[2][1] == 0 and near[1][0] == near[0][0] + 1 == 149_997
    for got in (quality.score_quality(df, labels, F.lit(True)), toxicity.score_toxicity(df, df, labels, F.lit(True))):
        assert all(0 <= r.score <= 1 for r in got.collect())
    scored = {r.id: r for r in ppm.score_texts(df, F.col("doc_id") != 0).collect()}
    assert scored[0].n_tokens == 150_001 and scored[0].score < scored[3].score < 0
    assert {r.doc_id for r in licences.scan_licences(df).where("licence is null").collect()} == set(range(30))
