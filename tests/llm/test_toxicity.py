import math
import random

import numpy as np
from pyspark.sql import functions as F

from evenkeel.llm import toxicity
from evenkeel.llm.words import WordHashes


def plain(docs, y, epochs):
    """FTRL-proximal with dictionaries, one coordinate at a time."""
    z, n, a, b, l1 = {}, {}, toxicity.ALPHA, toxicity.BETA, toxicity.L1

    def weight(k):
        zk, nk = z.get(k, 0.0), n.get(k, 0.0)
        if k == 0:
            return -zk / ((b + math.sqrt(nk)) / a)
        return 0.0 if abs(zk) <= l1 else (math.copysign(l1, zk) - zk) / ((b + math.sqrt(nk)) / a)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(docs)):
            w = {k: weight(k) for k in docs[i]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y[i]
            if abs(g) < 1e-4:
                continue
            for k in docs[i]:
                nk = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(nk + g * g) - math.sqrt(nk)) / a * w[k]
                n[k] = nk + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_weights_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["rude", "mean", "kind", "calm", "blue", "tree"]) for _ in range(12)), i % 2) for i in range(80)]
    rows = [(i, t + (" rude words" if y else " calm words"), y) for i, t, y in rows]
    df = spark.createDataFrame([(i, t, y, (i * 7919) % 101) for i, t, y in rows], "key long, text string, y int, turn long")
    at, w = toxicity.train(df, bits=16)
    order = sorted(rows, key=lambda r: (r[0] * 7919) % 101)
    hashes = WordHashes()
    want = plain([toxicity.features(t, hashes, 16).tolist() for _, t, _ in order], [y for *_, y in order], toxicity.EPOCHS)
    assert set(at.tolist()) == set(want) and 1 < len(want) < 200
    assert all(math.isclose(x, want[k], rel_tol=1e-5, abs_tol=1e-6) for k, x in zip(at.tolist(), w.tolist()))


def test_sample_and_room_bound_the_fit(spark):
    df = spark.createDataFrame([(i, f"w{i} a b c", i % 2, i) for i in range(50)], "key long, text string, y int, turn long")
    size = len(toxicity.features("w0 a b c", WordHashes(), 16))
    for a, b in (({"sample": 10}, 10), ({"room": size * 10}, 10), ({"room": size - 1}, 0)):
        at, w = toxicity.train(df, bits=16, **a)
        some = toxicity.train(df.where(f"key < {b}"), bits=16)
        assert (at.tolist(), w.tolist()) == (some[0].tolist(), some[1].tolist())
    rows = spark.createDataFrame([(1, f"text {i}", i) for i in range(40)], "doc_id long, text string, row int")  # an id that repeats
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(rows, rows, labels, F.lit(True), sample=5, nested=True).count() == 40
