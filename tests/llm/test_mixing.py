import math
import random
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from evenkeel.llm import mixing


def test_quotas_and_period_keep_lag_under_one_block():
    rng = random.Random(3)
    for n in (1, 2, 5, 17):
        w = {f"s{i}": rng.random() + 0.01 for i in range(n)}
        q = mixing.quotas(w, 256)
        assert sum(q.values()) == 256 and min(q.values()) >= 1
        slots = mixing.period_slots(q)
        assert sorted(t for x in slots.values() for t in x) == list(range(256))
        for s, x in slots.items():
            for i, t in enumerate(x):  # released, not late
                assert i * 256 // q[s] <= t < -(-(i + 1) * 256 // q[s])
            for t in range(257):
                assert abs(sum(y < t for y in x) - t * q[s] / 256) < 1


def test_all_rows_once_and_phases(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([0, 1, 50, 900, 5000]), rng.choice(["hot", "hot", "hot", "a", "b", None]), "z") for i in range(600)]
    rows += [rows[5], rows[5], (None, None, None, "q"), (7000, None, "tiny", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, block_note string")
    got = mixing.mix_sources(df, block_bytes=2000).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(r[:3] for r in rows)
    slots = {}
    for r in got:
        assert r.release <= r.slot < r.deadline
        assert slots.setdefault(r.slot, (r.mix_source, r.block)) == (r.mix_source, r.block)  # one block a slot
        assert r.block == r.start // 2000
    # a source's stream is gapless: starts are the running sums of sizes
    for s in {r.mix_source for r in got}:
        x = sorted((r.start, max(1, len((r.text or "").encode()))) for r in got if r.mix_source == s)
        assert x[0][0] == 0
        assert sum(n for _, n in x) >= x[-1][0]


def test_given_weights_and_empty(spark):
    df = spark.createDataFrame([(i, "y" * 1000, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, {"a": 3.0, "b": 1.0}, block_bytes=1000).collect()
    first = Counter(r.source for r in got if r.slot < 200)
    assert abs(first["a"] - 150) <= 1
    assert mixing.mix_sources(df.limit(0)).count() == 0
    clash = df.withColumn("slot", F.lit(-1)).withColumn("mix_size", F.lit(0)).withColumn("row", F.lit("r"))
    got = mixing.mix_sources(clash, block_bytes=1000).collect()
    assert len(got) == 400 and min(r.slot for r in got) == 0 and {r.mix_size for r in got} == {0}


def lags(slots, weights):
    """Greatest distance from ``weights``' share after any slot, in blocks."""
    share, ran, worst = mixing.whole(weights), Counter(), 0
    total = sum(share.values())
    for t, s in enumerate(slots, 1):
        ran[s] += 1
        worst = max(worst, *(abs(ran[x] * total - k * t) for x, k in share.items()))
    return worst / total


def test_less_than_one_block_from_the_given_weights_over_a_phase(spark):
    weights = {"a": 99.0, "b": 1.0}
    df = spark.createDataFrame([(i, f"{i:010d}", "b" if i < 200 else "a") for i in range(6200)], "doc_id long, text string, source string")
    got = sorted((r.slot, r.source, r.release, r.deadline, r.block) for r in mixing.mix_sources(df, weights, block_bytes=10).collect())
    assert [r[0] for r in got] == list(range(6200))
    end = 1 + max(r[0] for r in got if r[1] == "a")  # then a new phase starts
    assert end > 6000 and lags([r[1] for r in got[:end]], weights) < 1
    for slot, s, release, deadline, i in got[:end]:
        w = Fraction(weights[s]) / 100
        assert (release, deadline) == (math.floor(i / w), math.ceil((i + 1) / w)) and release <= slot < deadline


def test_default_weights_of_a_hot_source_and_a_tiny_one():
    size = {"hot": 10_000_000_000, "tiny": 1000} | {f"s{i}": 1_000_000_000 for i in range(20)}
    weights, blocks = {s: b**0.5 for s, b in size.items()}, {s: -(-b // 1_000_000) for s, b in size.items()}
    order = [(s, i) for s, i, *_ in mixing.phases(blocks, weights)]
    assert len(order) == len(set(order)) == sum(blocks.values())
    left, start, longest = dict(weights), 0, 0
    for end, (s, i) in enumerate(order, 1):
        if i + 1 == blocks[s]:  # the phase ends
            assert lags([x for x, _ in order[start:end]], left) < 1
            longest, start = max(longest, end - start), end
            del left[s]
    assert longest > 20_000 and not left
    assert mixing.whole({"a": 0.75, "b": 1.5}) == {"a": 3, "b": 6}


def test_a_source_of_weight_zero_comes_last(spark):
    df = spark.createDataFrame([(i, "y" * 1000, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, {"a": 2.0, "b": 0.0}, block_bytes=1000).collect()  # c has no weight: the least positive one
    assert len(got) == 300 and min(r.slot for r in got if r.source == "b") == 200
    first = Counter(r.source for r in got if r.slot < 100)
    assert first["a"] == first["c"] == 50
    assert [s for s, *_ in mixing.phases({"a": 2, "b": 2}, {"a": 0.0, "b": 0.0})] == ["a", "b", "a", "b"]


def test_blocks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    df = spark.createDataFrame([(i, "z" * 1000, f"s{i % 7}") for i in range(700)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, block_bytes=10).collect()
    assert len(got) == 700 and max(r.slot for r in got) < 50 + 7
    assert all(r.block == r.start // 14_000 for r in got)


def test_many_sources(spark):
    df = spark.createDataFrame([(i, "t", f"s{i}") for i in range(5000)], "doc_id long, text string, source string")
    assert sorted(r.slot for r in mixing.mix_sources(df).collect()) == list(range(5000))
