import random

from evenkeel.llm import neardup
from tests.llm.brute import near


def run(spark, rows, num=85, den=100):
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int, bucket string")
    return neardup.near_duplicates(df, num=num, den=den).collect()


def make(rng, n):
    return [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.randrange(300)) for _ in range(n))][0]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows, base = [], make(rng, 160)
    for i in range(60):  # each one altered by itself: linked to the base, seldom to each other
        w = base.split()
        for _ in range(2):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    rows.append(base)
    rows += [make(rng, rng.choice([1, 3, 5, 9, 40, 200])) for _ in range(60)]
    rows += [rows[3], rows[70], rows[71].upper(), "", None, "  \n\t ", "one two", "One\ttwo ", "a"]
    data = [(900 - i, t, 1, "x") for i, t in enumerate(rows)]
    want = near([(i, t) for i, t, *_ in data], 85, 100)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, data)}
    assert got == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in run(spark, data))


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, None), (None, "a b c d e f", 1, "x"), (None, "only here", 1, "x"), (7, None, 1, "x")]
    got = sorted(((r["id"], r["component_id"], r["kept"]) for r in run(spark, rows)), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, 1, False), (None, None, True), (7, 7, True)], key=str)
    assert run(spark, []) == []


def test_real_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, num=85, den=100).collect()}
    assert got == near(rows, 85, 100)


def test_hot_bucket_deals_rows_in_proportion(spark):
    """5,000 near copies in one bucket, 100 of them left apart by the stars: each is dealt once or a few times, not once for each block."""
    rows = [(1, (0, i), (0, 0 if i >= 100 else i + 1)) for i in range(5000)] + [(2, (0, i), (0, 0)) for i in range(300, 900)]
    kind = "struct<f1:bigint,f2:bigint>"
    got = neardup.dealt(spark.createDataFrame(rows, f"bucket long, node {kind}, comp {kind}")).collect()
    assert {r.bucket for r in got} == {1}
    assert len(got) <= 4900 + 100 * (1 + 20)
    blocks = {}
    for r in got:
        blocks.setdefault((r.lo, r.hi), []).append((r.mine, r.node.f2))
    met = set()
    for (lo, hi), m in blocks.items():
        a, b = [n for x, n in m if x == lo], [n for x, n in m if x == hi]
        met |= {(min(x, y), max(x, y)) for x in a for y in b}
    assert all((min(x, y), max(x, y)) in met for x in range(100) for y in range(5000) if x != y)


def templates(rng, n, pairs):
    """Pages of one template, 416 of whose shingles all share; similarity 0.84 to each other, and some pairs of 0.95."""
    head = [f"t{i}" for i in range(420)]
    rows = []
    for i in range(n):
        own = [f"u{rng.randrange(10**9)}" for _ in range(40)]
        rows.append(" ".join(head + own))
        if i < pairs:
            rows.append(" ".join(head + own[:-6] + [f"v{rng.randrange(10**9)}" for _ in range(6)]))
    return rows


def test_pages_of_one_template_are_dealt_in_proportion(spark, monkeypatch):
    """5,000 texts that meet in many buckets and don't link: few rows are dealt, and the planted pairs among them are found."""
    rows = templates(random.Random(8), 5000, 25)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(8)
    seen = []

    def counted(members, block=256, dealt=neardup.dealt):
        out = dealt(members, block)
        seen.append((members.select("node").distinct().count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "dealt", counted)
    got = neardup.near_duplicates(df, num=85, den=100).collect()
    assert len(seen) == 1 and seen[0][1] < 5000
    groups = {}
    for r in got:
        groups.setdefault(r["component_id"], []).append(rows[r["id"]])
    assert len(got) == 5025 and sorted(map(len, groups.values())) == [1] * 4975 + [2] * 25
    want = near(list(enumerate(rows[:120])), 85, 100)
    first = {r["id"]: r["component_id"] for r in got}
    assert all(first[i] == c for i, (_, c) in want.items())


def test_crowded_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "WIDE", 2)
    rng = random.Random(9)
    rows = templates(rng, 40, 10)
    for i in range(60):  # a chain: each is like the one before
        w = rows[-1 if i else 0].split()
        for _ in range(3):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    want = near(list(enumerate(rows)), 85, 100)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, [(i, t, 1, "x") for i, t in enumerate(rows)])}
    assert got == want
