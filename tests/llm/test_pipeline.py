from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm.common import cut
from tests.llm.brute import near, repeats

SF = "/root/testdata/sf0.001"


def long_runs(raw, flags, words):
    """The flags without runs that hold fewer than so many words."""
    out, at = list(flags), 0
    while at < len(out):
        end = at + 1
        while end < len(out) and out[end] == out[at]:
            end += 1
        if out[at] and len(raw[at:end].split()) < words:
            out[at:end] = [False] * (end - at)
        at = end
    return out


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = cut(stage(spark, docs, SF), name)
    rows = {n: [r.asDict() for r in d.collect()] for n, d in seen.items()}
    names = list(rows)
    for n in names[:-1]:
        assert seen[n].columns == seen["documents"].columns
    # toxicity: a subset, rows as they were
    before = {r["doc_id"]: r for r in rows["documents"]}
    assert all(before[r["doc_id"]] == r for r in rows["toxicity"]) and len(rows["toxicity"]) > 0.85 * len(before)
    # near duplicates: the least id of each group
    want = near([(r["doc_id"], r["text"]) for r in rows["toxicity"]], 4, 5)
    assert {r["doc_id"] for r in rows["near_duplicates"]} == {i for i, (_, c) in want.items() if i == c}
    # repeats: the bytes that stay
    raw, flags = repeats([r["text"] for r in rows["near_duplicates"]], corpus_pipeline.REPEAT_BYTES)
    flags = [long_runs(t, f, corpus_pipeline.REPEAT_WORDS) for t, f in zip(raw, flags)]
    kept = {r["doc_id"]: bytes(b for b, x in zip(t, f) if not x).decode("utf-8", "ignore") for r, t, f in zip(rows["near_duplicates"], raw, flags)}
    assert any(map(any, flags))
    assert {r["doc_id"]: r["text"] for r in rows["repeats"]} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in rows["repeats"])
    # mixture: all rows, in another order
    assert sorted(map(str, rows["mixture"])) == sorted(map(str, rows["repeats"]))
    # packing: every document once, sequences gapless
    assert {r["doc_id"] for r in rows["packing"]} == {r["doc_id"] for r in rows["mixture"]}
    seqs = defaultdict(list)
    for r in rows["packing"]:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(seqs) <= -(-sum(r["length"] for r in rows["packing"]) // 2048) * 1.02 + 1
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048


def test_clashing_columns_nulls_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (7_000_000, "", "en", None, 0), (7_000_001, "w " * 3000, "en", "x", 1), (7_000_001, "w " * 3000, "en", "x", 1)], docs.schema)
    names = ["row", "k1", "k2", "score", "predicted", "kept", "spans", "n_bytes", "slot", "start", "block", "mix_source", "text_", "_id"]
    for some in (docs.unionByName(odd), docs.limit(0)):
        d = some.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
        for name, stage in corpus_pipeline.STAGES:
            out = cut(stage(spark, d, SF), name)
            if name != "packing":
                assert out.columns == d.columns
                assert out.where(" or ".join(f"{n} <> {i}" for i, n in enumerate(names))).isEmpty()
            d = out
        assert (d.count() > 60) == (some.count() > 0)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_same_id_and_repeated_rows(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "en", "a", 1), (1, base + " end", "en", "b", 2), (1, base, "en", "c", 3), (2, base, "en", "d", 4), (3, "", "en", "e", 0), (3, None, "en", "f", 0), (3, base[::-1], "en", "g", 0)]
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    for n in (1, 7):
        got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, kind).repartition(n), SF).collect()
        assert sum(r.doc_id == 1 for r in got) == 1 and not [r for r in got if r.doc_id == 2]
        first = first if n > 1 else sorted(map(str, got))
        assert sorted(map(str, got)) == first and len([r for r in got if r.doc_id == 3]) == 2  # one blank row, one text


def test_packing_follows_the_mixture(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(900, 0, -1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    mixed = cut(docs.repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id"), "mixed")
    from evenkeel.llm import packing

    got = {r.doc_id: r.sequence_id >> 40 for r in packing.pack_documents(mixed, group=100, order=corpus_pipeline._places(mixed)).collect()}
    assert len(set(got.values())) > 4 and all(got[i] <= got[i + 1] for i in range(1, 900))
