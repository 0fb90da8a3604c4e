import hashlib
import random
from collections import Counter

import numpy as np

from evenkeel.llm import bwt
from tests.llm.brute import repeats


def test_merge_against_counting():
    rng = random.Random(1)
    for _ in range(40):
        alpha = rng.choice([b"ab", b"abc", bytes(range(255))])
        base = bytes(rng.choice(alpha) for _ in range(300))
        s = [base[a : a + rng.randrange(20, 120)] + bytes(rng.choice(alpha) for _ in range(rng.randrange(40))) for a in (rng.randrange(200) for _ in range(6))] + [b"a" * 90]
        m = rng.choice([16, 32, 48])
        n = Counter(x[i : i + m] for x in s for i in range(len(x) - m + 1))
        for x, got in zip(s, bwt.repeated_windows(s, m, rng.choice([30, 100, 10**6]))):
            assert got.tolist() == [n[x[i : i + m]] > 1 for i in range(len(x) - m + 1)]


def test_pieces_hold_every_window_once():
    raw = bytes(np.random.default_rng(0).integers(97, 100, 3000, dtype=np.uint8)) + b"z" * 900
    s, n, k, p = bwt.pieces(raw, 400)
    assert all(bwt._gram_hashes(np.frombuffer(raw[a + x : a + x + bwt.GRAM], np.uint8))[0] == h for a, x, h in zip(s, p, k))
    assert s[0] == 0 and (s[1:] == s[:-1] + n[:-1]).all() and s[-1] + n[-1] == len(raw) - 399


def check(spark, texts, length, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r.doc_id: r for r in bwt.remove_repeats(df, length=length, **options).collect()}
    raw, flags = repeats(texts, length)
    assert len(got) == len(texts)
    for i, (r, f) in enumerate(zip(raw, flags)):
        kept = bytes(b for b, x in zip(r, f) if not x)
        assert bytes(got[i].kept) == kept, i
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(r), sum(f), sum(x and not y for x, y in zip(f, [False, *f])))


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: " ".join(rng.choice(["ä", "be", "ce", "dé", "eff"]) + str(rng.randrange(500)) for _ in range(n))
    passage, doc = word(60), word(200)
    texts = [None, "", "short", doc, doc, doc[:300] + "x" + doc[301:], word(50) + passage + word(50), passage, word(10) + passage[5:], word(30) + passage[:-40] + word(30), "tick " * 300, word(300) + "tick " * 90, "q" * 700, word(400)]
    check(spark, texts, 200)
    check(spark, texts, 200, hot=1, shard=500)
    check(spark, texts, 200, hot=4, shard=500)
    assert bwt.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_real_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = df.collect()
    raw, flags = repeats([r.text for r in rows], 400)
    got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in bwt.remove_repeats(df).collect()}
    assert got == {r.doc_id: hashlib.sha256(bytes(b for b, x in zip(t, f) if not x)).hexdigest() for r, t, f in zip(rows, raw, flags)}


def test_planted_passages_and_hot_near_copies(spark):
    """Passages of 300 to 600 bytes in other texts, and near copies that share a minimizer with very many others."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [letters(n) for n in (300, 390, 399, 400, 401, 450, 600)]
    texts = [letters(rng.randrange(500)) + p + letters(rng.randrange(500)) for p in passages for _ in range(4)]
    base = letters(900)
    for i in range(60):
        a = rng.randrange(850)
        texts.append(base[:a] + f"<{i:04d}>" + base[a + 6 :])
    check(spark, texts, 400, hot=10)
    check(spark, texts, 400, hot=10_000)


def test_hot_pieces_make_few_rows(spark):
    """Near copies cut again part where they differ: rows grow with the pieces, not with their windows."""
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = []
    for i in range(1600):
        a = rng.randrange(650)
        t = (base[:a] + f"<{i:04d}>" + base[a + 6 :]).encode()
        rows += [(int(np.uint64(k).astype(np.int64)), i, j, int(q), t[s : s + n + 399]) for j, (s, n, k, q) in enumerate(zip(*bwt.pieces(t, 400)))]
    df = spark.createDataFrame(rows, "key long, d1 long, d2 long, p long, piece binary")
    parts = bwt._cut_again(df, 400)
    assert parts.count() < 4 * len(rows)
    # what is left of the common text starts or ends at the difference: as many pieces as places, however many copies
    hottest = lambda d, k, *x: d.groupBy(k).agg(bwt.F.countDistinct(*x).alias("c")).agg(bwt.F.max("c")).first()[0]
    assert hottest(parts, "key2", "e1", "e2") < 2 * 369 < hottest(df, "key", "d1", "d2")


def passages(texts, m, words):
    """For each text the number of runs that repeated m-byte strings cover and that hold so many words, and their bytes."""
    out = []
    for r, flags in zip(*repeats(texts, m)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.array(flags, np.int8), [0]])))
        held = [int(b - a) for a, b in zip(edge[::2], edge[1::2]) if len(r[a:b].split()) >= words]
        out.append((len(held), sum(held)))
    return out


def check_both(spark, texts, length, also, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bwt.remove_repeats(df, length=length, passages=also, **options).collect()}
    assert [(got[i].n_passages, got[i].passage_bytes) for i in range(len(texts))] == passages(texts, *also)
    raw, flags = repeats(texts, length)
    assert [bytes(got[i].kept) for i in range(len(texts))] == [bytes(b for b, x in zip(r, f) if not x) for r, f in zip(raw, flags)]


def test_passages_of_over_50_words_under_400_bytes(spark):
    """Passages that are too short to be removed are counted beside what is removed, from the same merge, hot or not."""
    rng = random.Random(10)
    word = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(n))
    planted, lone = [word(n) for n in (50, 51, 55, 60, 70, 90)], [word(150) for _ in range(20)]
    texts = [None, "", *lone] + [f"{word(rng.randrange(1, 80))} {p} {word(rng.randrange(1, 80))}" for p in planted for _ in range(3)]
    texts += [lone[0], "tick " * 300, planted[1], "q" * 900]
    base = word(160)
    for i in range(30):
        a = rng.randrange(len(base) - 6)
        texts.append(base[:a] + f"<{i:04d}>" + base[a + 6 :])
    short = [i for i, (n, _) in enumerate(passages(texts, 240, 51)) if n and not any(repeats(texts, 400)[1][i])]
    assert len(short) >= 6  # passages that 400 bytes leave in
    check_both(spark, texts, 400, (240, 51))
    check_both(spark, texts, 400, (240, 51), hot=1, shard=500)
    check_both(spark, texts, 400, (240, 51), hot=8)
    check_both(spark, texts, 240, (400, 51), hot=8)
    check_both(spark, texts, 300, (300, 40))


def test_pieces_of_two_lengths_hold_the_windows_of_both(monkeypatch):
    raw = bytes(np.random.default_rng(3).integers(97, 100, 9000, dtype=np.uint8)) + b"z" * 900
    for chunk in (bwt.CHUNK, 1000, 9870):
        monkeypatch.setattr(bwt, "CHUNK", chunk)
        s, n, k, p = bwt.pieces(raw, 240, longest=400)
        assert len(set((s + p).tolist())) == len(s)  # a piece for each minimizer
        for m in (240, 400):
            low, last = bwt._bounds(m, p, n + 239)
            assert sorted(x for a, b, c in zip(s, low, last) for x in range(a + b, a + c + 1)) == list(range(len(raw) - m + 1))


def test_query_counts_passages(spark):
    from evenkeel.llm.queries import op9_bwt_dedup

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r for r in op9_bwt_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert [(got[i].n_passages, got[i].passage_bytes) for i in texts] == passages(list(texts.values()), 240, 51)
    assert any(r.n_passages and not r.n_removed for r in got.values())
