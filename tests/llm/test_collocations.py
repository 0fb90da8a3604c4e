import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from evenkeel.llm import collocations, queries


def brute(rows, least=10, inside=50, top=2000, longest=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    drop = set()
    for (lang, p), a in cand.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and 100 * a >= inside * f[lang, p[i:j]]:
                    drop.add((lang, p[i:j]))
    by = defaultdict(list)
    for (lang, p), a in cand.items():
        if (lang, p) in drop:
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        by[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, xs in by.items() for i, (score, a, p, left, right) in enumerate(sorted(xs)[:top], 1))


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["new", "York", "NEW", "é", "ß", "of", "the", "a", "\x01", "漢字", "b\xa0c", "x" * 90, "x" * 90 + "y", "İ"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(rng.randrange(60)):
            t += rng.choice(words[:12] if rng.random() < 0.7 else words) + rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "; ", "!", "\x1c"])
            if rng.random() < 0.1:
                t += "machine learning model of the a "
        rows.append((rng.choice(["en", "en", "de", None, "", "und", "e", "zz"]), rng.choice([t, t, t, t, None, "", " ", "one"])))
    return rows + [("en", "hot line of words again and again. " * 400)] + [("de", "copy of a copy of one text")] * 30 + [("fr", "never ten times")]


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS score", "'q' AS phrase", "2 AS k")
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).select(COLUMNS).collect())


def test_equals_brute_force_and_sql(spark):
    rows = texts(400)
    got, want = run(spark, rows), brute(rows)
    assert got == want and len({r[0] for r in got}) > 3 and any(r[2].count(" ") == 2 for r in got)
    c = duckdb.connect()
    c.execute("create table documents (lang varchar, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    rel = c.execute(queries.oracle_sql()["op12_phrase_streams"])
    assert [d[0] for d in rel.description] == COLUMNS
    assert sorted(rel.fetchall()) == want


@pytest.mark.parametrize("chunk,width", [(50, 200), (700, 1000)])
def test_small_chunks_and_many_ranges(spark, monkeypatch, chunk, width):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "RANGE_BYTES", width)
    monkeypatch.setattr(collocations, "BORDER_BYTES", 5)
    rows = texts(150, 3)
    assert run(spark, rows, least=4, inside=80) == brute(rows, 4, 80)
    assert run(spark, rows, least=2, longest=2, top=7) == brute(rows, 2, 50, 7, 2)


def test_longer_phrases_and_all_ranks(spark):
    rows = texts(120, 5)
    assert run(spark, rows, least=5, longest=5, top=None) == brute(rows, 5, 50, 10**9, 5)


def test_empty(spark):
    assert run(spark, [("en", None)]) == [] and run(spark, [(None, "one two")] * 9) == []
    df = spark.createDataFrame([("en", "a b")], "lang string, text string")
    assert collocations.collocations(df.limit(0)).count() == 0
    assert run(spark, [(None, "one two")] * 10) == [("und", 1, "one two", 10, 10, 10, 20, 1000000)]


def test_streams():
    rng = np.random.default_rng(1)
    for top in (3, 2**20, 2**31):
        cols, counts = [rng.integers(0, top, 500).astype(np.uint32) for _ in range(4)], rng.integers(1, 9, 500)
        rows = Counter()
        for *r, n in zip(*cols, counts):
            rows[tuple(map(int, r))] += int(n)
        got, sums = collocations.merged(cols, counts)
        assert list(zip(*(c.tolist() for c in got), strict=True)) == sorted(rows) and sums.tolist() == [rows[r] for r in sorted(rows)]
    words = [b"", b"a", b"ab", b"b"]
    cols, counts = [np.array([1, 1, 2, 3], np.uint32), np.array([0, 2, 3, 1], np.uint32)], np.array([1, 70000, 2, 300])
    w, c, n = collocations.unpacked(collocations.packed(words, cols, counts))
    assert w == words and [x.tolist() for x in c] == [x.tolist() for x in cols] and n.tolist() == counts.tolist()
    as_words = [tuple(words[x[i]] for x in cols) for i in range(4)]
    for border in [(b"", b""), (b"a", b"a"), (b"a", b"ab"), (b"a", b"abc"), (b"aa", b"z"), (b"ab", b"b"), (b"b", b"a"), (b"c", b"")]:
        assert collocations.place(words, cols, border) == sum(r < border for r in as_words)
