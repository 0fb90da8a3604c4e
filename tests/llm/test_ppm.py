import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from evenkeel.llm import ppm
from evenkeel.llm.words import WordHashes


def brute(train, texts, order=5):
    """PPM with exclusion, symbol by symbol; add-one words."""
    top = defaultdict(Counter)
    sym = lambda t: [0] * order + [b + 1 for b in (t or "").encode().lower()] + [257]
    for t in train:
        a = sym(t)
        for i in range(order, len(a)):
            top[tuple(a[i - order : i])][a[i]] += 1
    levels = {order: top}
    for k in range(order - 1, -1, -1):
        levels[k] = defaultdict(Counter)
        for ctx, c in levels[k + 1].items():
            for s in c:
                levels[k][ctx[1:]][s] += 1
    words = Counter()
    for t in train:
        words.update([*(t or "").encode().lower().split(), None])
    n, v = sum(words.values()), len(words)
    out = []
    for t in texts:
        a, score = sym(t), 0.0
        for i in range(order, len(a)):
            out_of, done = set(), False
            for k in range(order, -1, -1):
                c = {s: x for s, x in levels[k].get(tuple(a[i - k : i]) if k else (), {}).items() if s not in out_of}
                if not c:
                    continue
                m = sum(c.values())
                if a[i] in c:
                    score += math.log10((c[a[i]] - 0.5) / m)
                    done = True
                    break
                score += math.log10(len(c) / (2 * m))
                out_of |= set(c)
            if not done:
                score -= math.log10(257 - len(out_of))
        w = [*(t or "").encode().lower().split(), None]
        out.append((len(w), sum(words[x] > 0 for x in w), n, sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w), score))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["An", "ber", "çe", "do", "el"]) + rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [None, "", "  ", texts[3], texts[3], "unseen ÿ words", "A" * 300]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item int")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want = brute([t for t, h in zip(texts, held) if not h], texts)
    for most in ((10**6, 10**6), (40, 300)):  # with broadcast tables, and with joins in their place
        got = {r.id: r for r in ppm.score_texts(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, most=most).collect()}
        for i, w in enumerate(want):
            g = got[i]
            assert (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
            assert math.isclose(g.base_score, w[3], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g.score, w[4], rel_tol=1e-9, abs_tol=1e-9)


def test_no_training_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "ab"), (None, None)], "doc_id long, text string")
    got = {r.id: r.score for r in ppm.score_texts(df, F.lit(False)).collect()}
    assert math.isclose(got[1], -3 * math.log10(257)) and math.isclose(got[None], -math.log10(257))
    assert ppm.score_texts(df.limit(0), F.lit(True)).count() == 0


ODD = [b"", b" ", b"a", b"\0", b"a\0 a \0a \0\0", b"\t\x0b\x0c\r\nx\x1cy\x85 z ", b"12345678 123456789 1234567 1234567\0", b"1234567812345678 12345678123456789 123456781234567 1234567812345679",
       "\u00e9t\u00e9 \u3000x".encode(), b"x" * 5000, b"end", b""]


def test_words_of_a_run_are_hashed_as_the_words_of_its_texts():
    """Equal words have equal hashes, other words others, whatever lies beside them; words over 16 bytes included."""
    got, sizes = ppm.word_hashes(ODD, WordHashes())
    words = [w for t in ODD for w in [*t.split(), None]]
    assert sizes.tolist() == [len(t.split()) + 1 for t in ODD] and len(got) == len(words)
    pairs = set(zip(words, got.tolist()))
    assert len(pairs) == len(set(words)) == len(set(got.tolist()))
    assert dict(pairs)[b"x" * 5000] == xxhash.xxh3_64_intdigest(b"x" * 5000)
    for order in (0, 1, 5):
        g, n = ppm.grams(ODD, order)
        alone = [ppm.grams([t], order)[0] for t in ODD]
        assert n.tolist() == [len(t) + 1 for t in ODD] and g.tolist() == np.concatenate(alone).tolist()
        a = [0] * order + [b + 1 for b in ODD[4]] + [257]
        assert alone[4].tolist() == [sum(x << 9 * (order - j) for j, x in enumerate(a[i : i + order + 1])) for i in range(len(ODD[4]) + 1)]


def test_lookup_equals_a_dictionary():
    """Keys of one home and at the table's end (multiples of the multiplier's inverse have the hashes wanted), unknown keys, none."""
    back = np.uint64(pow(int(ppm.M1), -1, 1 << 64))
    high = (np.uint64(0xFFFFFFFFFFFFFFFF) - np.arange(200, dtype=np.uint64)) * back
    low = np.arange(1, 200, dtype=np.uint64) * back
    keys = np.concatenate([high[::2], low[::2]]).view(np.int64)
    want = dict(zip(keys.tolist(), np.arange(len(keys)) * 0.5))
    ask = np.concatenate([high, low, np.array([0, 1, 2**63], np.uint64)]).view(np.int64)
    for block in (7, 1 << 15):
        got = ppm.Lookup(keys, np.arange(len(keys)) * 0.5)(ask, block)
        assert [None if math.isnan(x) else x for x in got] == [want.get(k) for k in ask.tolist()]
    none = ppm.Lookup(keys[:0], np.zeros(0))
    assert np.isnan(none(ask)).all() and len(none(ask[:0])) == 0


def test_texts_are_looked_up_by_run_not_one_by_one():
    """3,000 short texts need two lookups, not 6,000; rare items come once a text with their number, whatever the run's size."""
    texts = ["Ab ab q", None, "zz zz zz"] * 1000
    calls = []

    class Counting(ppm.Lookup):
        def __call__(self, keys, *more):
            calls.append(len(keys))
            return super().__call__(keys, *more)

    words, _ = ppm.word_hashes([b"ab"], WordHashes())
    common = Counting(words.view(np.int64), np.array([2.0, 3.0]))
    code = Counting(ppm.grams([b"ab ab q"], 2)[0].view(np.int64), np.full(8, -1.0))
    n = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([n, n, n, pa.array(texts)], ["id", "k1", "k2", "text"])
    got = pa.Table.from_batches(ppm.score_batches([batch], common, code, 2)).to_pylist()
    assert calls == [sum(len((t or "").split()) + 1 for t in texts), sum(len(t or "") + 1 for t in texts)]
    assert [r["id"] for r in got] == list(range(3000))
    a, b, c = got[:3]
    assert (a["n_tokens"], a["known"], a["logs"], len(a["words"]), a["score"], a["grams"]) == (4, 3, 7.0, 1, -8.0, [])
    assert (b["n_tokens"], b["known"], b["logs"], b["words"], len(b["grams"])) == (1, 1, 3.0, [], 1)
    assert [x["m"] for x in c["words"]] == [3] and sum(x["m"] for x in c["grams"]) == 9 and sorted(x["m"] for x in c["grams"])[-1] == 2
    assert all({**x, "id": 0, "k1": 0, "k2": 0} == {**got[i % 3], "id": 0, "k1": 0, "k2": 0} for i, x in enumerate(got))
