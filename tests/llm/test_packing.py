import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from evenkeel.llm import packing


def test_squares_rule_by_hand():
    p = packing.SquaresPacker(10)
    assert p.place(6, False) == (0, 0) and p.place(6, False) == (1, 0)  # gaps 4, 4
    assert p.place(3, False) == (1, 6)  # gaps 4, 1
    # 1 into gap 1 closes it (1 - 2), into gap 4 leaves 3: 2 (0 - 1) + 2 = 0
    assert p.place(1, False) == (1, 9)


def test_few_bins():
    rng = random.Random(2)
    lengths = np.array([min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(4000)])
    where, offset = packing.pack_lengths(lengths)
    bins = defaultdict(list)
    for b, o, n in zip(where, offset, lengths):
        bins[b].append((o, n))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-lengths.sum() // 2048) * 1.01 + 1


def test_against_the_tokenizer(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "a", "Grüße <|endoftext|> x", "it's   spaced\n\n out 123,456", "word " * 5000, "ß" * 3000, "日本語 текст"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(1, "", 0)], "doc_id long, text string, piece int")
    got = packing.pack_documents(df).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        ids = np.array(tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        rows = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == i)
        if i != 1:
            assert [p for p, *_ in rows] == list(range(-(-n // 2048))) and sum(r[2] for r in rows) == n
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_tokenizer_on_all_given_texts_and_odd_ones(spark):
    tok, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.load_tokenizer()
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(3)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x530), rng.randrange(0xD800), rng.randrange(0x10000, 0x20000), 32, 10])) for _ in range(40)) for _ in range(3000)]
    texts += ["x" * 5000, "it's IT'S they'll  \t\r\n \u00a0 \u2003x", "<|endoftext|>"]
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids(some)] == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]


def test_layout_costs_no_sequences(spark):
    """Long documents together in one partition, short ones in others: as few sequences as if they were mixed."""
    rows = [(i, "one two " * 550) for i in range(200)] + [(1000 + i, "one two " * 230) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id")
    got = packing.pack_documents(df).collect()
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= -(-total // 2048) * 1.03 + 1
    stretch = packing.pack_documents(df, group=100, order=[packing.F.col("doc_id")]).collect()
    part = {r.doc_id: r.sequence_id >> 40 for r in stretch}
    assert len(set(part.values())) > 3 and all(part[a] <= part[b] for a, b in zip(sorted(part), sorted(part)[1:]))
