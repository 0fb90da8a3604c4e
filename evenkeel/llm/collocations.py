"""Phrase collocations from sorted count streams.

The only thing counted in the texts is, for each word, the run of ``longest``
words that starts there, filled up with an empty word behind the end of its
piece. Tasks sort and count these runs for some million words at a time and send
every stretch of the sorted stream to the range of runs that it belongs to, as
one packed block. In a range the blocks are merged into one stream in prefix
order, and one pass over it adds up every shorter prefix, so words, pairs and
so on need no counting of their own.

What occurs often enough stands in one small table of counts. Kept in prefix
order it is joined, in lockstep, with each phrase's first words (left counts),
in suffix order with its last words (right counts), and a phrase's extensions
by one word are the longer phrases that begin or end with it. These are merge
joins of sorted streams; no table is hashed into memory or broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

#: Words (and bytes) that a task counts at a time, bytes of text for each range, the most ranges, and sampled runs for each range.
CHUNK_WORDS, CHUNK_BYTES, RANGE_BYTES, MAX_RANGES, PER_RANGE = 1_000_000, 16 << 20, 16 << 20, 1 << 18, 20
#: Bytes of a word that a border between ranges keeps; any run of words can be a border.
BORDER_BYTES = 64

#: A-Z to a-z, the signs that end a piece to newlines, tabs to spaces.
_SIGNS = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")


class _Words(dict):
    """word -> number in order of first sight; the empty word is 0."""

    def __init__(self):
        super().__init__({b"": 0, b"\xff": 0})  # no word of UTF-8 has this byte: it marks the end of a piece

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self) - 1
        return n


def words_of(text: bytes) -> list[bytes]:
    """Words, with a mark after each piece."""
    text = text.replace(b"\xff", b"\xef\xbf\xbd").translate(_SIGNS).replace(b"\n", b" \xff ").split()
    text.append(b"\xff")
    return text


def runs(t: np.ndarray, m: int) -> list[np.ndarray]:
    """Columns of the runs of ``m`` words from each word of ``t``, where 0 ends a piece; 0 behind the end."""
    t = np.concatenate([t, np.zeros(m, t.dtype)])
    at = np.flatnonzero(t)
    cols = [t[at]]
    for j in range(1, m):
        cols.append(np.where(cols[-1] == 0, 0, t[at + j]).astype(t.dtype))
    return cols


def merged(cols: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in order, with their numbers (or the sums of ``counts``)."""
    n = len(cols[0])
    if not n:
        return cols, np.zeros(0, np.int64)
    key, bits = cols[0].astype(np.uint64), int(cols[0].max()).bit_length()
    for c in cols[1:]:
        more = int(c.max()).bit_length()
        if bits + more > 64:  # ranks in place of values keep the order
            u, key = np.unique(key, return_inverse=True)
            key, bits = key.astype(np.uint64), len(u).bit_length()
        key, bits = key << np.uint64(more) | c, bits + more
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rows = order[first]
    sums = np.diff(np.append(first, n)) if counts is None else np.add.reduceat(counts[order], first, dtype=np.int64)
    return [c[rows] for c in cols], sums.astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def packed(words: list[bytes], cols: list[np.ndarray], counts: np.ndarray) -> bytes:
    """A block: its words, the columns as places among them, the counts."""
    used = np.unique(np.concatenate(cols))
    parts = [b"\n".join([words[i] for i in used])]
    parts += [(a := _narrow(np.searchsorted(used, c))).dtype.char.encode() + a.tobytes() for c in cols]
    parts.append((a := _narrow(counts)).dtype.char.encode() + a.tobytes())
    head = np.array([len(parts), *map(len, parts)], np.uint64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpacked(block: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    size = np.frombuffer(raw, np.uint64, n, 8).astype(np.int64)
    at = 8 * (n + 1) + np.concatenate([[0], np.cumsum(size)])
    parts = [raw[a:b] for a, b in zip(at, at[1:])]
    *cols, counts = [np.frombuffer(p, p[:1].decode(), -1, 1) for p in parts[1:]]
    return parts[0].split(b"\n"), cols, counts.astype(np.int64)


def place(words: list[bytes], cols: list[np.ndarray], border: tuple[bytes, ...]) -> int:
    """How many of the sorted rows lie before ``border``."""
    low, high = 0, len(cols[0])
    for c, w in zip(cols, border):
        i = bisect_left(words, w)
        start = low + int(np.searchsorted(c[low:high], i, "left"))
        if i == len(words) or words[i] != w:
            return start
        low, high = start, low + int(np.searchsorted(c[low:high], i, "right"))
    return low


def _stretches(words: _Words, tokens: dict[bytes, list[np.ndarray]], borders: list[tuple], m: int) -> Iterator[tuple[int, bytes, bytes]]:
    """``(range, lang, block)`` of what a task has read."""
    known = sorted(w for w in words if w != b"\xff")
    rank = np.empty(len(known), np.uint32)
    rank[[words[w] for w in known]] = np.arange(len(known), dtype=np.uint32)
    for lang, parts in tokens.items():
        cols, counts = merged(runs(rank[np.concatenate(parts)], m))
        low, high = bisect_left(borders, (lang,)), bisect_left(borders, (lang + b"\0",))
        ends = [place(known, cols, b[1:]) for b in borders[low:high]] + [len(counts)]
        start = 0
        for k, end in enumerate(ends):
            if end > start:
                yield low + k, lang, packed(known, [c[start:end] for c in cols], counts[start:end])
            start = end


def _blocks(borders: list[tuple], m: int):
    names = ["range", "lang", "block"]

    def run(batches):
        words, tokens, n, size = _Words(), {}, 0, 0

        def flush():
            for row in _stretches(words, tokens, borders, m):
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.binary())], names)

        for b in (big.slice(i, 64) for big in batches for i in range(0, big.num_rows, 64)):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                found = words_of(text)
                tokens.setdefault(lang, []).append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                n, size = n + len(found), size + len(text)
                if n >= CHUNK_WORDS or size >= CHUNK_BYTES:
                    yield from flush()
                    words, tokens, n, size = _Words(), {}, 0, 0
        if tokens:
            yield from flush()

    return run


def _sums(least: int, m: int):
    """Of a range: phrases with their counts, those at its ends whatever they have, and the number of words."""

    def run(blocks: pa.Table) -> pa.Table:
        out: list[tuple[bytes, int, bytes, int]] = []
        by_lang: dict[bytes, list[bytes]] = {}
        for lang, block in zip(blocks["lang"].to_pylist(), blocks["block"].to_pylist()):
            by_lang.setdefault(lang, []).append(block)
        for lang, packs in by_lang.items():
            number: dict[bytes, int] = {}
            parts = []
            for pack in packs:  # numbers by first sight, then by order
                words, part, n = unpacked(pack)
                to = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words))
                parts.append(([to[c] for c in part], n.astype(np.uint32) if n.max() < 1 << 32 else n))
            known = sorted(number)
            rank = np.empty(len(known), np.uint32)
            rank[np.fromiter(map(number.__getitem__, known), np.int64, len(known))] = np.arange(len(known), dtype=np.uint32)
            empty = 0 if known[0] == b"" else -1
            del number
            cols, counts = merged([rank[np.concatenate([p[j] for p, _ in parts])] for j in range(m)], np.concatenate([n for _, n in parts]))
            del parts
            out.append((lang, 0, b"", int(counts.sum())))
            new = np.zeros(len(counts), bool)
            new[0] = True
            for k in range(1, m + 1):
                c = cols[k - 1]
                new[1:] |= c[1:] != c[:-1]
                first = np.flatnonzero(new)
                total = np.add.reduceat(counts, first)
                wanted = total >= least
                wanted[[0, -1]] = True  # they may go on in the ranges beside
                for i in np.flatnonzero(wanted & (c[first] != empty)):
                    out.append((lang, k, b" ".join([known[x[first[i]]] for x in cols[:k]]), int(total[i])))
        return pa.table({n: pa.array(list(v), t) for n, v, t in zip(["lang", "k", "phrase", "f"], zip(*out), [pa.binary(), pa.int32(), pa.binary(), pa.int64()])})

    return run


def borders_of(texts: DataFrame, ranges: int, n_bytes: int, n_texts: int, m: int) -> list[tuple]:
    """Runs of words that part all runs into some ``ranges`` of like size, from a sample of ``PER_RANGE`` runs for each; where they lie changes no result."""
    wanted = ranges * PER_RANGE
    fraction = min(1.0, 4 * wanted / max(1, n_texts))
    step = max(1, int(n_bytes * fraction / 6 / wanted))

    def sample(batches):
        for b in batches:
            rows = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                found = words_of(text)
                for i in range(len(text) % step, len(found), step):
                    run = [w[:BORDER_BYTES] for w in found[i:i + m]]
                    run = run[:run.index(b"\xff")] if b"\xff" in run else run
                    if run:
                        rows.append([lang, *run, *[b""] * (m - len(run))])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.binary()))], ["run"])

    got = sorted(tuple(r) for r in (texts.sample(fraction, 0) if fraction < 1 else texts).mapInArrow(sample, "run array<binary>").toArrow()["run"].to_pylist())
    return sorted({got[i * len(got) // ranges] for i in range(1, ranges)}) if got else []


def phrase_counts(df: DataFrame, longest: int = 3, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, k, phrase, f`` of all phrases of 1 to ``longest`` words that occur at least ``least`` times, and rows of ``k`` = 0 with each language's number of words."""
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MAX_RANGES, max(2 * parts, -(-size["bytes"] // RANGE_BYTES)))
    borders = borders_of(texts, ranges, size["bytes"], size["n"], longest)
    blocks = texts.mapInArrow(_blocks(borders, longest), "range int, lang binary, block binary")
    found = blocks.groupBy("range").applyInArrow(_sums(least, longest), "lang binary, k int, phrase binary, f long")
    found = found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(f"f >= {int(least)} or k = 0")
    return cut(found.select(F.col("lang").cast("string").alias("lang"), "k", F.col("phrase").cast("string").alias("phrase"), "f"), "phrases")


def collocations(df: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's phrases of 2 to ``longest`` words by how much more often they occur than their parts: ``lang, rank, phrase, a, l, r, n, score``.

    A-Z are lower-cased; texts fall into pieces at ``.,;:!?`` and line ends, and
    pieces into words at spaces and tabs. ``a`` counts all occurrences within
    pieces. Cut after its first ``k`` words a phrase scores floor(10^6 a^2 / (l
    r)) of its parts' counts, exactly for counts below 10^16, and the cut of the
    least score (then of the least ``k``) stands for it. Phrases inside longer
    ones that occur at least ``inside`` in 100 times as often go. Ranks go by
    score, ``a`` and the phrase's bytes; ``top`` None ranks all. A null language
    is ``und``, a null text empty; repeated rows count each time, and other
    columns don't matter. No table or no phrase gives no rows.
    """
    counts = phrase_counts(df, longest, least, lang_col, text_col)
    part = lambda name, n: counts.where(f"k between 1 and {longest - 1}").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(n)).hint("merge")
    cand = counts.where("k >= 2")
    cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    first, rest = F.expr("substring_index(phrase, ' ', cut)"), F.expr("substring_index(phrase, ' ', cut - k)")
    for side, n in ((first, "l"), (rest, "r")):
        p = part(side, n)
        cuts = cuts.withColumn("_side", side).join(p, (F.col("lang") == p["_lang"]) & (F.col("_side") == p["_part"])).drop("_lang", "_part", "_side")
    wide = {c: F.col(c).cast("decimal(20,0)") for c in ("f", "l", "r")}
    cuts = cuts.withColumns({f"_{c}": x for c, x in wide.items()}).withColumn("score", F.expr("cast((1000000BD * (_f * _f)) div (_l * _r) as long)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", F.col("f").alias("a"))).alias("best")).select("lang", "phrase", "best.*")
    longer = cand.where("k >= 3").select("lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_longer")).hint("merge")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(f"not coalesce(100 * cast(_longer as decimal(20,0)) >= {int(inside)} * cast(a as decimal(20,0)), false)")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # the best of 64 shares of each language first, so that no task ranks all of one
        share = Window.partitionBy("lang", "_share").orderBy(*order)
        kept = kept.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_r", F.row_number().over(share)).where(f"_r <= {int(top)}")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(f"rank <= {int(top)}")
    size = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(size, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(table: str = "documents") -> str:
    """The contract's rows over ``table`` as SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(text, '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) piece FROM {table}),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) phrase FROM w, (SELECT unnest([1, 2, 3]) k)),
c AS (SELECT lang, k, phrase, count(*) f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT n FROM c WHERE k = 1 GROUP BY ALL),
s AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') ws, unnest(range(1, k)) j FROM c WHERE k >= 2 AND f >= 10),
z AS (SELECT s.lang, s.phrase, s.f a, x.f l, y.f r, j, (1000000::HUGEINT * s.f * s.f) // (x.f::HUGEINT * y.f) score FROM s
 JOIN c x ON x.lang = s.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN c y ON y.lang = s.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) i FROM z),
e AS (SELECT lang, phrase, max(f) f FROM (SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) phrase FROM s WHERE k = 3) GROUP BY ALL),
k AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) "rank" FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE i = 1 AND NOT coalesce(100 * e.f >= 50 * a, false))
SELECT k.lang, "rank"::BIGINT AS "rank", phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM k JOIN n ON n.lang = k.lang WHERE "rank" <= 2000"""
