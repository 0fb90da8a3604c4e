"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

Only strings that can repeat are sorted. A window of ``length`` bytes has a
minimizer: the least hash of its 32-byte substrings, leftmost on ties. Equal
windows have equal minimizers, so a text is cut into pieces, each with the
windows of one minimizer, and pieces meet by that hash:

1. every text gives its pieces (hash, place, digest; no text);
2. equal pieces are counted first: all their windows repeat;
3. minimizers with different pieces: the distinct ones, with their text, are
   dealt by hash. A task transforms them in shards of bounded size and merges
   the shards: the interleave of their suffix orders is refined up to 16 bytes a round
   until it is right for ``length`` bytes. Entries that never were parted share
   that prefix: these blocks are the repeated intervals, and no merged suffix
   is sorted again;
4. windows found in both ways become spans of their texts.

In step 3 a piece goes on only if another piece of its minimizer has the same
bytes around it, nearly as many as a window holds: without that no window can
repeat. Only the places where its windows begin take part in the merge. Within a piece none does, as its windows have the minimizer
at different places.

Windows of two lengths go one way together: the minimizer of a longer window is
that of a shorter one, so one piece holds both kinds, and one merge answers for
both, after the rounds of each.

A minimizer with more than ``hot`` distinct pieces is no single task: its pieces
are cut again, now at the rarest substring of each window instead of the one
with the least hash, so that texts that differ somewhere part there; what they
have in common is one piece. Only what shares its rarest substring with more
than ``hot`` pieces once more is dealt by a digest of the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import cut
from evenkeel.llm.neardup import with_text_key
from evenkeel.llm.words import M1, mix, utf8

LENGTH, GRAM, STEP, SHARD, HOT, PARTS = 400, 32, 16, 65_536, 4000, 8  # STEP: most bytes a refinement round takes; PARTS: cuts of _may_repeat
PASSAGES = 240, 51  # bytes that 99 % of all runs of 51 words have, and these words: passages of over 50 words
SLOTS = 20  # bits of the table that counts substrings of hot pieces, 8 MB
CHUNK = 1 << 19


def _gram_hashes(a: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position (by doubling, modulo 2**64)."""
    h, k, base = a.astype(np.uint64) + np.uint64(1), 1, M1
    while k < GRAM:
        h = h[:-k] * base + h[k:]
        base = np.uint64(int(base) ** 2 % 2**64)
        k *= 2
    return mix(h)


def _least(m: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` consecutive numbers (by doubling)."""
    width = 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (span - width)], m[span - width :]) if width < span else m


def pieces(raw: bytes, length: int, often: np.ndarray | None = None, longest: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, minimizer hash and its place (from the first window) of each piece, in order; together all windows.

    With ``often``, counts by the leading bits of a hash, the least is the rarest, and the least hash among these.
    With ``longest`` a piece also holds the windows of that length that have its minimizer: these minimizers are some
    of the shorter windows', and the piece grows on both sides, by bytes in which its minimizer stays the least.
    """
    longest = max(length, longest)
    starts, counts, keys, places = [], [], [], []
    for at in range(0, len(raw) - GRAM + 1 if len(raw) >= length else 0, CHUNK):  # positions fit in 20 bits; a chunk gives the pieces whose minimizers begin in it
        low = max(0, at - longest)
        h = _gram_hashes(np.frombuffer(raw, np.uint8, min(len(raw) - low, at - low + CHUNK + longest), low))
        m = (h >> np.uint64(20)) << np.uint64(20)
        if often is not None:
            m = (often[(h >> np.uint64(64 - SLOTS)).astype(np.int64)] << np.uint64(48)) | ((h >> np.uint64(36)) << np.uint64(20))
        m |= np.arange(len(h), dtype=np.uint64)
        m = _least(m, length - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        place = (m[first] & np.uint64((1 << 20) - 1)).astype(np.int64)
        n = np.diff(np.append(first, len(m)))
        if longest > length and len(m) > longest - length:
            m = _least(m, longest - length + 1)
            wide = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
            i = np.searchsorted(place, (m[wide] & np.uint64((1 << 20) - 1)).astype(np.int64))
            first[i], n[i] = wide, np.diff(np.append(wide, len(m))) + longest - length
        mine = (place + low >= at) & (place + low < at + CHUNK)
        first, n, place = first[mine], n[mine], place[mine]
        starts.append(first + low)
        counts.append(n)
        keys.append(h[place])
        places.append(place - first)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys), np.concatenate(places)


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of ``key`` and the sorted keys; the position (below ``2 ** bits``) rides in the low bits."""
    if int(key.max(initial=0)) >> (63 - bits):
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort((key << bits) | np.arange(len(key)))
    return both & ((1 << bits) - 1), both >> bits


def suffix_order(text: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of all rotations of the strings in ``text`` (their numbers in ``group``, each string ends in a sentinel of its own).

    ``text`` holds small codes, sentinels below all bytes. Prefix doubling with
    rotation inside each string; a rank is the place of the first rotation that
    is equal so far, and only rotations that share one are sorted again.
    """
    n, bits = len(text), int(len(text)).bit_length()
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, n))
    start, long = first[group], size[group]
    place = np.arange(n) - start
    width = max(1, int(text.max(initial=0)).bit_length())
    k = max(1, (63 - bits) // width)
    key, at = text.astype(np.int64), place.copy()
    for _ in range(k - 1):  # k symbols at once
        at += 1
        at[at == long] = 0
        key = (key << width) | text[start + at]
    order, s = _sorted(key, bits)
    rank, some, old = np.empty(n, np.int64), order, np.zeros(n, np.int64)
    while True:
        head = np.concatenate([[True], s[1:] != s[:-1]])
        i = np.arange(len(s))
        top = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), i, 0))  # where the group shared so far began
        rank[some] = old + np.maximum.accumulate(np.where(head, i, 0)) - top
        alone = head & np.append(head[1:], True)
        if alone.all():
            break
        some = some[~alone]
        r = rank[some]
        order, s = _sorted((r << bits) | rank[start[some] + (place[some] + k) % long[some]], bits)
        some = some[order]
        old, k = s >> bits, 2 * k
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    """Dense ranks of 64-bit words."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    s = x[order]
    out[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
    return out


class Transform:
    """One shard: its rotations in order (``string``, ``place``), the words of ``step`` symbols before each and the row that begins there."""

    def __init__(self, strings: list[bytes], first: int, step: int):
        m, self.step = len(strings), step
        size = np.array([len(s) + 1 for s in strings])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        g = np.repeat(np.arange(m), size)
        start, long = begin[g], size[g]
        place = np.arange(len(g)) - start
        text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8).astype(np.int64)  # 255 is no byte of UTF-8
        end = place == long - 1
        order = suffix_order(np.where(end, g, text + m), g)
        word, k = np.where(end, 0, text + 1).astype(np.uint64), 1  # a sentinel is 0, below all bytes
        while k < 8:
            at = place + k
            word = (word << np.uint64(8 * k)) | word[start + np.where(at >= long, at - long, at)]
            k *= 2
        at = place - step
        source = start + np.where(at < 0, at + long, at)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.back = rank[source[order]]
        self.high = (word[source] >> np.uint64(8 * max(0, 8 - step)))[order]
        at = place - min(8, step)
        self.low = (word[start + np.where(at < 0, at + long, at)] >> np.uint64(8 * max(0, 8 - step)))[order]
        self.string, self.place = g[order] + first, place[order]
        self.mark = np.where(self.place < step, self.string + 1, 0)  # the sentinel is among the symbols: they tell its string


def _codes(shards: list[Transform], strings: int) -> np.ndarray:
    """The symbols before each rotation as one number, over all shards; ordered as the symbols are."""
    bits = int(sum(len(t.string) for t in shards)).bit_length()
    high, low, mark = (np.concatenate([getattr(t, x) for t in shards]) for x in ("high", "low", "mark"))
    pair = _ranks((_ranks(high) << bits) | _ranks(low))
    return (pair << int(strings + 1).bit_length()) | mark


def merge(shards: list[Transform], strings: int, rounds: list[int], wanted: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Interleave the shards: string, place and block of the rotations that share their first symbols with others, in merged order, after each of ``rounds``.

    Each round puts every entry behind the ``step`` symbols before it, keeping
    the order so far: the interleave of the shards after h rounds is right for
    h * step symbols, and entries of one block share them. An entry alone in
    its block can't come to share more, so it leaves; and only entries take part that get, by one of ``rounds``, to a
    place from the first to the last that ``wanted`` has for it and their string.
    """
    n, step = sum(len(t.string) for t in shards), shards[0].step
    flat, bits = _codes(shards, strings), int(n).bit_length()
    base = np.cumsum([0, *[len(t.string) for t in shards]])
    back = np.concatenate([t.back + b for t, b in zip(shards, base)])
    string, place = np.concatenate([t.string for t in shards]), np.concatenate([t.place for t in shards])
    some = np.zeros(n, bool)
    for k, (low, last) in zip(rounds, wanted):
        some |= (place - k * step >= low[string]) & (place - k * step <= last[string])
    row = np.flatnonzero(some)  # shard after shard: an interleave for no symbols
    block = np.zeros(len(row), np.int64)
    for k in range(1, max(rounds) + 1 if len(row) else 0):
        order, c = _sorted(flat[row], bits)
        row, b = back[row[order]], block[order]
        head = np.concatenate([[True], (c[1:] != c[:-1]) | (b[1:] != b[:-1])])
        shared = ~(head & np.append(head[1:], True))
        row, block = row[shared], np.cumsum(head)[shared]
        if k in rounds:
            yield string[row], place[row], block
        if not len(row):
            break


def repeated_windows(strings: list[bytes], length: int, shard: int = SHARD) -> list[np.ndarray]:
    """For each string the flags of its windows of ``length`` bytes that start elsewhere too, in any of the strings."""
    return _repeated(strings, [length], shard)[0]


def _bounds(length: int, p, size) -> tuple:
    """First and last window of ``length`` bytes that holds the minimizer at ``p`` in a piece of ``size`` bytes; none if the last is before the first."""
    return np.maximum(0, p - (length - GRAM)), np.minimum(p, size - length)


def _repeated(strings: list[bytes], lengths: list[int], shard: int, places: list[int] | None = None) -> list[list[np.ndarray]]:
    """The same for each of the ascending ``lengths``; with ``places`` of minimizers only their windows are counted and flagged."""
    step = max(d for d in range(1, STEP + 1) if all(x % d == 0 for x in lengths))
    long = [i for i, s in enumerate(strings) if len(s) >= lengths[0]]
    parts, at, room = [], 0, 0
    for k, i in enumerate(long):
        room += len(strings[i])
        if room >= shard or k == len(long) - 1:
            parts.append(Transform([strings[j] for j in long[at : k + 1]], at, step))
            at, room = k + 1, 0
    size = np.array([len(strings[i]) for i in long], np.int64)
    out = [[np.zeros(max(0, len(s) - x + 1), bool) for s in strings] for x in lengths]
    bounds = [(0 * size, size - x) if places is None else _bounds(x, np.array(places, np.int64)[long], size) for x in lengths]
    merged = merge(parts, len(long), [x // step for x in lengths], bounds) if parts else ()
    for flags, length, (low, last), (string, place, block) in zip(out, lengths, bounds, merged):
        fits = (place >= low[string]) & (place <= last[string])
        many = fits & (np.bincount(block[fits], minlength=int(block.max(initial=0)) + 1)[block] > 1)
        begin = np.concatenate([[0], np.cumsum(np.maximum(0, size - length + 1))])
        every = np.zeros(begin[-1], bool)
        every[begin[string[many]] + place[many]] = True
        for k, i in enumerate(long):
            flags[i] = every[begin[k] : begin[k + 1]]
    return out


def _pieces_of(docs: DataFrame, length: int, longest: int = 0) -> DataFrame:
    """``k1, k2, starts, n, p, key, d1, d2`` for each different piece of each row's text (``k1, k2, text``).

    Texts that repeat a word over and over have the same piece at very many places: these come in one row.
    """

    def run(batches):
        names = ["k1", "k2", "starts", "n", "p", "key", "d1", "d2"]
        for b in batches:
            rows, starts, ends, counts, places, keys, digests = [], [], [], [], [], [], []
            for i, t in enumerate(b.column(2)):
                raw = utf8(t.as_py())
                if len(raw) < length:
                    continue
                same: dict = {}
                for a, c, k, p in zip(*(x.tolist() for x in pieces(raw, length, longest=longest))):
                    same.setdefault((k, xxhash.xxh3_128_digest(raw[a : a + c + length - 1])), [c, p]).append(a)
                for (k, d), (c, p, *at) in same.items():
                    rows.append(i)
                    starts += at
                    ends.append(len(starts))
                    counts.append(c)
                    places.append(p)
                    keys.append(k)
                    digests.append(d)
            if rows:
                d, r = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), pa.array(rows)
                lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(starts, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(r), b.column(1).take(r), lists, pa.array(counts, pa.int64()), pa.array(places, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names)

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, starts array<long>, n long, p long, key long, d1 long, d2 long")


def _with_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the pieces ``wanted(k1, k2, start, n, p, key, d1, d2)``; copies of a text are read once."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "p", "key", "d1", "d2")).alias("p"))
    once = docs.groupBy("k1", "k2").agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            rows = []
            for t, p in zip(b.column(0), b.column(1)):
                raw = utf8(t.as_py())
                rows += [(x["key"], x["d1"], x["d2"], x["p"], raw[x["start"] : x["start"] + x["n"] + length - 1]) for x in p.as_py()]
            c = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(list(x), pa.int64()) for x in c[:4]), pa.array(list(c[4]), pa.binary())], ["key", "d1", "d2", "p", "piece"])

    return once.join(lists, ["k1", "k2"]).select("text", "p").mapInArrow(run, "key long, d1 long, d2 long, p long, piece binary")


def _may_repeat(rows: list[tuple], length: int) -> list[tuple]:
    """The rows ``(key, d1, d2, p, piece)`` that share the bytes around their minimizer with another row of their key.

    A window holds ``length - GRAM`` bytes besides the minimizer. Of these some multiple of ``part`` lies before it, with
    what is over that, under ``part``, left out, and the rest behind it: one of these cuts at least must be shared.
    """
    both = length - GRAM
    part, sides, seen = max(1, -(-both // PARTS)), [], {}
    for key, _, _, p, piece in rows:
        mine = []
        for left in range(0, min(p, both) + 1, part):
            right = max(0, both - left - part + 1)
            if len(piece) >= p + GRAM + right:
                mine.append((key, left, piece[p - left : p + GRAM + right]))
        for x in mine:
            seen[x] = seen.get(x, 0) + 1
        sides.append(mine)
    return [r for r, mine in zip(rows, sides) if any(seen[x] > 1 for x in mine)]


def _merged(piece_rows: DataFrame, lengths: list[int], shard: int) -> DataFrame:
    """Runs ``key, d1, d2, m, a, b`` of repeated windows of ``m`` bytes; tasks take whole minimizers, several shards at a time."""

    def run(batches):
        held, size = [], 0

        def flush(rows):
            out, rows = [], _may_repeat(rows, lengths[0])
            for m, flags in zip(lengths, _repeated([r[4] for r in rows], lengths, shard, [r[3] for r in rows])):
                for (k, d1, d2, *_), f in zip(rows, flags):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
                    out += [(k, d1, d2, m, int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]
            c = list(zip(*out)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in c], ["key", "d1", "d2", "m", "a", "b"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if size >= 4 * shard and held[-1][0] != row[0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    return piece_rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, d1 long, d2 long, m long, a long, b long")


def _by_digest(piece_rows: DataFrame, length: int) -> DataFrame:
    """The same for what stays hot: windows meet by their own digest, a row for each."""

    def run(batches):
        for b in batches:
            for k, d1, d2, _, p in zip(*(b.column(i).to_pylist() for i in range(5))):
                n = len(p) - length + 1
                w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p[i : i + length]) for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x)) for x in (k, d1, d2)] + [pa.array(np.arange(n)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], ["key", "d1", "d2", "a", "w1", "w2"])

    w = piece_rows.mapInArrow(run, "key long, d1 long, d2 long, a long, w1 long, w2 long")
    many = w.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return w.join(many, ["w1", "w2"]).select("key", "d1", "d2", F.lit(length).cast("long").alias("m"), "a", F.col("a").alias("b"))


def _often(piece_rows: DataFrame) -> np.ndarray:
    """How often the 32-byte substrings occur in the pieces, by the leading bits of their hash; ``2 ** SLOTS`` numbers."""
    cells = 1 << (SLOTS - 8)

    def count(batches):
        total = np.zeros(1 << SLOTS, np.int64)
        for b in batches:
            h = np.concatenate([_gram_hashes(np.frombuffer(p.as_py(), np.uint8)) for p in b.column(0)] or [np.zeros(0, np.uint64)])
            total += np.bincount((h >> np.uint64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
        for i in np.flatnonzero(total.reshape(256, cells).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i * cells : (i + 1) * cells].tobytes()])], ["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("n"))
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([n.tobytes()])})

    out = np.zeros((256, cells), np.int64)
    for r in piece_rows.select("piece").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():  # 256 rows
        out[r["part"]] = np.frombuffer(r["n"], np.int64)
    return np.minimum(out.ravel(), 65_535).astype(np.uint64)


def _cut_again(piece_rows: DataFrame, length: int) -> DataFrame:
    """The pieces cut at their windows' rarest substrings: ``key, d1, d2, off`` (where in the piece), ``n, q, key2, e1, e2, part``."""
    sent = piece_rows.sparkSession.sparkContext.broadcast(_often(piece_rows))
    names = ["key", "d1", "d2", "off", "n", "q", "key2", "e1", "e2", "part"]

    def run(batches):
        for b in batches:
            rows = []
            for k, d1, d2, _, piece in zip(*(b.column(i).to_pylist() for i in range(5))):
                for a, c, h, q in zip(*(x.tolist() for x in pieces(piece, length, sent.value))):
                    part = piece[a : a + c + length - 1]
                    rows.append((k, d1, d2, a, c, q, np.uint64(h).astype(np.int64), *np.frombuffer(xxhash.xxh3_128_digest(part), np.int64), part))
            c = list(zip(*rows)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([*(pa.array(np.array(x, np.int64)) for x in c[:9]), pa.array(list(c[9]), pa.binary())], names)

    return piece_rows.mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", part binary")


def _held(length: int, p: Column, size: Column) -> tuple[Column, Column]:
    """``_bounds`` of columns."""
    return F.greatest(F.lit(0), p - (length - GRAM)), F.least(p, size - length)


def _runs(piece_rows: DataFrame, lengths: list[int], shard: int, hot: int, again: bool = True) -> DataFrame:
    """Runs ``key, d1, d2, m, a, b`` of repeated windows of ``m`` bytes in the different pieces ``key, d1, d2, p, piece``."""
    big = cut(piece_rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("key"), "big")
    if big.isEmpty():
        return _merged(piece_rows, lengths, shard)
    runs, rest = _merged(piece_rows.join(big, "key", "left_anti"), lengths, shard), piece_rows.join(big, "key", "left_semi")
    if not again:
        return runs.unionByName(_by_digest(rest, lengths[0]))
    rest = cut(rest, "hot")
    for m in lengths:  # each by itself, in the bytes of its windows
        low, last = _held(m, F.col("p"), F.length("piece"))
        own = rest.where(last >= low).select("key", "d1", "d2", low.alias("low"), (F.col("p") - low).alias("p"), F.substring("piece", (low + 1).cast("int"), (last - low + m).cast("int")).alias("piece"))
        runs = runs.unionByName(_runs_again(own, m, shard, hot))
    return runs


def _runs_again(rest: DataFrame, length: int, shard: int, hot: int) -> DataFrame:
    """The runs of hot pieces; ``low`` is where they begin in the piece that ``d1, d2`` mean."""
    parts = cut(_cut_again(rest.select("key", "d1", "d2", "p", "piece"), length), "parts")
    same = ["key2", "e1", "e2"]
    some = cut(parts.groupBy(same).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("q").alias("p"), F.first("part").alias("piece")), "some")
    deeper = _runs(some.select(F.col("key2").alias("key"), F.col("e1").alias("d1"), F.col("e2").alias("d2"), "p", "piece"), [length], shard, hot, again=False)
    whole = some.where("c > 1").select(*same, F.lit(length).cast("long").alias("m"), F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("b"))
    found = cut(deeper.toDF(*same, "m", "a", "b").unionByName(whole), "found")
    back = parts.drop("part").join(found, same).join(rest.select("key", "d1", "d2", "low"), ["key", "d1", "d2"])
    return back.select("key", "d1", "d2", "m", (F.col("low") + F.col("off") + F.col("a")).alias("a"), (F.col("low") + F.col("off") + F.col("b")).alias("b"))


def repeated_spans(docs: DataFrame, lengths: list[int], shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``k1, k2, spans``: byte ranges of each text (as ``array<struct<s, e, m>>``, may overlap) covered by repeated windows
    of ``m`` bytes, for the one or two ``lengths``."""
    lengths = sorted(set(lengths))
    length = lengths[0]
    found = cut(_pieces_of(docs, length, lengths[-1]), "pieces")
    keys = found.groupBy("key").agg(F.sum(F.size("starts")).alias("c"), (F.min("d1") != F.max("d1")).alias("mixed")).where("c > 1").drop("c")
    again = cut(found.join(keys, "key"), "again")
    one = cut(again.groupBy("key", "d1", "d2").agg(F.sum(F.size("starts")).alias("c"), F.first("mixed").alias("mixed"), F.min(F.struct("k1", "k2", F.col("starts")[0].alias("start"), "n", "p")).alias("at")), "one")
    mixed = one.where("mixed").select("key", "d1", "d2", "at.*")
    runs = _runs(cut(_with_bytes(docs, mixed, length), "bytes"), lengths, shard, hot)
    held = [_held(m, F.col("at.p"), F.col("at.n") + (length - 1)) for m in lengths]
    ranges = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), low.cast("long").alias("a"), last.cast("long").alias("b")) for m, (low, last) in zip(lengths, held)])
    whole = one.where("c > 1").select("key", "d1", "d2", F.inline(ranges)).where("a <= b")
    runs = cut(runs.unionByName(whole), "runs")
    spans = again.join(runs, ["key", "d1", "d2"]).select("k1", "k2", F.explode("starts").alias("start"), "m", "a", "b")
    spans = spans.select("k1", "k2", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + F.col("m")).alias("e"), "m").distinct()
    return spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("s", "e", "m"))).alias("spans"))


def _joined(spans: pa.ListArray, length: int) -> list[list[tuple[int, int]]]:
    """For each row its ranges of ``length``, which come in order; those that overlap or touch as one."""
    flat = spans.flatten()
    row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    s, e, m = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("s", "e", "m"))
    row, s, e = row[m == length], s[m == length], e[m == length]
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(spans))]
    if len(row):
        far = np.maximum.accumulate(e + (row << 40))  # rows lie apart
        head = np.flatnonzero(np.concatenate([[True], (s + (row << 40))[1:] > far[:-1]]))
        for r, a, b in zip(row[head].tolist(), s[head].tolist(), (far[np.append(head[1:], len(far)) - 1] - (row[head] << 40)).tolist()):
            out[r].append((a, b))
    return out


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, as_text: bool = False, nested: bool = False, shard: int = SHARD, hot: int = HOT, words: int = 0, passages: tuple[int, int] | None = None) -> DataFrame:
    """All rows and columns of ``df`` with ``n_bytes, n_removed, n_spans`` and ``kept`` (the bytes that stay; with
    ``as_text`` a string without the characters that were cut in two).

    A byte goes if a string of ``length`` bytes that covers it also starts at
    another place of any text, the same text included; texts are UTF-8 and
    matches never cross them. Null, empty and short texts stay as they are
    (null: empty bytes). Spans of fewer than ``words`` words stay. Repeated rows are places of their own, so their texts
    repeat. With ``passages``, a number of bytes and one of words, ``n_passages`` and ``passage_bytes`` count the runs that
    repeated strings of so many bytes cover and that hold so many words, and their bytes; what is removed stays the same,
    and both lengths are found in one merge. Columns of ``df`` with the names added here give way to them; with
    ``nested`` the row of ``df`` comes whole, as a struct ``row``.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept"] + ["n_passages", "passage_bytes"] * (passages is not None)
    also = passages or (length, 0)
    keyed = with_text_key(df.select(F.struct("*").alias("row"), F.col(text_col).alias("text")))
    spans = cut(repeated_spans(keyed.select("k1", "k2", "text"), [length, also[0]], shard, hot), "spans")
    joined = keyed.join(spans, ["k1", "k2"], "left").select("row", "text", "spans")

    def run(batches):
        for b in batches:
            rows = []
            removed = _joined(b.column(2), length)
            shared = _joined(b.column(2), also[0]) if passages else removed
            for t, runs, both in zip(b.column(1), removed, shared):
                raw = utf8(t.as_py())
                if words:
                    runs = [(s, e) for s, e in runs if len(raw[s:e].split()) >= words]
                gone, count = sum(e - s for s, e in runs), len(runs)
                kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)]))
                rows.append((len(raw), gone, count, kept.decode("utf-8", "ignore") if as_text else kept))
                if passages:
                    held = [e - s for s, e in both if len(raw[s:e].split()) >= also[1]]
                    rows[-1] += len(held), sum(held)
            c = list(zip(*rows)) or [[]] * len(names)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), k) for x, k in zip(c, kinds))], ["row", *names])

    shape = T.StructType([keyed.schema["row"], *(T.StructField(n, T.LongType() if n != "kept" else T.StringType() if as_text else T.BinaryType()) for n in names)])
    out = joined.mapInArrow(run, shape)
    return out if nested else out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in names], *names)
