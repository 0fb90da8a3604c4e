"""Language-model scores by prediction by partial matching over bytes.

The context trie is kept as tables: how often a symbol followed a context of
``order`` bytes in the training texts, and for shorter contexts in how many
longer ones it did (a count is not raised below the order that knew the
symbol). A symbol unknown to a context costs its escape (method D); the
symbols seen there are excluded at the next order, down to a uniform choice.
All that depends on ``order + 1`` symbols alone, so the trie gives one code
length per gram of the corpus, by joins, and a text's score is a sum over its
grams. Tasks take texts in runs of about a megabyte, whole arrays at a time,
as most texts are short. The most frequent grams and words are broadcast, up to a fixed number;
the others, which a text holds few of, are looked up by a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut
from evenkeel.llm.neardup import with_text_key
from evenkeel.llm.words import M1, WordHashes, mix, utf8

ORDER, SYMBOLS, BITS = 5, 257, 9
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
RUN = 1 << 20  # bytes of texts taken at once
MOST_WORDS, MOST_GRAMS = 1_000_000, 3_000_000  # rows of a broadcast table (a key and a number each)


def _mixed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(low + mix(high + mix(size)))


END_WORD = _mixed(*np.zeros((3, 1), np.uint64))[0]


def runs(texts: pa.Array, most: int = RUN):
    """The texts' bytes, A-Z lower-cased, in lists of about ``most`` bytes, each with its first row and the next list's."""
    first, raws, held = 0, [], 0
    for i, t in enumerate(texts):
        raws.append(utf8(t.as_py()).lower())
        held += len(raws[-1]) + 1
        if held >= most or i + 1 == len(texts):
            yield first, i + 1, raws
            first, raws, held = i + 1, [], 0


def grams(raws: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol with the ``order`` before it as one number, text after text, and how many a text has.

    Starts are padded with 0, byte b is b + 1, 257 ends.
    """
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    last = np.cumsum(sizes + order) - 1
    pad = bytes(order)
    a = np.frombuffer(b"".join([x for r in raws for x in (pad, r, b"\0")]), np.uint8).astype(np.uint64)
    a += np.uint64(1)
    a[last] = SYMBOLS
    inside = np.ones(len(a), bool)
    for i in range(order):
        a[last - sizes - i] = 0
        inside[last - i] = False  # a gram from here would run into the next text
    n = len(a) - order
    key = a[:n].copy()
    for i in range(1, order + 1):
        key <<= np.uint64(BITS)
        key |= a[i : i + n]
    return key[inside[:n]], sizes


def word_hashes(raws: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, text after text, and how many a text has.

    Words of up to 16 bytes are mixed as two numbers and their length, all at
    once; only longer ones are hashed one by one. An end has length 0.
    """
    joined = b" ".join([*raws, bytes(16)])
    text_end = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    space = SPACES[np.frombuffer(joined, np.uint8)[: text_end[-1]]]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # the 8 bytes from each place
    key = _mixed(eight[start] & FIRST_BYTES[np.minimum(size, 8)], eight[start + 8] & FIRST_BYTES[np.clip(size - 8, 0, 8)], size.astype(np.uint64))
    long = np.flatnonzero(size > 16)
    key[long] = hashes.of([joined[a : a + n] for a, n in zip(start[long].tolist(), size[long].tolist())])
    sizes = np.diff(np.searchsorted(start, text_end), prepend=0) + 1
    out = np.full(len(key) + len(raws), END_WORD)
    word = np.ones(len(out), bool)
    word[np.cumsum(sizes) - 1] = False
    out[word] = key
    return out, sizes


class Counts:
    """Sums of counts by key in sorted arrays; new keys wait until there are ``room`` of them."""

    def __init__(self, room: int = 2_000_000):
        self.room, self.keys, self.counts = room, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.wait: list[tuple[np.ndarray, bool]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counted: bool) -> None:
        self.wait.append((keys, counted))
        self.waiting += len(keys)
        if self.waiting >= self.room:
            self.settle()

    def settle(self) -> None:
        parts, sums = [self.keys], [self.counts]
        for flag in (True, False):
            some = [k for k, c in self.wait if c is flag]
            if some:
                k, n = np.unique(np.concatenate(some), return_counts=True)
                parts.append(k)
                sums.append(n if flag else np.zeros(len(k), np.int64))
        k, n = np.concatenate(parts), np.concatenate(sums)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        self.keys, self.counts = k[first], np.add.reduceat(n, first) if len(first) else n
        self.wait, self.waiting = [], 0

    def take(self):
        self.settle()
        out = self.keys.view(np.int64), self.counts
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out


def gather(docs: DataFrame, order: int, most: int = 3_000_000) -> DataFrame:
    """``kind`` (0 gram, 1 word), ``item`` and ``c``, its count in the rows with ``train``, over ``docs(train, text)``; items of other rows count 0."""

    def run(batches):
        both, hashes = (Counts(), Counts()), WordHashes()

        def out(k):
            keys, n = both[k].take()
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[a : a + 100_000]), k, np.int32)), pa.array(keys[a : a + 100_000]), pa.array(n[a : a + 100_000])], ["kind", "item", "c"])

        for b in batches:
            train = b.column(0).to_pylist()
            for first, end, raws in runs(b.column(1)):
                for flag in (True, False):
                    some = [r for r, t in zip(raws, train[first:end]) if bool(t) is flag]
                    if some:
                        both[0].add(grams(some, order)[0], flag)
                        both[1].add(word_hashes(some, hashes)[0], flag)
                for k in (0, 1):
                    if len(both[k].keys) > most:
                        yield from out(k)
        for k in (0, 1):
            yield from out(k)

    return docs.select("train", "text").mapInArrow(run, "kind int, item long, c long").groupBy("kind", "item").agg(F.sum("c").alias("c"))


def code_lengths(corpus: DataFrame, order: int) -> DataFrame:
    """``item, value, c``: log10 probability of each gram's last symbol after the others, from ``corpus(item, c)``."""
    low = lambda k: F.col("item").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1))
    count = {order: cut(corpus.where("c > 0").select(F.col("item").alias("g"), "c"), "trie")}
    for k in range(order - 1, -1, -1):
        count[k] = cut(count[k + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << (BITS * (k + 1))) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("c")), "trie")
    d = corpus.withColumnRenamed("c", "seen").withColumn("acc", F.lit(0.0)).withColumn("value", F.lit(None).cast("double")).withColumn("x0", F.lit(0).cast("long")).withColumn("d0", F.lit(0).cast("long"))
    for k in range(order, -1, -1):
        t = count[k]
        if k:
            below = count[k - 1].select(F.col("g").alias("h"), F.col("c").alias("below"))
            t = t.withColumn("h", F.col("g").bitwiseAND(F.lit((1 << (BITS * k)) - 1))).join(below, "h")
        else:
            t = t.withColumn("below", F.lit(0).cast("long"))
        state = t.groupBy(F.shiftright("g", BITS).alias("ctx")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("below").alias("x"))
        d = (d.withColumn("g", low(k)).join(count[k], "g", "left").withColumn("ctx", F.shiftright("g", BITS)).join(state, "ctx", "left"))
        n, distinct = F.col("n") - F.col("x0"), F.col("d") - F.col("d0")
        hit = F.col("value").isNull() & F.col("c").isNotNull()
        value = F.when(hit, F.col("acc") + F.log10((F.col("c") - 0.5) / n)).otherwise(F.col("value"))
        acc = F.col("acc") + F.when(F.col("value").isNull() & F.col("n").isNotNull() & (distinct > 0), F.log10(distinct / (2 * n))).otherwise(0.0)
        d = d.select("item", "seen", acc.alias("acc"), value.alias("value"), F.coalesce("x", "x0").alias("x0"), F.coalesce("d", "d0").alias("d0"))
        d = cut(d, "level")  # one plan of all orders would be large
    rest = F.col("acc") - F.log10(F.greatest(F.lit(1), F.lit(SYMBOLS) - F.col("d0")))
    return d.select("item", F.coalesce("value", rest).alias("value"), F.col("seen").alias("c"))


def hashed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) * M1


def by_hash(keys: np.ndarray) -> np.ndarray:
    return np.argsort(hashed(keys), kind="stable")


class Lookup:
    """Values by key in a hash table of numpy arrays (linear probing, whole arrays at a time).

    Key and value lie side by side, so a probe reads one place. Keys take their
    slots in the order of their hash, each the first one from its home that the
    keys before it left free; past the last home the table just goes on.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys))).bit_length())
        order = by_hash(keys)
        i = np.arange(len(keys))
        at = np.maximum.accumulate(self._home(keys[order]) - i) + i
        self.table = np.zeros((max(1 << self.bits, int(at.max(initial=0)) + 1) + 1, 2), np.int64)
        self.of = self.table.view(np.float64)
        self.of[:, 1] = np.nan  # free
        self.table[at, 0], self.of[at, 1] = keys[order], values[order]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (hashed(keys) >> np.uint64(64 - self.bits)).view(np.int64)

    def __call__(self, keys: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """The values, NaN for unknown keys."""
        found = np.empty(len(keys))
        for a in range(0, len(keys), block):
            want, out = keys[a : a + block], found[a : a + block]
            at = self._home(want)
            slot = self.table.take(at, axis=0)
            out[:] = slot.view(np.float64)[:, 1]
            miss = np.flatnonzero((slot[:, 0] != want) & ~np.isnan(out))
            at = at[miss]
            while len(miss):
                at += 1
                slot = self.table.take(at, axis=0)
                value = slot.view(np.float64)[:, 1]
                out[miss] = value
                more = (slot[:, 0] != want[miss]) & ~np.isnan(value)
                miss, at = miss[more], at[more]
        return found


def _frequent(table: DataFrame, most: int):
    """At most ``most`` rows of ``table(item, value, c)``, all those with a count of at least ``floor``: broadcast arrays and ``floor``."""
    sizes = table.groupBy(F.floor(F.log2(F.col("c") + 1)).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()  # 64 rows at most
    floor, held = 1 << 62, 0
    for r in sizes:
        if held + r["n"] > most:
            break
        held, floor = held + r["n"], (1 << r["b"]) - 1
    got = table.where(F.col("c") >= floor).select("item", "value").toArrow()
    keys, values = got.column("item").to_numpy().astype(np.int64), got.column("value").to_numpy().astype(np.float64)
    order = by_hash(keys)  # sorted once, not again in every task
    return table.sparkSession.sparkContext.broadcast((keys[order], values[order])), floor


def _summed(keys: np.ndarray, sizes: np.ndarray, values: np.ndarray):
    """Per text (it has ``sizes`` of the keys, one at least), the sum of the values, and the keys without one, each once with its number there."""
    unknown = np.isnan(values)
    at = np.flatnonzero(unknown)
    sums = np.add.reduceat(np.where(unknown, 0.0, values), np.cumsum(sizes) - sizes)
    text, key = np.searchsorted(np.cumsum(sizes), at, "right"), keys[at]
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(at) else at
    pairs = pa.StructArray.from_arrays([pa.array(key[first]), pa.array(np.diff(np.append(first, len(at))))], ["item", "m"])
    starts = np.searchsorted(text[first], np.arange(len(sizes) + 1)).astype(np.int32)
    return sums, pa.ListArray.from_arrays(pa.array(starts), pairs)


def score_batches(batches, common: Lookup, code: Lookup, order: int):
    """Sums over the frequent items of each text, and its other items with their numbers; ``batches`` hold id, two keys and text."""
    hashes = WordHashes()
    for b in batches:
        for first, end, raws in runs(b.column(3)):
            w, n_tokens = word_hashes(raws, hashes)
            value = common(w.view(np.int64))
            known = np.add.reduceat((value > 0).astype(np.int64), np.cumsum(n_tokens) - n_tokens)
            logs, words = _summed(w.view(np.int64), n_tokens, value)
            g, sizes = grams(raws, order)
            score, rare = _summed(g.view(np.int64), sizes, code(g.view(np.int64)))
            ids = [b.column(i).slice(first, end - first) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*ids, *map(pa.array, (n_tokens, known, logs)), words, pa.array(score), rare], ["id", "k1", "k2", "n_tokens", "known", "logs", "words", "score", "grams"])


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, most: tuple[int, int] = (MOST_WORDS, MOST_GRAMS)) -> DataFrame:
    """Per row ``id, n_tokens, n_known, train_tokens, base_score, score``.

    Texts count with A-Z lower-cased, null as empty; learns from the rows for
    which ``train`` (over the columns of ``df``) holds. ``score`` is the log10
    probability of the bytes and their end, ``base_score`` that of the words
    and an end under add-one counts. Without training rows every symbol is
    equally likely. Repeated rows are scored alike; other columns are ignored.
    """
    docs = with_text_key(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train")))
    found = cut(gather(docs, order), "counts")
    lengths = cut(code_lengths(found.where("kind = 0").select("item", "c"), order), "lengths")
    words = found.where("kind = 1").select("item", "c")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)).alias("v")).first()
    of_word = words.select("item", F.log10(F.col("c") + 1).alias("value"), (F.col("c") > 0).cast("long").alias("known"), "c")
    of_gram = lengths.select("item", "value", "c", F.lit(0).alias("known"))
    (common_words, word_floor), (common_grams, gram_floor) = _frequent(of_word, most[0]), _frequent(of_gram, most[1])

    def run(batches):
        yield from score_batches(batches, Lookup(*common_words.value), Lookup(*common_grams.value), order)

    kind = df.schema[id_col].dataType.simpleString()
    pairs = "array<struct<item:bigint,m:bigint>>"
    part = cut(docs.select("id", "k1", "k2", "text").mapInArrow(run, f"id {kind}, k1 long, k2 long, n_tokens long, known long, logs double, words {pairs}, score double, grams {pairs}"), "parts")
    copies = part.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"))

    def looked_up(col: str, values: DataFrame) -> DataFrame:
        """Per text, sums over the items that were not broadcast (over all copies of the text)."""
        return (part.select("k1", "k2", F.explode(col).alias("x")).select("k1", "k2", "x.item", "x.m").join(values, "item").groupBy("k1", "k2")
                .agg(F.sum(F.col("m") * F.col("value")).alias(f"{col}_sum"), F.sum(F.col("m") * F.col("known")).alias(f"{col}_known")))

    far = (copies.join(looked_up("words", of_word.where(F.col("c") < word_floor)), ["k1", "k2"], "left")
           .join(looked_up("grams", of_gram.where(F.col("c") < gram_floor)), ["k1", "k2"], "left"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("copies")
    return part.join(far, ["k1", "k2"]).select(
        "id", "n_tokens", (F.col("known") + F.round(share("words_known")).cast("long")).alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + share("words_sum") - F.col("n_tokens") * F.log10(F.lit(float(total["n"] + total["v"] + 1)))).alias("base_score"), (F.col("score") + share("grams_sum")).alias("score"))
