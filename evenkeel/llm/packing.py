"""Best-fit packing of token sequences by the sum-of-squares rule.

Texts become token pieces of at most ``size`` where they lie. The pieces, without
their ids some 40 bytes each, are dealt evenly to groups; a task packs a group. A
piece goes where the sum over gaps of the squared number of open bins with that
gap becomes least. Longer pieces go first. So neither the layout of the input nor
the number of its partitions costs sequences: a group leaves one part-filled bin
or a few.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

SIZE = 2048
GROUP = 500_000  # pieces of a group: the packer holds one number for each open bin
_KNOWN, _LONGEST = 1_000_000, 64  # words remembered by a worker, some 200 bytes each, and their greatest length
_LAST = 0x52F  # up to here the word pattern is spelled out
_TOKENIZERS: dict[str, object] = {}


def _spelled_out(pattern: str) -> re.Pattern:
    """``pattern`` with its classes of letters, numbers and spaces as ranges up to ``_LAST``: half the time of the class names."""
    import regex

    def ranges(name: str) -> str:
        found = [c for c in range(_LAST + 1) if regex.match(name, chr(c))]
        first = [c for c in found if c - 1 not in found]
        last = [c for c in found if c + 1 not in found]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))

    letters, numbers, spaces = (ranges(n) for n in (r"\p{L}", r"\p{N}", r"\s"))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(out.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


def load_tokenizer(path: str | None = None):
    """A function from a list of texts to their uint32 ids (as bytes) by the tokenizer file in ``path``.

    A byte-level tokenizer encodes the words of its splitting pattern one by
    one, so the words that a worker has seen are remembered. Texts that spell a
    special token, and those with letters outside the scripts for which all
    versions of Unicode agree (U+052F and below), go through the tokenizer whole.
    """
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _TOKENIZERS:
        full, signs = Tokenizer.from_file(path), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        table = {b: x for c in range(_LAST + 1) for b, x in zip(chr(c).encode(), signs.pre_tokenize_str(chr(c))[0][0])}  # the tokenizer's sign for each byte
        special = [t.content for t in full.get_added_tokens_decoder().values()]
        _TOKENIZERS[path] = full, table, special, _spelled_out(public_tokenizers.PATTERN), re.compile(f"[^\\x00-{chr(_LAST)}]"), {}
    full, table, special, pattern, other, known = _TOKENIZERS[path]
    encode = full.model.tokenize

    def ids(texts: list[str]) -> list[bytes]:
        whole = [any(s in t for s in special) or not t.isascii() and other.search(t) is not None for t in texts]
        rare = full.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False) if any(whole) else []
        rare = iter([array("I", e.ids).tobytes() for e in rare])
        words = [None if w else pattern.findall(t) for t, w in zip(texts, whole)]
        if len(known) > _KNOWN:
            known.clear()
        long = []
        for w in set().union(*filter(None, words)) - known.keys():
            known[w] = array("I", [k.id for k in encode(w.encode().decode("latin-1").translate(table))]).tobytes()
            if len(w) > _LONGEST:
                long.append(w)
        out = [next(rare) if ws is None else b"".join(map(known.__getitem__, ws)) for ws in words]
        for w in long:
            del known[w]
        return out

    return ids


class SquaresPacker:
    """Sum-of-squares placement over gap counts.

    ``place(length)`` returns ``(bin, offset)``. Moving a bin from gap g to
    g - s changes the sum by 2 (N(g - s) - N(g)) + 2, opening one by
    2 N(size - s) + 1; full bins (gap 0) don't count. Ties take the least gap.
    """

    def __init__(self, size: int = SIZE):
        self.size, self.count = size, np.zeros(size + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.bins = 0

    def place(self, s: int, may_open: bool = True) -> tuple[int, int]:
        n, size = self.count, self.size
        g = np.flatnonzero(n[s : size]) + s  # gaps in which it fits
        if len(g):
            change = np.where(g == s, 1 - 2 * n[g], 2 * (n[g - s] - n[g]) + 2)
            i = int(change.argmin())
            if not may_open or change[i] <= (2 * n[size - s] + 1 if s < size else 0):
                gap = int(g[i])
                n[gap] -= 1
                b = self.open[gap].pop()
                if gap > s:
                    n[gap - s] += 1
                    self.open[gap - s].append(b)
                return b, size - gap
        b, self.bins = self.bins, self.bins + 1
        if s < size:
            n[size - s] += 1
            self.open[size - s].append(b)
        return b, 0


def pack_lengths(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, the longest placed first.

    In that order opening a bin while a piece still fits an open one only
    costs bins, so a new one is opened only where none fits.
    """
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    p = SquaresPacker(size)
    for i in np.argsort(-lengths, kind="stable"):
        where[i], offset[i] = p.place(int(lengths[i]), may_open=False)
    return where, offset


def token_pieces(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SIZE, end_id: int = 0, tokenizer=load_tokenizer, order: list[Column] | None = None, batch: int = 256) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for each piece, and the values of ``order`` as ``o0, o1, ...``."""
    order = [c.alias(f"o{i}") for i, c in enumerate(order or [])]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *order)
    extra = [f.name for f in rows.schema[2:]]

    def run(batches):
        ids_of = tokenizer()
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                b, at, made = whole.slice(a, batch), [], []
                for i, raw in enumerate(ids_of([t or "" for t in b.column(1).to_pylist()])):
                    ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype("<u4")
                    start, end, k = 0, (len(ids) - 1) % size + 1, 0  # the first piece takes the remainder
                    while start < len(ids):
                        at.append(i)
                        made.append((k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                        start, end, k = end, end + size, k + 1
                i, c = pa.array(at, pa.int64()), list(zip(*made)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(i), *(pa.array(x, t) for x, t in zip(c, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))), *(b.column(2 + j).take(i) for j in range(len(extra)))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", *extra])

    tail = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[2:])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + tail)


def pack_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = SIZE, end_id: int = 0, tokenizer=load_tokenizer, group: int = GROUP, order: list[Column] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each text's ids are followed by ``end_id``; longer ones are cut into
    ``size`` tokens, the first piece taking the remainder. A null text is empty
    and gives one piece with the end id alone. Groups hold about ``group``
    pieces. With ``order`` they are stretches of the rows in that order, and
    sequence ids ascend with the stretches; otherwise pieces are dealt evenly.
    Repeated rows are packed separately. Within a group equal lengths go by id,
    piece and digest. Other columns are ignored.
    """
    pieces = cut(token_pieces(df, text_col, id_col, size, end_id, tokenizer, order), "tokens")
    groups, by = max(1, -(-pieces.count() // group)), [c for c in pieces.columns[5:]]
    dealt = pieces.repartitionByRange(groups, *by, "piece") if by else pieces.repartition(groups)
    names = pieces.columns[:5]
    dealt = dealt.select(*names).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")

    def run(batches):
        packer, part = SquaresPacker(size), TaskContext.get().partitionId()
        for b in batches:
            places = [packer.place(n, may_open=False) for n in b.column(3).to_pylist()]
            seq, offset = np.array(places, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((np.int64(part) << 40) + seq), pa.array(offset.copy())], [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
