"""Media columns: 8-bit PNG in binary columns, checked chunks, cosine-transform hashes.

``encode_payloads`` stores bytes as a PNG image, ``read_png`` reads one back
(chunk checksums, zlib, all five row filters undone in numpy) and
``dct_hash`` keeps the signs of the lowest frequencies of a cosine transform.
Everything works row by row, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAGIC = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
UNIT = 3 * WIDTH
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class BadPng(ValueError):
    """The stored bytes are not a PNG that this reader takes."""


def payload_of(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    """UTF-8 bytes padded with spaces to a positive multiple of ``unit``; unpadded size."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" "), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filter_rows(px: np.ndarray, bpp: int) -> np.ndarray:
    """Rows with the filter byte in front: for each the one of None, Sub and Up with least residue."""
    sub = px.copy()
    sub[:, bpp:] -= px[:, :-bpp]
    up = px.copy()
    up[1:] -= px[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (px, sub, up)])
    kind = cost.argmin(0).astype(np.uint8)
    out = np.where((kind == 0)[:, None], px, np.where((kind == 1)[:, None], sub, up))
    return np.concatenate([kind[:, None], out], 1)


def write_png(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """``payload`` as RGB samples of ``width`` pixels a row."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, 3 * width)
    head = struct.pack(">IIBBBBB", width, len(px), 8, 2, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filter_rows(px, 3).tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters. ``rows``: filter byte, then samples.

    Rows without a filter and Sub rows are done at once for the image, runs of
    Up rows by a running sum; Average and Paeth go pixel by pixel.
    """
    kind, px = rows[:, 0], rows[:, 1:].copy()
    if kind.max(initial=0) > 4:
        raise BadPng("unknown row filter")
    sub = np.flatnonzero(kind == 1)
    if len(sub):
        px[sub] = np.cumsum(px[sub].reshape(len(sub), -1, bpp), axis=1, dtype=np.uint8).reshape(len(sub), -1)
    cuts = np.flatnonzero(np.diff(kind)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(kind)]):
        if kind[a] == 2:
            if a:
                px[a] += px[a - 1]
            px[a:b] = np.cumsum(px[a:b], axis=0, dtype=np.uint8)
        elif kind[a] > 2:
            for r in range(a, b):
                up = px[r - 1].astype(np.int16) if r else np.zeros(px.shape[1], np.int16)
                left, corner = np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
                for i in range(0, px.shape[1], bpp):
                    above = up[i : i + bpp]
                    if kind[a] == 3:
                        guess = (left + above) >> 1
                    else:
                        p = left + above - corner
                        pa_, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, above, corner))
                    left = (px[r, i : i + bpp] + guess) & 255
                    px[r, i : i + bpp] = left
                    corner = above
    return px


def read_png(data: bytes) -> np.ndarray:
    """Samples as ``(height, width, channels)``; raises :class:`BadPng` on any damage."""
    if data[:8] != MAGIC:
        raise BadPng("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise BadPng("cut short")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if at + 12 + n > len(data):
            raise BadPng("cut short")
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(part, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise BadPng(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise BadPng("chunk missing")
    w, h, depth, colour, packing, filters, lace = head
    if depth != 8 or colour not in CHANNELS or packing or filters or lace:
        raise BadPng("form not supported")
    c = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise BadPng(f"zlib: {e}") from None
    if len(raw) != h * (w * c + 1):
        raise BadPng("size of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(h, -1), c).reshape(h, w, c)


def _cosines(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)


SIDE, LOW = 32, 8
_DCT = _cosines(SIDE, LOW)


def _shrink(a: np.ndarray, n: int) -> np.ndarray:
    """Area means of ``n`` bands of rows (a band holds at least one row)."""
    h = len(a)
    lo = np.arange(n) * h // n
    hi = np.maximum(lo + 1, -(-(np.arange(n) + 1) * h // n))
    total = np.concatenate([np.zeros((1, a.shape[1])), np.cumsum(a, 0)])
    return (total[hi] - total[lo]) / (hi - lo)[:, None]


def dct_hash(px: np.ndarray) -> bytes:
    """64 bits: low frequencies of a 32 x 32 luminance image over their median (the mean level left out)."""
    grey = px.mean(2) if px.shape[2] != 2 else px[:, :, 0].astype(float)
    low = _DCT @ _shrink(_shrink(grey, SIDE).T, SIDE).T @ _DCT.T
    low = np.round(low, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_payloads(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus ``n_bytes`` and ``media`` (binary, PNG of the padded text). A null text is empty."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    cols = list(keep)

    def run(batches):
        for b in batches:
            made = [payload_of(t) for t in b.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(cols))), pa.array([n for _, n in made], pa.int64()), pa.array([write_png(p) for p, _ in made], pa.binary())],
                [*cols, "n_bytes", "media"])

    return df.select(*keep, text_col).mapInArrow(run, f"{fields}, n_bytes long, media binary")


def media_features(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Read PNG bytes back: payload size and digests, media size and digest, ``phash`` binary(8), ``error``.

    A null or damaged image gives null features and the reason in ``error``.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    cols = list(keep)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash", "error"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def one(data):
        if data is None:
            return (None,) * 6 + ("null",)
        size, digest = len(data), hashlib.sha256(data).hexdigest()
        try:
            px = read_png(data)
        except BadPng as e:
            return (None, None, None, size, digest, None, str(e))
        raw = px.tobytes()
        return (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), size, digest, dct_hash(px) if px.size else None, None)

    def run(batches):
        for b in batches:
            got = list(zip(*map(one, b.column(len(cols)).to_pylist()))) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(cols))), *(pa.array(list(g), k) for g, k in zip(got, kinds))], [*cols, *names])

    return df.select(*keep, media_col).mapInArrow(
        run, f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary, error string")
