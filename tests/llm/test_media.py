import hashlib
import struct
import zlib

import numpy as np
import pytest

from evenkeel.llm import media


@pytest.mark.parametrize("c", [1, 3, 4])
def test_all_filters_are_undone(c):
    rng = np.random.default_rng(c)
    px = rng.integers(0, 256, (12, 10 * c), dtype=np.uint8)
    rows, want = [], px.astype(int)
    for r in range(12):
        kind, out = r % 5, []
        for i in range(10 * c):
            a = want[r, i - c] if i >= c else 0
            b = want[r - 1, i] if r else 0
            d = want[r - 1, i - c] if r and i >= c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out.append((want[r, i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append([kind, *out])
    assert (media.unfilter(np.array(rows, np.uint8), c) == px).all()


def test_round_trip_and_damage():
    for text in ("", "x", "ä" * 5000, "line\n" * 300, "\x00" * 192):
        payload, n = media.payload_of(text)
        assert len(payload) % 192 == 0 and payload[:n] == text.encode() and set(payload[n:]) <= {32}
        png = media.write_png(payload)
        assert media.read_png(png).tobytes() == payload
    for bad in (b"", png[:-4], png[:40] + bytes([png[40] ^ 1]) + png[41:], b"GIF89a" + png):
        with pytest.raises(media.BadPng):
            media.read_png(bad)


def test_hash_is_stable_under_small_changes():
    rng = np.random.default_rng(1)
    img = np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8))
    a, b = bits(media.dct_hash(img)), bits(media.dct_hash(np.clip(img.astype(int) + rng.integers(-3, 4, img.shape), 0, 255).astype(np.uint8)))
    assert (a != b).sum() <= 6 < (a != bits(media.dct_hash(img[::-1]))).sum()


def test_columns(spark):
    rows = [(1, "some text", "k"), (2, None, "k"), (3, "", "k"), (3, "some text", None), (None, "w " * 90_000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.media_features(media.encode_payloads(df)).collect()
    assert len(got) == 5
    for r in got:
        raw = (dict((i, t) for i, t, _ in rows if i != 3).get(r.doc_id) if r.doc_id != 3 else ("some text" if r.n_bytes else "")) or ""
        payload, n = media.payload_of(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.error is None and len(r.phash) == 8
    broken = spark.createDataFrame([(1, 2, b"nonsense"), (2, 2, None)], "doc_id long, n_bytes long, media binary")
    assert {r.doc_id: r.error for r in media.media_features(broken).collect()} == {1: "not a PNG", 2: "null"}
    assert media.media_features(media.encode_payloads(df.limit(0))).count() == 0
    assert struct.calcsize(">I") == 4
