"""The lossless WebP codec: exact round trips through every feature, known bytes, damaged files."""

import base64
import hashlib
import zlib

import numpy as np
import odd
import pytest

from folioforge.llm import media, q07_media, webp
from folioforge.llm.webp import CROSS, GREEN, PALETTE, PREDICTOR, WebpError, decode, encode

RNG = np.random.default_rng(1)


def same(p, **k):
    return bool((decode(encode(p, **k)) == p).all())


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (7, 3), (20, 33), (33, 17)])
def test_features(shape):
    h, w = shape
    p = RNG.integers(0, 2**32, shape, dtype=np.uint32)
    small = RNG.integers(0, 5, shape).astype(np.uint32) * np.uint32(0x01020304)
    blocks = {
        PREDICTOR: (2, RNG.integers(0, 14, (-(-h // 4), -(-w // 4))).astype(np.uint32) << 8),
        CROSS: (3, RNG.integers(0, 2**32, (-(-h // 8), -(-w // 8)), dtype=np.uint32)),
    }
    assert same(p) and same(small) and same(small, cache_bits=3) and same(p, transforms=[GREEN])
    assert same(p, transforms=[PREDICTOR], blocks=blocks) and same(p, transforms=[CROSS], blocks=blocks)
    assert same(p, transforms=[PREDICTOR, CROSS, GREEN], blocks=blocks, cache_bits=4)
    assert same(p, groups=(2, RNG.integers(0, 3, (-(-h // 4), -(-w // 4)))))
    for n in (1, 2, 3, 4, 9, 16, 17, 200):
        assert same(RNG.integers(0, n, shape).astype(np.uint32) * np.uint32(77777), transforms=[PALETTE])


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    p = RNG.integers(0, 2**32, (9, 6), dtype=np.uint32)
    assert same(p, transforms=[PREDICTOR], blocks={PREDICTOR: (2, np.full((3, 2), mode << 8, np.uint32))})


def test_back_references():
    q = np.tile(RNG.integers(0, 2**32, (1, 50), dtype=np.uint32), (9, 4))
    assert same(q, copies=[(50, 100, 50), (151, 449, 50), (700, 60, 200)])
    assert same(q, copies=[(50, 100, 50)], cache_bits=6, groups=(3, RNG.integers(0, 2, (2, 25))))
    z = np.zeros((4, 40), np.uint32)
    assert same(z, copies=[(1, 159, 1)])


def test_header_is_the_formats():
    data = encode(np.full((3, 2), 0xFF102030, np.uint32))
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and data[20] == 0x2F
    assert int.from_bytes(data[4:8], "little") == len(data) - 8 and len(data) % 2 == 0
    bits = int.from_bytes(data[21:25], "little")
    assert bits & 0x3FFF == 1 and bits >> 14 & 0x3FFF == 2 and bits >> 29 == 0


def test_damage():
    data = encode(RNG.integers(0, 2**32, (20, 20), dtype=np.uint32))
    for bad in (b"", b"RIFF" + bytes(30), data[:60], data[:20] + b"\0" + data[21:]):
        with pytest.raises(WebpError):
            decode(bad)


def test_a_file_of_another_encoder():
    """The one-pixel image that browsers are asked to decode to show that they know the format."""
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert decode(data).tolist() == [[0]]
    chunk = data[12:]
    extended = b"VP8X" + (10).to_bytes(4, "little") + bytes(10) + b"ICCP" + (3).to_bytes(4, "little") + b"abc\0" + chunk + b"EXIF" + (2).to_bytes(4, "little") + b"xy"
    assert decode(b"RIFF" + (4 + len(extended)).to_bytes(4, "little") + b"WEBP" + extended).tolist() == [[0]]
    with pytest.raises(WebpError):
        decode(b"RIFF" + bytes(4) + b"WEBPVP8X" + (10).to_bytes(4, "little") + bytes(10))


@pytest.mark.parametrize("window", [64, 1000, 1 << 14])
def test_windows_of_bits_join_like_one(monkeypatch, window):
    monkeypatch.setattr(webp, "WINDOW", window)
    for text in PAYLOADS:
        p = media.payload_of(text)
        assert media.load(media.store(p)) == p
    grey = RNG.integers(0, 256, (40, 40)).astype(np.uint32) << np.uint32(8)
    grey.ravel()[500:800] = grey.ravel()[100:400]
    assert same(grey) and same(grey, copies=[(500, 300, 400)])
    data = encode(grey)
    with pytest.raises(WebpError):
        decode(data[: len(data) - 300])


def test_a_long_text_takes_little_memory():
    import tracemalloc

    words = RNG.integers(0, 50_000, 3_500_000)
    p = media.payload_of(" ".join(map(str, words.tolist())))
    assert len(p) > 19_000_000
    tracemalloc.start()
    assert media.load(media.store(p)) == p
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 400_000_000
    image = RNG.integers(0, 256, (1 << 13, 576)).astype(np.uint32) << np.uint32(8)
    data = encode(image)
    tracemalloc.start()
    assert (decode(data) == image).all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 250_000_000


PAYLOADS = ["", None, "a" * 5000, "ab\n" * 3000, "😀" * 300, "abcdefghijklmnopqrstuvwxyz0123456789\n" * 2000, "\xff" * 700, "a line that is long enough to count\n" * 9 + "x", "é" * 288]


@pytest.mark.parametrize("text", PAYLOADS)
def test_payloads(text):
    p = media.payload_of(text)
    assert len(p) % 576 == 0 and p and media.load(media.store(p)) == p


def test_payloads_of_many_rows(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 3)
    p = media.payload_of("some text\n" * 900)
    stored = media.store(p)
    assert media.load(stored) == p and sum(1 for _ in media.images(stored)) == -(-len(p) // (576 * 3))


def test_query(spark, monkeypatch):
    docs = odd.documents(spark)
    monkeypatch.setattr(q07_media, "table", lambda *a: docs)
    got = sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in q07_media.query(spark, "").collect())

    def want(t):
        n = len((t or "").encode())
        p = (t or "").encode() + b"\xff" * (max(1, -(-n // 576)) * 576 - n)
        return n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])

    assert got == sorted(want(r["text"]) for r in docs.collect())


def test_columns(spark):
    stored = media.to_media(odd.documents(spark).filter("doc_id < 4"))
    pixels = media.to_pixels(stored).collect()
    assert all(r["width"] == 576 and len(r["pixels"]) == 576 * r["height"] for r in pixels)
    odd_media = spark.createDataFrame([(1, b"no image"), (2, None)], "doc_id long, media binary")
    assert [(r["pixels"], r["error"] is None) for r in media.to_pixels(odd_media, strict=False).collect()] == [(None, False), (None, True)]
    assert media.to_media(odd.empty(spark)).count() == 0


def test_a_palette_only_where_samples_share_a_pixel(monkeypatch):
    used, real = [], media.encode
    monkeypatch.setattr(media, "encode", lambda p, **k: used.append(k["transforms"]) or real(p, **k))
    for text, palette in (("ab" * 900, True), ("abcdefghijklmnop" * 50, False), ("The quick brown fox jumps over the lazy dog.\n" * 70, False)):
        p = media.payload_of(text)
        stored = media.store(p)
        assert used.pop() == ([GREEN, PALETTE] if palette else [GREEN]) and media.load(stored) == p
