"""Media columns: byte payloads as lossless WebP images, and images as pixel arrays.

A text's payload is its UTF-8, filled up with bytes 255 to a positive multiple of `ROW`. Each byte is one grey 8-bit
sample, a row of the image has `ROW` samples, and the image is stored with green subtracted, prefix codes and
back-references (repeated lines, the fill). If at most 16 bytes occur, a palette of them puts several samples into a
pixel; a larger one saves nothing, as prefix codes have no words for bytes that don't occur. A payload of more than `ROWS` rows becomes
several image files in a row, each of which tells its own length.

A null text is the empty text: one row of fill. Equal texts get equal media. A null medium has null pixels; one that
is no lossless WebP file raises WebpError, or gives null pixels and a message in `error` if `strict` is off.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.llm.common import workers
from folioforge.llm.webp import GREEN, MAX_COPY, MAX_DISTANCE, PALETTE, WebpError, decode, encode

ROW, FILL, TAIL = 576, 255, 32
#: Repeated lines of so many bytes or more become back-references.
LINE = 24
#: Rows of an image file; longer payloads become several, so that memory doesn't grow with the text.
ROWS = 2048
GREY = np.uint32(0x010101)
OPAQUE = np.uint32(0xFF000000)


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(data) // ROW)) * ROW
    return data.ljust(size, bytes([FILL]))


def _copies(payload: bytes) -> list[tuple[int, int, int]]:
    """Back-references of a payload: to the last equal line, and from the second byte of the fill to the byte before."""
    out: list[tuple[int, int, int]] = []
    body = len(payload.rstrip(b"\xff"))
    lines = payload[:body].split(b"\n")
    if len(set(lines)) < len(lines):
        last, at = {}, 0
        for line in lines:
            size = len(line) + (at + len(line) < body)
            if len(line) >= LINE:
                back = at - last.get(line, at)
                if 0 < back <= MAX_DISTANCE:
                    out += _cut(at, len(line), back)
                last[line] = at
            at += size
    if len(payload) - body > 4:
        out += _cut(body + 1, len(payload) - body - 1, 1)
    return out


def _cut(at: int, size: int, back: int) -> list[tuple[int, int, int]]:
    return [(at + k, min(MAX_COPY, size - k), back) for k in range(0, size, MAX_COPY)]


def store(payload: bytes) -> bytes:
    """The payload as one image file, or several in a row."""
    files = []
    for k in range(0, len(payload), ROW * ROWS):
        part = payload[k : k + ROW * ROWS]
        samples = np.frombuffer(part, dtype=np.uint8).reshape(-1, ROW)
        few = np.count_nonzero(np.bincount(samples.ravel(), minlength=256)) <= 16  # then several samples share a pixel
        transforms, copies = ([GREEN, PALETTE], []) if few else ([GREEN], _copies(part))
        files.append(encode(samples.astype(np.uint32) * GREY | OPAQUE, transforms=transforms, copies=copies))
    return b"".join(files)


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixels of each image file in a row of them."""
    while media:
        size = 8 + int.from_bytes(media[4:8], "little")
        yield decode(media[:size])
        media = media[size:]


def load(media: bytes) -> bytes:
    """The payload that `store` made media of."""
    return b"".join((p & np.uint32(255)).astype(np.uint8).tobytes() for p in images(media))


def features(samples: np.ndarray) -> str:
    """Mean, spread, mean step to the next sample and entropy of grey samples, then a histogram in eight bins of 32 levels."""
    n = len(samples)
    counts = np.bincount(samples, minlength=256)
    levels = np.arange(256)
    mean = float(counts @ levels) / n
    spread = max(0.0, float(counts @ (levels * levels)) / n - mean * mean) ** 0.5
    step = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64)) / max(1, n - 1)
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    bins = ",".join(map(str, counts.reshape(8, 32).sum(axis=1).tolist()))
    return f"{mean:.4f} {spread:.4f} {step:.4f} {abs(entropy):.4f} {bins}"


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column of each whole text's image files; a column of that name is replaced."""
    workers(docs.sparkSession)
    docs = docs.drop(media) if media != text else docs
    names, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [store(payload_of(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, pa.binary())], [*names, media])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{media}` binary"]))


def to_pixels(docs: DataFrame, media: str = "media", key: str = "doc_id", strict: bool = True) -> DataFrame:
    """Per image of a medium (key, image, width, height, pixels, error): ARGB pixels by rows as signed 32-bit integers."""
    workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    columns = [key, "image", "width", "height", "pixels", "error"]

    def rows(k, data: bytes | None):
        i = 0
        try:
            if data is None:
                yield k, 0, None, None, None, None
                return
            for i, p in enumerate(images(data)):
                yield k, i, p.shape[1], p.shape[0], p.ravel().view(np.int32), None
        except WebpError as e:
            if strict:
                raise
            yield k, i, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, m in zip(batch.column(0), batch.column(1), strict=True):  # an image is a batch of its own: it may be large
                for row in rows(k.as_py(), m.as_py()):
                    types = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], columns)

    return docs.select(key, media).mapInArrow(run, f"`{key}` {kind}, image int, width int, height int, pixels array<int>, error string")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its key and digests of payload and medium; all but n_bytes come from the bytes that were read back."""
    workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    types = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def one(t: str | None) -> tuple:
        media = store(payload_of(t))
        back = load(media)
        size = len((t or "").encode("utf-8", "surrogatepass"))
        return size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(back, np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types.values(), strict=True))], [key, *types])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
