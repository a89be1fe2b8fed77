"""Byte-level BPE encoding and decoding by monoid tree reduction.

Token sequences form a monoid. The product of two encodings is the encoding of the joined bytes: it is plain
concatenation unless a merge crosses the seam. A sequence is the canonical encoding of its bytes exactly if every
two neighbours are *compatible*, that is, if encoding the bytes of just these two gives the two back. So a join
re-encodes a window around the seam and doubles it on either side until the token outside is compatible with the
first token inside; everything further out then provably stays as it is.

`encode` halves a piece down to single tokens and joins the halves upwards. Matches of the split pattern are
encoded separately, so between them the product is concatenation. Decoding concatenates up the same kind of tree.

Null text is the empty text: no tokens. Repeated rows, ties and extra columns are left as they are.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from folioforge.llm.common import workers

#: Entries of each generation of a memo in a Python worker. Results don't depend on it.
MEMO = 250_000
#: A piece of so many bytes is a leaf of the encoding tree: it is one window.
LEAF_BYTES = 6
#: Parts of a text that are held at once, so that one huge text doesn't fill the memory.
BLOCK = 1 << 18
#: Unicode's white space but for space and line feed, and the two side by side.
OTHER_SPACE = ("  ", " \n", "\n ", *map(chr, (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Ids that a leaf of the decoding tree concatenates.
LEAF = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    return ranks_of(Path(path).read_bytes())


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern)
        self.text = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.text[rank] = token
        self._leaves = Memo(self.window)
        self._seams = Memo(self._seam)
        self._pieces = Memo(lambda s: self.pack(self.piece(s.encode("utf-8", "surrogatepass"))))
        self._spaced = Memo(self._after_space)

    # -- the monoid ---------------------------------------------------------------------------------------------

    def window(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of a window's bytes: the lowest rank merges first, the leftmost of equal ones before others."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        if len(piece) > 48:
            return self._long_window(piece)
        n, rank = len(piece), self.ranks.get
        parts = [piece[i : i + 1] for i in range(n)]
        scores = [rank(piece[i : i + 2], 1 << 60) for i in range(n - 1)]
        while scores:
            low = min(scores)
            if low == 1 << 60:
                break
            k = scores.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = rank(parts[k - 1] + parts[k], 1 << 60)
            if k < len(scores):
                scores[k] = rank(parts[k] + parts[k + 1], 1 << 60)
        return tuple(map(self.ranks.__getitem__, parts))

    def _long_window(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap over a linked list, for windows that have grown long."""
        n, rank = len(piece), self.ranks.get
        end, left, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := rank(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
                continue
            alive[end[i]] = 0
            end[i] = stop
            if stop < n:
                left[stop] = i
            offer(left[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def _seam(self, pair: tuple[int, int]) -> tuple[int, ...]:
        """The tokens of the bytes of two neighbours; none if these are the two themselves."""
        middle = self.window(self.text[pair[0]] + self.text[pair[1]])
        return () if middle == pair else middle

    def compatible(self, a: int, b: int) -> bool:
        """Whether these two tokens, side by side, are the encoding of their bytes."""
        return not self._seams[a, b]

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The product: the encoding of the bytes of both."""
        if not left or not right:
            return left + right
        middle = self._seams[left[-1], right[0]]
        if not middle:
            return left + right
        a, b = len(left) - 1, 1
        while True:
            stable_left = a == 0 or not self._seams[left[a - 1], middle[0]]
            stable_right = b == len(right) or not self._seams[middle[-1], right[b]]
            if stable_left and stable_right:
                return left[:a] + middle + right[b:]
            if not stable_left:
                a = max(0, len(left) - 2 * (len(left) - a))
            if not stable_right:
                b = min(len(right), 2 * b)
            middle = self._leaves[b"".join(map(self.text.__getitem__, left[a:] + right[:b]))]

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of one match of the pattern: that of its halves, joined."""
        if len(piece) <= LEAF_BYTES:
            return self._leaves[piece]
        mid = len(piece) // 2
        return self.join(self.piece(piece[:mid]), self.piece(piece[mid:]))

    # -- texts --------------------------------------------------------------------------------------------------

    @staticmethod
    def pack(ids: tuple[int, ...]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _after_space(self, part: str) -> bytes:
        """The packed ids of a space and the part of a text up to the next one."""
        if part.isalpha():
            return self.pack(self.piece(b" " + part.encode()))
        if part[:-1].isalpha() and not part[-1].isspace() and not part[-1].isnumeric():
            return self._spaced[part[:-1]] + self._pieces[part[-1]]
        return b"".join(map(self._pieces.__getitem__, self.find.findall(" " + part)))

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        A space between two characters that are no white space begins a match whatever surrounds it, so what lies
        between such spaces is looked up whole; text with other white space beside a space goes match by match.
        """
        if len(text) > BLOCK:
            found = (m[0] for m in self.find.finditer(text))
            blocks = []
            while block := list(itertools.islice(found, BLOCK)):
                blocks.append(b"".join(map(self._pieces.__getitem__, block)))
            return b"".join(blocks)
        if not text or text[0] == " " or text[-1] == " " or any(x in text for x in OTHER_SPACE):
            return b"".join(map(self._pieces.__getitem__, self.find.findall(text)))
        first, *spaced = text.split(" ")
        head = b"".join(map(self._pieces.__getitem__, self.find.findall(first)))
        return head + b"".join(map(self._spaced.__getitem__, spaced))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.packed(text)).cast("I").tolist()

    def decode(self, ids: list[int] | memoryview) -> bytes:
        """The bytes of ids: those of the halves, concatenated; a leaf is a bounded run of ids."""
        if len(ids) <= LEAF:
            return b"".join(map(self.text.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class Memo(dict):
    """A bounded memo of a function in two generations: what the older one still holds moves up when it is asked for."""

    def __init__(self, make: Callable):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Bpe:
    return Bpe(load_ranks(path), pattern)


@lru_cache(maxsize=2)
def sent(ranks: bytes, pattern: str) -> Bpe:
    """The vocabulary of a rank file's bytes; a worker makes it once."""
    return Bpe(ranks_of(ranks), pattern)


def shipped(docs: DataFrame, path: str) -> Broadcast[bytes]:
    """The rank file at the driver's path, sent to the executors: it has a fixed size."""
    workers(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", lossless: str = "lossless") -> DataFrame:
    """docs with an array column `ids` of each whole text's token ids, and whether these decode to the text's bytes.

    Columns of these names are replaced.
    """
    ranks = shipped(docs, path)
    docs = docs.drop(*({ids, lossless} - {text}))
    keep = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent(ranks.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(keep.index(text)).to_pylist()]
            packed = [bpe.packed(t) for t in texts]
            same = [bpe.decode(memoryview(p).cast("I")) == t.encode("utf-8", "surrogatepass") for p, t in zip(packed, texts, strict=True)]
            offsets = [0, *itertools.accumulate(len(p) // 4 for p in packed)]
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(same, pa.bool_())], [*keep, ids, lossless])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{ids}` array<int>", f"`{lossless}` boolean"]))


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with `text` decoded from the token ids; null ids are no ids. Bytes that are no UTF-8 become U+FFFD."""
    ranks = shipped(docs, path)
    docs = docs.drop(text) if ids != text else docs
    keep = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent(ranks.value, pattern)
        for batch in batches:
            out = [bpe.decode(x or []).decode("utf-8", "replace") for x in batch.column(keep.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*keep, text])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, f"`{text}` string"]))


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its key, the number of tokens, and digests of the ids and of the bytes decoded from them.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded bytes;
    `lossless` tells whether these are the text's. Only digests leave the worker, so the ids are never shuffled.
    """
    ranks = shipped(docs, path)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = sent(ranks.value, pattern), hashlib.sha256
        for batch in batches:
            n, ids, decoded, same = [], [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                packed = bpe.packed(t)
                back = bpe.decode(memoryview(packed).cast("I"))
                n.append(len(packed) // 4)
                ids.append(sha(packed).hexdigest())
                decoded.append(sha(back).hexdigest())
                same.append(back == t.encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256", "lossless"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
