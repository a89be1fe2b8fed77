"""BPE with word ends, encoded by speculation and verification.

Greedy longest match *proposes* the tokens of every new word of a batch. A sequence of tokens is the encoding of its
word exactly if every two neighbours are compatible: if encoding the symbols of just these two gives the two back. So
vectorised checks test all adjacent pairs of the batch's proposals at once, and only words with a failing pair are
*merged exactly*, lowest rank first.

The check needs no encoding. Two neighbours are incompatible if some token x on the right edge of the left one's merge
tree and some y on the left edge of the right one's merge with a rank below that at which x is merged inside its tree
and not above that at which y is (equal ranks go from left to right). This holds where each token comes from one merge
of tokens that came earlier, which `WordBpe` makes sure of; tokens that aren't their own encoding are never proposed.

Texts are normalised as the vocabulary says: NFC, runs of white space as one space, lower case letter by letter. As no
match of its pattern holds white space, what stands between white space is encoded by itself and remembered. Special
tokens are found in the raw text first. Null text is the empty text: no tokens. Repeated rows, ties and extra columns
are left as they are.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioforge.llm.bpe import shipped

#: Entries of each memo in a Python worker, and characters of the longest entry. Results don't depend on them.
MEMO, MEMO_CHARS = 400_000, 64
#: Characters of a text that are parted at white space at once.
PART = 1 << 18
#: Words that are proposed and checked together.
GROUP = 1 << 16
#: Later than any merge.
NEVER = 1 << 30
#: Added to a letter that ends a word; letters are below it. Letters of the words that are merged in rounds, together.
MARKED, SHORT = 1 << 10, 64
_SPACE = regex.compile(r"\s")
_CHUNK = regex.compile(r"\S+")
#: Characters that Python's split takes for white space, but the vocabulary doesn't.
_NO_SPACE = regex.compile(r"[\x1c-\x1f]")
#: Code points that the regex module has as letters or numbers, but Unicode 16 doesn't have yet.
_LATER = regex.compile(
    r"[\u0558\u058B-\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE-\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C-\uAB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F]"
)
#: Lower case letter by letter where Python's differs, by context or by its version of Unicode.
_LOWER = str.maketrans(
    {"\u03A3": "\u03C3", "\u1C89": "\u1C8A", "\uA7CB": "\u0264", "\uA7CC": "\uA7CD", "\uA7CE": "\uA7CF", "\uA7D2": "\uA7D3", "\uA7D4": "\uA7D5", "\uA7DA": "\uA7DB", "\uA7DC": "\u019B"}
    | {chr(c): chr(c + 0x20) for c in range(0x10D50, 0x10D66)}
    | {chr(c): chr(c + 0x1B) for c in range(0x16EA0, 0x16EB9)}
)


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, otherwise one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Coded(NamedTuple):
    """What a piece of text is encoded as."""

    n: int
    ids: str
    tokens: str


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"not the kind of vocabulary that this encoder is for: {steps}")
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.text = {i: t for t, i in itertools.chain(self.vocab.items(), self.special.items())}
        self.letters = dict(enumerate(byte_letters()))
        self._derive([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self._words: dict[str, Coded] = {}
        self._chunks: dict[str, Coded] = {}

    def _derive(self, merges: list[tuple[str, str]]) -> None:
        """Merge trees, as arrays over ids, and which tokens greedy matching may propose."""
        ids = self.vocab
        left, right, new = (np.array([ids[x] for x in part], np.int64) for part in zip(*((a, b, a + b) for a, b in merges), strict=True))
        self.size = max(ids.values()) + 1
        self.born = np.full(self.size, -1)  # the rank of the merge that makes a token
        self.born[new] = np.arange(len(new))
        if len(set(new.tolist())) < len(new) or (np.maximum(self.born[left], self.born[right]) >= self.born[new]).any():
            raise ValueError("each token has to come from one merge of tokens that came earlier")
        self.first, self.last = np.full(self.size, -1), np.full(self.size, -1)
        self.first[new], self.last[new] = left, right
        order = np.argsort(left * self.size + right)
        self.pair_keys, self.pair_ranks = (left * self.size + right)[order], order
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), new.tolist(), strict=True))}
        # A token is its own encoding if nothing merges across its halves before these are merged, and so on downwards.
        crossing = self._crossing(left, right)
        own = np.ones(self.size, bool)
        for rank, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), new.tolist(), strict=True)):
            own[c] = own[a] and own[b] and crossing[rank] == rank
        self.proposable = {t: i for t, i in ids.items() if own[i]}
        self.made = new  # the token of each rank
        self.base = np.zeros(2 * MARKED, np.int64)  # the token of each letter, marked or not
        self.automaton = ahocorasick.Automaton()
        for token, number in self.proposable.items():
            ends = token.endswith(self.end) and token != self.end
            plain = token[: -len(self.end)] if ends else token
            marked = plain[:-1] + chr(ord(plain[-1]) + MARKED) if ends else plain
            self.automaton.add_word(marked, number)
            if len(marked) == 1:
                self.base[ord(marked)] = number
        self.automaton.make_automaton()

    # -- verification -------------------------------------------------------------------------------------------

    def _edge(self, tokens: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens down one edge of each merge tree (-1: none), and the rank at which each is merged."""
        edge, dies = [tokens], [np.full(len(tokens), NEVER)]
        while True:
            below = np.where(edge[-1] >= 0, inner[edge[-1]], -1)
            if not (below >= 0).any():
                return np.stack(edge), np.stack(dies)
            dies.append(np.where(below >= 0, self.born[edge[-1]], -1))
            edge.append(below)

    def _crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens the lowest rank of a merge across their seam, NEVER where there is none."""
        (xs, x_dies), (ys, y_dies) = self._edge(a, self.last), self._edge(b, self.first)
        lowest = np.full(len(a), NEVER)
        for x, x_die in zip(xs, x_dies, strict=True):
            for y, y_die in zip(ys, y_dies, strict=True):
                at = np.flatnonzero((x >= 0) & (y >= 0))
                key = x[at] * self.size + y[at]
                place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = self.pair_ranks[place]
                meets = (self.pair_keys[place] == key) & (rank < x_die[at]) & (rank <= y_die[at])
                lowest[at[meets]] = np.minimum(lowest[at[meets]], rank[meets])
        return lowest

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a[k] and b[k], side by side, are the encoding of their symbols; distinct pairs are tested once."""
        pairs, where = np.unique(a * self.size + b, return_inverse=True)
        return (self._crossing(pairs // self.size, pairs % self.size) == NEVER)[where]

    # -- words --------------------------------------------------------------------------------------------------

    def symbols(self, word: str) -> str:
        """A word with a letter for each of its bytes."""
        return word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)

    def propose(self, symbols: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, where each word's begin) by greedy longest match from left to right.

        The words are matched as one string: only a word's last letter is marked, so no token reaches over it, and as
        each letter is a token, the leftmost longest matches leave nothing out.
        """
        text = "".join([s[:-1] + chr(ord(s[-1]) + MARKED) for s in symbols])
        found = np.array(list(self.automaton.iter_long(text)), np.int64).reshape(-1, 2)
        stops = np.cumsum([len(s) for s in symbols])
        return found[:, 1], np.concatenate([[0], np.searchsorted(found[:, 0], stops)])

    def merge(self, symbols: str) -> tuple[int, ...]:
        """The exact encoding of a word: the merge of lowest rank goes first, the leftmost of equal ones before others."""
        part = [self.vocab[c] for c in symbols[:-1]] + [self.vocab[symbols[-1] + self.end]]
        n, rank = len(part), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, part[i], part[i + 1]) for i in range(n - 1) if (m := rank((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := rank((new, part[k])):
                    heapq.heappush(heap, (*m, i, new, part[k]))
            if (h := before[i]) >= 0 and (m := rank((part[h], new))):
                heapq.heappush(heap, (*m, h, part[h], new))
        return tuple(t for t in part if t >= 0)

    def merge_all(self, symbols: list[str]) -> list[tuple[int, ...]]:
        """`merge` of many words at once: each round makes the next merge of every word that has one left."""
        out: list[tuple[int, ...]] = [()] * len(symbols)
        short = [k for k, s in enumerate(symbols) if len(s) <= SHORT]
        for k in set(range(len(symbols))).difference(short):
            out[k] = self.merge(symbols[k])
        if not short:
            return out
        text = "".join([symbols[k][:-1] + chr(ord(symbols[k][-1]) + MARKED) for k in short])
        part = self.base[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(short)), [len(symbols[k]) for k in short])
        rank = self._ranks(part, word)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(part):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(part)))
            left = np.repeat(lowest < NEVER, sizes)
            done.append((word[~left], part[~left]))
            if not left.any():
                break
            part, word, rank = part[left], word[left], rank[left]
            sizes, lowest = sizes[lowest < NEVER], lowest[lowest < NEVER]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            at = hit[np.searchsorted(hit, starts)]  # the leftmost of each word
            part[at] = self.made[rank[at]]
            kept = np.ones(len(part), bool)
            kept[at + 1] = False
            moved = np.cumsum(kept) - 1
            part, word, rank = part[kept], word[kept], rank[kept]
            again = moved[at]
            again = np.concatenate([again, again[again > 0] - 1])
            rank[again] = self._ranks(part, word, again)
        words, parts = np.concatenate([w for w, _ in done]), np.concatenate([p for _, p in done])
        order = np.argsort(words, kind="stable")
        ends = np.searchsorted(words[order], np.arange(len(short) + 1)).tolist()
        flat = parts[order].tolist()
        for n, k in enumerate(short):
            out[k] = tuple(flat[ends[n] : ends[n + 1]])
        return out

    def _ranks(self, part: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The rank of the merge of each part (or those at some places) with the next one of its word, NEVER if there is none."""
        at = np.arange(len(part)) if at is None else at
        after = np.minimum(at + 1, len(part) - 1)
        key = part[at] * self.size + part[after]
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        same = (self.pair_keys[place] == key) & (at < after) & (word[at] == word[after])
        return np.where(same, self.pair_ranks[place], NEVER)

    def encode_words(self, words: list[str]) -> tuple[list[tuple[int, ...]], int]:
        """The tokens of each word, and how many words had to be merged exactly."""
        symbols = [self.symbols(w) for w in words]
        flat, starts = self.propose(symbols)
        inside = np.ones(max(0, len(flat) - 1), bool)
        inside[starts[1:-1] - 1] = False  # the seam between two words is no pair
        at = np.flatnonzero(inside)
        bad = at[~self.compatible(flat[at], flat[at + 1])] if len(at) else at
        failed = np.unique(np.searchsorted(starts, bad, side="right") - 1).tolist()
        tokens, ends = flat.tolist(), starts.tolist()
        out = [tuple(tokens[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        for k, merged in zip(failed, self.merge_all([symbols[k] for k in failed]), strict=True):
            out[k] = merged
        return out, len(failed)

    # -- texts --------------------------------------------------------------------------------------------------

    def words(self, chunk: str) -> list[str]:
        """The words of a piece of text without white space."""
        if chunk < "\u0100" and max(chunk) < "\u0100":  # such letters are composed, and each has one lower case
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
                return [chunk[:-1].lower(), chunk[-1]]
        chunk = unicodedata.normalize("NFC", chunk) if not chunk.isascii() else chunk
        chunk = chunk.lower() if chunk.isascii() else chunk.translate(_LOWER).lower()
        if not chunk.isascii() and _LATER.search(chunk):
            return [chunk[m.start() : m.end()] for m in self.find.finditer(_LATER.sub("!", chunk))]
        return self.find.findall(chunk)

    def learn(self, chunks: set[str]) -> None:
        """Puts down what new chunks are encoded as; their new words are proposed, checked and mended together."""
        parted = {c: self.words(c) for c in chunks}
        known = self._words
        new = list(set(itertools.chain.from_iterable(parted.values())).difference(known))
        for k in range(0, len(new), GROUP):
            group = new[k : k + GROUP]
            for word, ids in zip(group, self.encode_words(group)[0], strict=True):
                known[word] = Coded(len(ids), " ".join(map(str, ids)), " ".join(map(self.text.__getitem__, ids)))
        out = self._chunks
        for chunk, words in parted.items():
            if len(words) == 1:
                out[chunk] = known[words[0]]
            else:
                n, ids, tokens = zip(*map(known.__getitem__, words), strict=True)
                out[chunk] = Coded(sum(n), " ".join(ids), " ".join(tokens))
        if len(known) > MEMO:
            known.clear()

    def parts(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text between white space, in blocks of bounded size; special tokens have a space before them."""
        if self.specials and any(s in text for s in self.special):
            for k, part in enumerate(self.specials.split(text)):
                if k % 2:
                    yield [" " + part]
                else:
                    yield from self._plain_parts(part)
        else:
            yield from self._plain_parts(text)

    @staticmethod
    def _plain_parts(text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            found = _SPACE.search(text, at + PART) if len(text) - at > PART else None
            stop = found.start() if found else len(text)
            part = text if stop - at == len(text) else text[at:stop]
            yield _CHUNK.findall(part) if _NO_SPACE.search(part) else part.split()
            at = stop

    def encode_texts(self, texts: list[str]) -> Iterator[list[Coded]]:
        """What the chunks of each text are encoded as; short texts of one call are learnt together."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            if len(text) > PART:
                yield from self._group(group)
                group, size = [], 0
                yield [x for part in self.parts(text) for x in next(self._group([part]))]
                continue
            group.append([x for part in self.parts(text) for x in part])
            size += len(text)
            if size > 4 * PART:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[list[Coded]]:
        known = self._chunks
        if len(known) > MEMO:
            known.clear()
        for special, number in self.special.items():
            known[" " + special] = Coded(1, str(number), special)
        new = set(itertools.chain.from_iterable(group)).difference(known)
        self.learn(new)
        for chunks in group:
            yield list(map(known.__getitem__, chunks))
        for chunk in new:
            if len(chunk) > MEMO_CHARS:
                del known[chunk]

    def encode(self, text: str) -> list[int]:
        return [int(i) for coded in next(self.encode_texts([text])) for i in coded.ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids, joined by spaces: the vocabulary names no decoder. Unknown ids are left out."""
        return " ".join(self.text[i] for i in ids if i in self.text)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(Path(path).read_bytes())


@lru_cache(maxsize=2)
def sent(data: bytes) -> WordBpe:
    """The vocabulary of a file's bytes; a worker makes it once."""
    return WordBpe(data)


def _fields(docs: DataFrame) -> list[str]:
    return [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array column `ids` of each whole text's token ids; a column of this name is replaced."""
    data = shipped(docs, path)
    docs = docs.drop(ids) if ids != text else docs
    keep = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent(data.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(keep.index(text)).to_pylist()]
            out = [[int(i) for c in coded for i in c.ids.split()] for coded in bpe.encode_texts(texts)]
            columns = [c for c, name in zip(batch.columns, keep, strict=True) if name != ids]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int32()))], [*(c for c in keep if c != ids), ids])

    return docs.mapInArrow(run, ", ".join([*_fields(docs.drop(ids)), f"`{ids}` array<int>"]))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with `text` decoded from the token ids; null ids are no ids, a column of this name is replaced."""
    data = shipped(docs, path)
    docs = docs.drop(text) if ids != text else docs
    keep = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent(data.value)
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column(keep.index(ids)).to_pylist()]
            columns = [c for c, name in zip(batch.columns, keep, strict=True) if name != text]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string())], [*(c for c in keep if c != text), text])

    return docs.mapInArrow(run, ", ".join([*_fields(docs.drop(text)), f"`{text}` string"]))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its key, the number of tokens, and digests of the ids and of the text decoded from them.

    ids_sha256 is over the decimal ids joined by a space, decoded_sha256 over the decoded text in UTF-8. Only digests
    leave the worker, so nothing is shuffled.
    """
    data = shipped(docs, path)
    kind = docs.schema[key].dataType.simpleString()
    quoted = key.replace("`", "``")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = sent(data.value), hashlib.sha256
        for batch in batches:
            n, ids, decoded = [], [], []
            for coded in bpe.encode_texts([t or "" for t in batch.column(1).to_pylist()]):
                many, numbers, tokens = zip(*coded, strict=True) if coded else ((), (), ())
                n.append(sum(many))
                ids.append(sha(" ".join(numbers).encode()).hexdigest())
                decoded.append(sha(" ".join(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{quoted}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
