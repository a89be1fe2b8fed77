"""Language identification of words by a linear-chain conditional random field.

Every word has features: itself (lexicon), its prefixes and suffixes (affixes) and its byte trigrams (n-grams), hashed
into a fixed table of weights. Learned transitions tie neighbours together, so in code-switched text a word without a
strong sign takes its neighbours' language. Forward-backward gives each word's distribution over languages; a
document's language is the one with the largest sum over its words with letters, and the score that sum's share.

Training maximises the likelihood of code-switched sequences, put together from word windows of labelled documents.
The sample is bounded: `SAMPLE` documents, chosen by a hash of their ids, `WINDOW` words from a hashed place of each;
words of more than `LONGEST` characters are no examples. Labelling takes every word whole.

Forward-backward runs over blocks of `BLOCK` words of all documents of a batch at once: first each block's transfer
matrix, then the messages between a document's blocks, then the words inside the blocks. Long texts go through it part
by part: once for the parts' transfer matrices, which make the messages between parts, and once for their words.

A null text, and one without any letter, is `und` with score 0; so is every document if there is nothing to learn
from. Equal texts get equal predictions. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import held_out, workers
from folioforge.llm.textstats import parts_of, words_of

SAMPLE, WINDOW, LONGEST, TABLE, EPOCHS, SEED = 4000, 64, 256, 1 << 16, 60, 5
BLOCK, MEMO = 64, 300_000
#: Characters of the texts that are labelled at once; a longer text goes part by part.
PART = 1 << 20
UNKNOWN = "und"
#: What the hash of each kind of feature begins with.
KINDS = tuple(crc32(x) for x in (b"w", b"p", b"q", b"s", b"t"))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # TABLE x languages
    moves: np.ndarray  # log potential from language to language
    start: np.ndarray


def _hashes(word: str) -> list[int]:
    """Hashes of a word's features: itself, two prefixes, two suffixes, its byte trigrams. It is its letters alone."""
    if not word.isalpha():
        word = word[:-1] if word[:-1].isalpha() else "".join(filter(str.isalpha, word))
        if not word:
            return []
    w = word.lower().encode("utf-8", "replace")
    whole, short, long, end, tail = KINDS
    marked = b"^" + w + b"$"
    return [crc32(w, whole), crc32(w[:2], short), crc32(w[:4], long), crc32(w[-2:], end), crc32(w[-4:], tail), *map(crc32, [marked[i : i + 3] for i in range(len(w))])]


def features(word: str) -> list[int]:
    """Places of a word's features in the table; a word without letters has none."""
    return [x % TABLE for x in _hashes(word)]


def _flat(hashes: list[list[int]], sizes: np.ndarray) -> np.ndarray:
    """Places of many words' features, one after another."""
    return np.fromiter(chain.from_iterable(hashes), dtype=np.int64, count=int(sizes.sum())) % TABLE


def _sums(weights: np.ndarray, hashes: list[list[int]]) -> np.ndarray:
    """The sum of weights at the places of each word's features."""
    sizes = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
    out = np.zeros((len(hashes), weights.shape[1]), dtype=np.float64)
    if sizes.any():
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        out[sizes > 0] = np.add.reduceat(weights[_flat(hashes, sizes)], starts, axis=0)
    return out


# -- training ---------------------------------------------------------------------------------------------------------


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from text and lang of documents outside the held-out fold."""
    labelled = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = labelled.select(key).count()
    place = F.pmod(F.xxhash64(F.lit(SEED), F.col(key)), F.lit(1 << 30))
    share = min(1.0, 1.3 * sample / max(1, n) + 50 / max(1, n))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: (w != "") & (F.length(w) <= LONGEST))
    few = labelled.filter(place < int(share * (1 << 30))).select(F.col(key), F.col(lang).alias("lang"), place.alias("place"), words.alias("words"))
    span = F.slice("words", (1 + F.pmod(F.col("place"), F.greatest(F.lit(1), F.size("words") - WINDOW + 1))).cast("int"), F.lit(WINDOW))
    rows = few.select("place", key, "lang", span.alias("span")).orderBy("place", key, "lang", "span").limit(sample).collect()
    return train([(r["lang"], r["span"]) for r in rows if r["span"]])


def train(windows: list[tuple[str, list[str]]]) -> Model:
    """The model of labelled word windows."""
    langs = sorted({x for x, _ in windows})
    k = len(langs)
    if not k:
        return Model([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(SEED)
    ids: dict[str, int] = {}
    pieces = []  # spans of one language; a sequence is some spans in a row
    for name, words in windows:
        coded = [ids.setdefault(w, len(ids)) for w in words]
        at = 0
        while at < len(coded):
            size = int(rng.integers(4, WINDOW + 1))
            pieces.append((langs.index(name), coded[at : at + size]))
            at += size
    order = rng.permutation(len(pieces))
    seqs, now = [], []
    for p in order:
        now += [(w, pieces[p][0]) for w in pieces[p][1]]
        while len(now) >= WINDOW:
            seqs.append(now[:WINDOW])
            now = now[WINDOW:]
    if now:
        seqs.append(now)
    length = np.array([len(s) for s in seqs])
    word, gold = np.zeros((len(seqs), WINDOW), np.int64), np.zeros((len(seqs), WINDOW), np.int64)
    for i, s in enumerate(seqs):
        word[i, : len(s)], gold[i, : len(s)] = [w for w, _ in s], [g for _, g in s]
    mask = np.arange(WINDOW)[None, :] < length[:, None]
    places = [_hashes(w) for w in ids]
    sizes = np.array([len(p) for p in places])
    flat, owner = _flat(places, sizes), np.repeat(np.arange(len(places)), sizes)
    weights, moves, start = np.zeros((TABLE, k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(x, 1e-3) for x in (weights, moves, start)]
    total = mask.sum()
    for _ in range(EPOCHS):
        emit = np.stack([np.bincount(owner, weights[flat, j], len(places)) for j in range(k)], axis=1)[word]
        wanted, expected = _expected(emit, moves, start, mask, gold)
        diff = (wanted[0] - expected[0])[mask]
        by_word = np.stack([np.bincount(word[mask], diff[:, j], len(places)) for j in range(k)], axis=1)
        grads = [np.stack([np.bincount(flat, by_word[owner, j], TABLE) for j in range(k)], axis=1), wanted[1] - expected[1], wanted[2] - expected[2]]
        for x, g, q in zip((weights, moves, start), grads, squares, strict=True):
            g = g / total * 1000 - 1e-3 * x
            q += g * g
            x += 0.5 * g / np.sqrt(q)
    return Model(langs, weights.astype(np.float32), moves, start)


def _expected(emit: np.ndarray, moves: np.ndarray, start: np.ndarray, mask: np.ndarray, gold: np.ndarray):
    """Counts of labels, transitions and first labels: those of the gold labels, and the model's expectation."""
    n, size, k = emit.shape
    pot, move = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(moves - moves.max())
    alpha, beta = np.zeros_like(pot), np.ones_like(pot)
    alpha[:, 0] = pot[:, 0] * np.exp(start - start.max())
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, size):
        a = alpha[:, t - 1] @ move * pot[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(size - 2, -1, -1):
        b = (pot[:, t + 1] * beta[:, t + 1]) @ move.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], b, 1.0)
    node = alpha * beta
    node /= node.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * move * (pot[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    both = mask[:, 1:]
    hot = np.eye(k)[gold]
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    return (hot, gold_pairs, hot[:, 0].sum(axis=0)), (node, pair[both].sum(axis=0), node[:, 0].sum(axis=0))


# -- labelling --------------------------------------------------------------------------------------------------------


class _Blocks:
    """Sequences that lie one after another, in blocks of BLOCK words: their potentials and transfer matrices.

    fresh: the sequences' first words take the start potentials in place of a transition.
    """

    def __init__(self, model: Model, pot: np.ndarray, sizes: np.ndarray, fresh: bool):
        k, n = pot.shape[1], len(pot)
        self.n, self.fresh = n, fresh
        self.move, self.first = np.exp(model.moves - model.moves.max()), np.exp(model.start - model.start.max())
        self.blocks = blocks = -(-sizes // BLOCK)
        self.total = total = int(blocks.sum())
        seq_of = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        length = np.minimum(BLOCK, sizes[seq_of] - nth * BLOCK)
        self.e = np.ones((BLOCK, total, k))
        self.at = np.arange(BLOCK)[:, None] < length[None, :]
        self.where = np.minimum(begin[None, :] + np.arange(BLOCK)[:, None], n - 1)
        self.e[self.at] = pot[self.where[self.at]]
        self.starts = np.flatnonzero(nth == 0)
        self.last = np.append(self.starts[1:], total) - 1 if total else np.zeros(0, np.int64)
        self.whole = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for t in range(BLOCK):
            moved = (self.whole.reshape(-1, k) @ self.move).reshape(-1, k, k)
            if t == 0 and fresh:
                moved[self.starts] = self.first / k
            step = moved * self.e[t][:, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            self.whole = np.where(self.at[t][:, None, None], step, self.whole)

    def transfer(self) -> np.ndarray:
        """The transfer matrix of all blocks in a row."""
        out = np.eye(self.whole.shape[1])
        for w in self.whole:
            out = out @ w
            out /= out.sum()
        return out

    def marginals(self, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Distributions of all words, given the messages from what lies before and after a single sequence."""
        k, total, starts, e, at, move = self.whole.shape[1], self.total, self.starts, self.e, self.at, self.move
        into, out = np.ones((total, k)), np.ones((total, k))
        if before is not None:
            into[starts], out[self.last] = before, after
        for j in range(1, int(self.blocks.max()) if total else 0):
            now = starts[self.blocks > j] + j
            v = np.einsum("ni,nij->nj", into[now - 1], self.whole[now - 1])
            into[now] = v / v.sum(axis=1, keepdims=True)
            back = self.last[self.blocks > j] - j
            v = np.einsum("nij,nj->ni", self.whole[back + 1], out[back + 1])
            out[back] = v / v.sum(axis=1, keepdims=True)
        alpha = np.empty((BLOCK, total, k))
        a = into
        for t in range(BLOCK):
            a = a @ move
            if t == 0 and self.fresh:
                a[starts] = self.first
            a = a * e[t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[t] = a
        b = out
        for t in range(BLOCK - 1, -1, -1):
            alpha[t] *= b
            b = np.where(at[t][:, None], (e[t] * b) @ move.T, b)
            b /= b.sum(axis=1, keepdims=True)
        alpha /= alpha.sum(axis=2, keepdims=True)
        result = np.empty((self.n, k))
        result[self.where[at]] = alpha[at]
        return result


def marginals(model: Model, pot: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distributions over languages of the words of sequences that lie one after another; pot: their potentials."""
    return _Blocks(model, pot, sizes, True).marginals()


class Labeller:
    """Labels whole texts; keeps the potentials of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.pot, self.lettered = np.zeros((0, len(model.langs))), np.zeros(0, bool)

    def _look_up(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MEMO:
            known.clear()
            self.pot, self.lettered = self.pot[:0], self.lettered[:0]
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            places = [_hashes(w) for w in new]
            score = _sums(self.model.weights, places)
            self.pot = np.concatenate([self.pot, np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-12)])
            self.lettered = np.concatenate([self.lettered, np.array([bool(p) for p in places], bool)])
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def words(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, their number, and each word's distribution and whether it has a letter."""
        split = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        at = self._look_up([w for ws in split for w in ws])
        return split, sizes, marginals(self.model, self.pot[at], sizes), self.lettered[at]

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.model.langs:
            return langs, scores
        those = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for at in _groups(texts, those):
            if len(texts[at[0]]) > PART:
                sums = self.long(texts[at[0]])
                langs[at[0]], scores[at[0]] = self.model.langs[int(sums.argmax())], min(1.0, float(sums.max() / sums.sum()))
                continue
            _, sizes, dist, lettered = self.words([texts[i] for i in at])
            sums = np.add.reduceat(dist * lettered[:, None], np.cumsum(sizes) - sizes, axis=0)
            best, total = sums.argmax(axis=1), sums.sum(axis=1)
            for i, b, s, n in zip(at, best.tolist(), sums.max(axis=1).tolist(), total.tolist(), strict=True):
                langs[i], scores[i] = self.model.langs[b], min(1.0, s / n)
        return langs, scores


    def long(self, text: str) -> np.ndarray:
        """The sums of the distributions of a long text's lettered words, which are never all in memory."""
        k, parts = len(self.model.langs), list(parts_of(text, PART))
        block = lambda p, at: _Blocks(self.model, self.pot[at], np.array([len(at)]), p == 0)
        look = lambda span: self._look_up(words_of(text[span[0] : span[1]]))
        moves = [block(p, look(span)).transfer() for p, span in enumerate(parts)]
        before, after = [np.ones(k)], [np.ones(k)]
        for m in moves[:-1]:
            v = before[-1] @ m
            before.append(v / v.sum())
        for m in moves[:0:-1]:
            v = m @ after[-1]
            after.append(v / v.sum())
        total = np.zeros(k)
        for p, span in enumerate(parts):
            at = look(span)
            dist = block(p, at).marginals(before[p], after[-1 - p])
            total += dist[self.lettered[at]].sum(axis=0)
        return total


def _groups(texts: list, those: list[int]) -> Iterator[list[int]]:
    """Runs of texts with so many characters together; one long text is a run of its own."""
    now, size = [], 0
    for i in those:
        if now and size + len(texts[i]) > PART:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(texts[i])
    if now:
        yield now


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (key, lang_pred, score)."""
    workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            langs, scores = labeller.documents(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs whose language is known with at least this score; the columns stay as they are."""
    workers(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            langs, scores = labeller.documents(batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def runs(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (key, runs): its stretches of words in one language, as (lang, first word, number of words)."""
    workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                if not model.langs or not t or not words_of(t):
                    out.append([])
                    continue
                _, _, dist, _ = labeller.words([t])
                best = dist.argmax(axis=1)
                edges = np.flatnonzero(np.diff(best, prepend=-1))
                out.append([{"lang": model.langs[best[i]], "first": i, "words": j - i} for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(best)], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], [key, "runs"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, runs array<struct<lang:string,first:bigint,words:bigint>>")
