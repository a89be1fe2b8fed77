"""Statistics of whole texts that the quality operators build on. Words are runs of anything but ASCII white space."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from folioforge.llm.common import WORD, workers

SYMBOLS = "#*$%&|<>"
#: Counted statistics of a text, in the order of `count`.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_stops", "n_distinct", "n_long", "n_plain")
_WORDS = regex.compile(WORD)
#: White space that Python's split parts words by, but the operators don't.
_OTHER = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = regex.compile(r"[\x20\x09-\x0D]")
#: Characters of a text that are parted into words at once.
PART = 1 << 20
_CLASSES = {"upper": regex.compile(r"\p{Lu}"), "letter": regex.compile(r"\p{L}"), "digit": regex.compile(r"\p{N}")}


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text) if _OTHER.search(text) else text.split()


def parts_of(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Where the parts of a text begin and end: each has a word, and `size` characters or what is left of a word more."""
    start = at = 0
    while at < len(text):
        found = _SPACE.search(text, min(len(text), at + size))
        end = found.start() if found else len(text)
        if _WORDS.search(text, start, end):
            yield start, end
            start = end
        at = end + 1


def count(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; a null text has no words. A long text is parted into words part by part."""
    text = text or ""
    words = words_of(text) if len(text) <= PART else []
    if words or len(text) <= PART:
        chars, distinct, long, plain, repeated, n = sum(map(len, words)), len(set(words)), sum(len(w) > 20 for w in words), sum(map(str.isalpha, words)), _repeated(words), len(words)
    else:
        n, chars, distinct, long, plain, repeated = _of_parts(text)
    symbols = sum(map(text.count, SYMBOLS))
    lines, dup = _lines(text)
    return (n, chars, symbols, dup, repeated, len(text), lines, *_of(text), text.count("!"), text.count("."), distinct, long, plain)


def _lines(text: str) -> tuple[int, int]:
    """The lines of a text, and those with a word that are equal to an earlier one."""
    n = text.count("\n") + 1
    seen, dup, at = set(), 0, 0
    for _ in range(n if n > 1 else 0):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        at = end + 1
        if line in seen:
            dup += bool(_WORDS.search(line))
        else:
            seen.add(line)
    return n, dup


def _of_parts(text: str) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, distinct, long and plain words, and words in repeated windows, of a long text."""
    ids: dict[str, int] = {}
    coded, chars, long, plain = [np.zeros(0, np.int64)], 0, 0, 0
    for start, end in parts_of(text, PART):
        words = words_of(text[start:end])
        coded.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
        chars += sum(map(len, words))
        long += sum(len(w) > 20 for w in words)
        plain += sum(map(str.isalpha, words))
    word, kinds = np.concatenate(coded), len(ids)
    n = len(word)
    del ids, coded
    if n < 4:
        return n, chars, kinds, long, plain, 0
    pair = np.unique(word[:-1] * kinds + word[1:], return_inverse=True)[1]
    key = pair[:-1] * kinds + word[2:]
    del pair
    order = key.argsort(kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    inside = np.zeros(n, bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(3):
            inside[at + k] = True
    return n, chars, kinds, long, plain, int(inside.sum())


@lru_cache(maxsize=1 << 16)
def _classes(char: str) -> tuple[bool, ...]:
    return tuple(pattern.match(char) is not None for pattern in _CLASSES.values())


def _of(text: str) -> tuple[int, ...]:
    """How many characters of a text are of each class; each distinct character is looked at once."""
    out = [0] * len(_CLASSES)
    kinds = set(text)
    few = ((c, text.count(c)) for c in kinds) if len(kinds) <= 256 else Counter(text).items()
    for char, n in few:
        for k, inside in enumerate(_classes(char)):
            out[k] += n * inside
    return tuple(out)


def _repeated(words: list[str]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    inside = bytearray(n)
    for i, w in enumerate(windows):
        at = first.setdefault(w, i)
        if at != i:
            inside[at : at + 3] = inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (key, COUNTS...), each a long."""
    workers(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([count(t.as_py()) for t in batch.column(1)], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, j]) for j in range(len(COUNTS)))], [key, *COUNTS])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios(counts: np.ndarray) -> np.ndarray:
    """Statistics that don't depend on the order of magnitude, from a matrix of COUNTS."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64), strict=True))
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_letters"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            np.sqrt(c["n_symbols"] / words),
            c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words,
            c["n_upper"] / letters,
            c["n_letters"] / chars,
            np.sqrt(c["n_digits"] / chars),
            np.sqrt(c["n_marks"] / words),
            np.sqrt(c["n_stops"] / words),
            c["n_distinct"] / words,
            np.sqrt(c["n_long"] / words),
            c["n_plain"] / words,
        ],
        axis=1,
    )
