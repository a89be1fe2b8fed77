"""The pipeline's stages, each against brute force on what the stage before kept."""

import re

import numpy as np
import odd
import public_tokenizers as P
import tiktoken
from conftest import SF
from test_mixing import filled
from test_pii import base, brute_terms
from test_simhash import grouped, plain

import corpus_pipeline as C
from folioforge.llm import crf, pii
from folioforge.llm.bpe import load_ranks
from folioforge.llm.common import cut, table


def forward_backward(model, text):
    """A text's language and score by plain recursions over its words."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    places = [crf.features(w) for w in words]
    if not any(places):
        return None, 0.0
    emit = np.array([model.weights[p].astype(np.float64).sum(axis=0) if p else np.zeros(len(model.langs)) for p in places])
    pot, move = np.exp(emit - emit.max(axis=1, keepdims=True)), np.exp(model.moves)
    alpha, beta = [np.exp(model.start) * pot[0]], [np.ones(len(model.langs))]
    for t in range(1, len(words)):
        a = alpha[-1] @ move * pot[t]
        alpha.append(a / a.sum())
        b = move @ (pot[len(words) - t] * beta[-1])
        beta.append(b / b.sum())
    node = np.array(alpha) * np.array(beta[::-1])
    node /= node.sum(axis=1, keepdims=True)
    sums = node[[bool(p) for p in places]].sum(axis=0)
    return model.langs[int(sums.argmax())], float(sums.max() / sums.sum())


def replaced(text, terms):
    """The text with its base spans and disclosing terms replaced, by one pass over the spans."""
    spans = [(s, k, e) for s, k, e in base(text)]
    for m in re.finditer(r"[^\W\d_]+", text):
        if (full := terms.get(m[0].lower())) is not None:
            spans.append((m.start(), len(pii.KINDS) + full, m.end()))
    out, at = "", 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += text[at:s] + pii.LABELS[pii.NAMES[k]]
        at = max(at, e)
    return out + text[at:]


def counted(rows):
    out: dict = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def test_stages_like_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, stages, rows = docs.columns, dict(C.STAGES), docs.collect()

    model = crf.fit(docs)
    docs = cut(stages["language"](spark, docs, SF), "language")
    kept = docs.collect()
    scores = {r["doc_id"]: forward_backward(model, r["text"])[1] for r in rows}
    assert all(abs(s - 0.5) > 1e-6 for s in scores.values()) and {r["doc_id"] for r in kept} == {i for i, s in scores.items() if s >= 0.5}
    assert docs.columns == columns and counted(kept) == counted(r for r in rows if scores[r["doc_id"]] >= 0.5)

    groups = grouped([plain(r["text"]) for r in kept], [r["doc_id"] for r in kept])
    want = [r for r, g in zip(kept, groups, strict=True) if r["doc_id"] == g]
    docs = cut(stages["near_copies"](spark, docs, SF), "near_copies")
    kept = docs.collect()
    assert docs.columns == columns and counted(kept) == counted(want) and len(kept) < len(rows)

    terms = brute_terms([r["text"] for r in kept])
    want = {r["doc_id"]: replaced(r["text"], terms) for r in kept}
    before = {r["doc_id"]: r for r in kept}
    docs = cut(stages["personal_data"](spark, docs, SF), "personal_data")
    kept = docs.collect()
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in kept} == want and any(want[i] != r["text"] for i, r in before.items())
    assert all(r["n_chars"] == len(r["text"]) and (r["lang"], r["source"]) == (before[r["doc_id"]]["lang"], before[r["doc_id"]]["source"]) for r in kept)

    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in kept}
    sizes: dict = {}
    for r in kept:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    targets = filled(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    docs = cut(stages["mixture"](spark, docs, SF), "mixture")
    mixed = counted(docs.collect())
    assert docs.columns == columns and set(mixed) <= set(kept)
    taken: dict = {}
    for r in kept:
        whole = int(targets[r["source"]] / sizes[r["source"]] + 1e-12)
        assert mixed.get(r, 0) in (whole, whole + 1) and mixed.get(r, 0) <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + mixed.get(r, 0) * size[r["doc_id"]]
    largest = {s: max(size[r["doc_id"]] for r in kept if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in sizes)

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r["doc_id"]: r["text"] for r in kept}
    last = stages["tokens"](spark, docs, SF).collect()
    assert len(last) == sum(mixed.values())
    assert all(r["ids"] == own.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["lossless"] for r in last)


def test_odd_rows(spark):
    for docs in (odd.documents(spark), odd.empty(spark)):
        for name, stage in C.STAGES:
            docs = cut(stage(spark, docs, SF), name)
        assert docs.count() >= 0


def test_run(spark):
    assert C.run(spark, SF).columns == ["doc_id", "lang", "source", "ids", "lossless", "n_tokens"]
