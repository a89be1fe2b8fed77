"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers, each kind leftmost and non-overlapping. A match
that fails its check (parts over 255, Luhn, number of digits) is dropped and not tried again.

Method: every base value is a protected entity c. Words near its mentions are terms t. Over the corpus of N distinct
texts, n(c) have c, n(t) have t, and n(c, t) have t near a mention of c. c's information content is
IC(c) = -log2(n(c) / N), and what t tells of it PMI(c; t) = log2(N * n(c, t) / (n(c) * n(t))). A term that occurs with c
in `support` distinct contexts or more (near-copies of a text are no evidence) discloses it if PMI >= alpha * IC. If PMI
reaches IC itself, t never occurs without c, and it is removed; below that it is generalised. Both hold for every
occurrence in any document.

A null text is the empty text and stays null when it is sanitised. Repeated rows get equal spans. An empty table gives
an empty table. Extra columns are kept by `sanitise`, whatever their names. Time grows with a text's length, its
matches and its terms, not with a product of them: arrays are built in blocks, texts cut from chunks, and terms found by
sorting them together with the text's words. A word is a run of letters; it is a term if it is one in lower case.

The patterns are the plain ones written so that Java's engine takes linear time and no deep recursion: runs that
nothing can follow are possessive, and a match starts at the beginning of a run or where the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut, release, whole_row

KINDS = ("email", "ip", "card", "phone")
#: Pattern of each kind, and a cheap pattern that any text with a match fits.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]++\."),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}
#: Terms: runs of so many letters or more, in so many characters before and after a mention.
TERM, REACH = r"\p{L}{4,}", 120
SPAN = "struct<start:int,kind:int,end:int,value:string>"
NAMES = (*KINDS, "term", "removed")
#: Items of an array that are folded at once, and code points of a text's chunks.
BLOCK, CHUNK = 256, 256
#: Parts that the copies of a text are dealt to where texts meet by digest.
SALTS = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once."""
    return F.transform(F.array(value), body)[0]


def _running(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The integers after each of the items, from 0 on by step(so far, item)."""

    def inner(acc: Column, x: Column) -> Column:
        return _let(step(acc["now"], x), lambda now: F.struct(now.alias("now"), F.concat(acc["out"], F.array(now)).alias("out")))

    def outer(acc: Column, x: Column, whole: Column) -> Column:
        zero = F.struct(acc["now"].alias("now"), F.expr("cast(array() as array<int>)").alias("out"))
        done = F.aggregate(F.slice(whole, x * BLOCK + 1, F.lit(BLOCK)), zero, inner)
        return _let(done, lambda d: F.struct(d["now"].alias("now"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    zero = F.struct(F.lit(0).alias("now"), F.expr("cast(array() as array<array<int>>)").alias("out"))
    blocks = lambda whole: F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(whole) - 1) / BLOCK).cast("int"))
    return _let(items, lambda whole: F.flatten(F.aggregate(blocks(whole), zero, lambda acc, x: outer(acc, x, whole), lambda acc: acc["out"])))


def _spans(text: Column, pattern: Column, kind: Column) -> Column:
    """Every match of a pattern in text, as SPAN in code points."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))

    def placed(x: Column) -> Column:
        ends = _running(F.arrays_zip(x["gaps"].alias("gap"), x["hits"].alias("hit")), lambda at, p: at + F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0)))
        return F.arrays_zip(x["hits"].alias("hit"), F.slice(ends, F.lit(1), F.size(x["hits"])).alias("end"))

    def span(p: Column) -> Column:
        return F.struct((p["end"] - F.length(p["hit"])).alias("start"), kind.alias("kind"), p["end"].alias("end"), p["hit"].alias("value")).cast(SPAN)

    return F.transform(_let(found, placed), span)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of the text with these chunks; what lies beyond its end is left out."""
    first = F.floor(start / CHUNK).cast("int")
    some = F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1)
    return F.when(end > start, F.substring(F.array_join(some, ""), start % CHUNK + 1, end - start)).otherwise("")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _checked(kind: str, span: Column) -> Column:
    return _valid(kind, span["value"])


def _is_kind(i: int, span: Column) -> Column:
    return span["kind"] == i


def count_of(spans: Column, kind: str) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(spans, partial(_is_kind, KINDS.index(kind)))).cast("long")


def base_spans(text: Column) -> Column:
    """The base spans of a text by start, then kind as listed; a null text has none."""
    text, none = F.coalesce(text, F.lit("")), F.expr(f"cast(array() as array<{SPAN}>)")
    found = []
    for i, kind in enumerate(KINDS):
        pattern, hint = PATTERNS[kind]
        spans = F.filter(_spans(text, F.lit(pattern), F.lit(i)), partial(_checked, kind))
        found.append(F.when(F.contains(text, F.lit("@+"[kind == "phone"])) if kind in ("email", "phone") else text.rlike(hint), spans).otherwise(none))
    return F.array_sort(F.concat(*found))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(x) for x in NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _salt() -> Column:
    return F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")


def _salted(rows: DataFrame) -> DataFrame:
    """rows once for each salt, for joins with texts, whose copies are dealt to salts; always by one shuffle of these."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("shuffle_hash")


def _term_spans(body: Column) -> Column:
    """Spans of the words whose lower case is in column `terms`, a sorted array of (term, full); null: none.

    Words and terms are sorted together, a term before its words. So the number of terms up to a word tells which one
    it can be.
    """
    item = "struct<word:string,start:int,end:int,value:string>"

    def found(x: Column) -> Column:
        words = F.transform(x["words"], lambda s: F.struct(F.lower(s["value"]).alias("word"), s["start"], s["end"], s["value"]).cast(item))
        terms = F.transform(x["terms"], lambda t: F.struct(t["term"].alias("word"), F.lit(-1), F.lit(-1), F.lit("")).cast(item))
        return _let(F.array_sort(F.concat(terms, words)), lambda items: placed(items, x["terms"]))

    def placed(items: Column, terms: Column) -> Column:
        upto = _running(items, lambda at, i: at + F.when(i["start"] < 0, 1).otherwise(0))
        asked = F.filter(F.arrays_zip(items.alias("i"), upto.alias("at")), lambda p: (p["i"]["start"] >= 0) & (p["at"] > 0))
        near = F.transform(asked, lambda p: F.struct(p["i"].alias("i"), F.get(terms, p["at"] - 1).alias("t")))
        same = F.filter(near, lambda p: p["t"]["term"] == p["i"]["word"])
        kind = lambda p: F.lit(len(KINDS)) + p["t"]["full"].cast("int")
        return F.transform(same, lambda p: F.struct(p["i"]["start"], kind(p), p["i"]["end"], p["i"]["value"]).cast(SPAN))

    both = F.struct(_spans(body, F.lit(TERM), F.lit(0)).alias("words"), F.col("terms").alias("terms"))
    return F.when(F.col("terms").isNotNull(), _let(both, found)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 0.9, support: int = 3) -> DataFrame:
    """Per document (key, base, spans): its base spans, and all spans with those of disclosing terms."""
    found, marks = _corpus(docs, key, text, alpha, support)
    if marks is None:
        return found.select(F.col("key").alias(key), "base", F.col("base").alias("spans"))
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.md5(body).alias("digest"), body.alias("body"), _salt()).join(_salted(marks), ["digest", "salt"])
    added = cut(texts.select("digest", _term_spans(F.col("body")).alias("added")).groupBy("digest").agg(F.first("added").alias("added")), "pii-added")
    both = found.join(_salted(added), ["digest", "salt"], "left")
    return both.select(F.col("key").alias(key), "base", F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as array<{SPAN}>)")))).alias("spans"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = 0.9, support: int = 3) -> DataFrame:
    """docs with each span of `text` replaced by its kind's label; disclosing terms are generalised or removed.

    Of spans that overlap, the first one's label stands for all.
    """
    found, marks = _corpus(docs, key, text, alpha, support)
    release(found)
    body = F.col("row")[text]
    rows = docs.select(whole_row(docs), _salt())
    spans = base_spans(body)
    if marks is not None:
        rows = rows.withColumn("digest", F.md5(F.coalesce(body, F.lit("")))).join(_salted(marks), ["digest", "salt"], "left")
        spans = F.array_sort(F.concat(spans, _term_spans(F.coalesce(body, F.lit("")))))
    labels = F.array(*(F.lit(LABELS[x]) for x in NAMES))

    def joined(x: Column) -> Column:
        before = F.arrays_zip(x["spans"].alias("s"), F.concat(F.array(F.lit(0)), F.slice(x["ends"], F.lit(1), F.size("spans") - 1)).alias("at"))
        parts = F.transform(F.filter(before, lambda p: p["s"]["start"] >= p["at"]), lambda p: F.concat(_piece(x["chunks"], p["at"], p["s"]["start"]), labels[p["s"]["kind"]]))
        return F.concat(F.array_join(parts, ""), _piece(x["chunks"], F.element_at(x["ends"], -1), F.length(body)))

    ends = _running(F.col("spans"), lambda at, s: F.greatest(at, s["end"]))
    clean = _let(F.struct(F.col("spans").alias("spans"), ends.alias("ends"), _chunks(body).alias("chunks")), joined)
    rows = rows.withColumn("spans", spans).withColumn("clean", F.when(F.size("spans") == 0, body).otherwise(clean))
    return rows.select(*(F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def _pmi(total: int) -> Column:
    return F.log2(F.lit(float(total)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))


def _content(total: int) -> Column:
    return -F.log2(F.col("n_c") / F.lit(float(total)))


def _terms(text: Column) -> Column:
    """The distinct words of a text, each in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"].cast("string"), value)


def _context(chunks: Column, span: Column) -> Column:
    """What stands within REACH before and after a span; a word that REACH may have cut is left out."""
    before = _piece(chunks, F.greatest(F.lit(0), span["start"] - REACH), span["start"])
    after = _piece(chunks, span["end"], span["end"] + REACH)
    before = F.when(span["start"] > REACH, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    after = F.when(F.length(after) == REACH, F.regexp_replace(after, r"\p{L}+$", "")).otherwise(after)
    return F.concat_ws("\n", before, after)


def _mention(chunks: Column, span: Column) -> Column:
    """(entity, context, terms) of a span; a context is told apart by a digest of its lower case."""
    seen = _let(_context(chunks, span), lambda c: F.struct(F.md5(F.lower(c)).alias("context"), _terms(c).alias("terms")))
    return F.struct(_entity(span).alias("entity"), seen["context"].alias("context"), seen["terms"].alias("terms"))


def _corpus(docs: DataFrame, key: str, text: str, alpha: float, support: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, digest, salt, base) of all documents; and (digest, terms) of each text with disclosing terms: a sorted
    array of (term, full), full where the term is to be removed (None if there are none)."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), F.md5(body).alias("digest"), _salt(), body.alias("body"), base_spans(body).alias("base"))
    around = _let(_chunks(F.col("body")), lambda c: F.transform("base", partial(_mention, c)))
    found = cut(base.withColumn("around", F.when(F.size("base") > 0, around)).drop("body"), "pii-spans")

    total = found.select("digest").distinct().count()
    mentions = found.filter("around is not null").select("digest", F.explode("around").alias("m")).select("digest", "m.*")
    mentions = cut(mentions.distinct(), "pii-mentions")
    found = found.drop("around")
    entities = mentions.select("entity", "digest").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    pairs = mentions.select("entity", "context", "terms").distinct().select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    pairs = cut(pairs.filter(F.col("contexts") >= support).select("entity", "term"), "pii-pairs")
    nearby = mentions.select("digest", "entity", F.explode("terms").alias("term"))
    both = nearby.join(pairs, ["entity", "term"], "left_semi").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    # the texts with t near any entity are some of the texts with t, so this bounds the PMI from above
    at_least = nearby.select("term", "digest").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    pairs = both.join(entities, "entity").join(at_least, "term").filter(_pmi(total) >= alpha * _content(total)).drop("n_t")
    pairs = cut(pairs, "pii-pairs")
    if pairs.isEmpty():
        return found, None

    # every text once; its terms that are candidates, and in how many texts each occurs
    # (a digest beside an explode would be worked out again for each word, so it goes into the array)
    held = F.struct(F.md5(body).alias("digest"), _terms(body).alias("terms"))
    words = docs.select(F.explode(_let(held, lambda x: F.transform(x["terms"], lambda t: F.struct(x["digest"].alias("digest"), t.alias("term"))))).alias("w")).select("w.*")
    uses = cut(words.join(pairs.select("term").distinct(), "term", "left_semi").distinct(), "pii-uses")
    freq = uses.groupBy("term").agg(F.count("*").alias("n_t"))
    strength = pairs.join(freq, "term").select("term", _pmi(total).alias("pmi"), _content(total).alias("ic"))
    telling = strength.filter((F.col("pmi") >= alpha * F.col("ic") - 1e-9) & (F.col("ic") > 0))
    telling = cut(telling.groupBy("term").agg(F.max(F.col("pmi") >= F.col("ic") - 1e-9).alias("full")), "pii-terms")
    if telling.isEmpty():
        return found, None

    marks = uses.join(telling, "term").groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("term", "full"))).alias("terms"))
    marks = cut(marks, "pii-marks")
    release(mentions, uses, pairs)
    return found, marks
