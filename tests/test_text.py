"""Column builders of text on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions import vectors as V


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def cases():
    return [
        (T.highlight("t", "a.b"), "xA.by a-b", "x<mark>A.b</mark>y a-b"),
        (T.highlight("t", "\\E("), "q\\E(", "q<mark>\\E(</mark>"),
        (T.occurrences("t", "aa"), "aaaAa", 2),
        (T.occurrences("t", ""), "aaa", 0),
        (T.escape_highlight("t", "b"), "<a> & b", "&lt;a&gt; &amp; <mark>b</mark>"),
        (T.escape_html("t"), None, ""),
        (T.snippet("t", "fox"), "A dog. The Fox ran! Then\nfox", "The <mark>Fox</mark> ran!"),
        (T.snippet("t", "cow"), "A dog.", ""),
        (T.truncate("t", 5), "abcdef", "abcd…"),
        (T.truncate("t", 6), "abcdef", "abcdef"),
        (T.is_short("t"), "one two three four", True),
        (T.is_short("t"), "one two three four five", False),
        (T.present("t"), " \n", False),
        (T.present("t"), None, False),
        (T.slug("t"), "Hello, World  x!", "hello-world-x"),
        (T.section_class("t"), "Chapter VI", "other"),
        (T.section_valid("t"), "Chapter VI", True),
        (T.section_valid("t"), "Abstract table", False),
        (T.college_line("t"), "x\n College of Arts of\n", "College of Arts"),
        (T.program_line("t"), "x\n Bachelor of Y ", "Bachelor of Y"),
        (T.page_title("t"), "skip\n\nA long\n title \nA Thesis Presented to", "A long title"),
        (T.page_title("t"), "no cue", None),
        (T.description("t"), "a\nProject Description: one\n two \nChapter 1\nx", "one two"),
        (T.code_of("t", T.COLLEGE_CODES), " College of NURSING ", "con"),
        (T.citation_title("t"), "No period here", "No period here"),
        (T.local_doi("repo", F.lit(None), F.lit(2020), F.lit("bscs"), F.lit(123456)), "", "repo/None.2020.bscs.123456"),
        (T.author_list("t"), "A\n\n B ", ["A", "B"]),
        (T.clean_tags("t"), "The neural  nets and deep models", ["neural nets", "deep models"]),
        (T.clean_tags("t"), "paper", []),
        (T.reply_json("t", "a int"), 'x ```json\n{"a": 3}\n``` y', (3,)),
        (T.reply_json("t", "a int")["a"], "no json", None),
        (T.topic("t", ["net", "deep"]), "Deep Nets", "net"),
        (T.topic("t", []), "x", "Other"),
        (T.clean_lines("t"), " a 0.x \n\n b", ["a O.x", "b"]),
        (T.tokens("t"), "Éa-b2 c", ["éa", "b2", "c"]),
        (T.mend_latin1("t"), "Ã©", "é"),
        (T.mend_latin1("t"), "é", "é"),
        (T.chm_path("t"), "hhctrl://a\\b.htm", "a/b.htm"),
        (T.figure_page("t"), "x/page12_img3.png", 12),
        (T.or_default("t", "d"), "", "d"),
    ]


def test_text(spark):
    for i, (column, text, want) in enumerate(cases()):
        got = one(spark, column.alias("x"), t=text)
        assert (tuple(got) if isinstance(want, tuple) else got) == want, i


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    r = df.select(V.cosine("a", "b"), V.cosine("a", "z"), V.cosine("a", "s"), V.cosine_eps("a", "z"), V.unit("a")).first()
    assert r[0] == pytest.approx(0.96) and r[1] is None and r[2] is None and r[3] == 0 and r[4] == pytest.approx([0.6, 0.8])
