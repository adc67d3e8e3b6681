"""The text queries over whole texts of many lines, beside brute force."""

import re
from unicodedata import normalize

import pytest

from foliospark.functions.bidi import levels_of, reorder
from foliospark.plans.text_queries import ARABIC, FORMS, LATIN, QUERIES

TEXTS = {1: "0123456789 " * 9 + "Late words after ninety-nine characters", 2: "one  two\n\nthree, four 5\n" + "many words of a long line " * 90, 3: "12 34", 4: ""}


def lines_of():
    for doc, text in TEXTS.items():
        for k, line in enumerate(text.split("\n")):
            latin = re.sub(" +", " ", re.sub("[^A-Za-z ]", "", line).lower()).strip(" ")
            yield doc, k, latin.translate(str.maketrans(LATIN, ARABIC)), latin.translate(str.maketrans(LATIN, FORMS))[::-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


EXPECTED = {
    "bidi_nfkc_roundtrip": lambda t, v: (t,),
    "logical_lines": lambda t, v: (t,),
    "strip_tatweel": lambda t, v: (t.replace(" ", "ـ "),),
    "strip_mark_bases": lambda t, v: (t.replace(" ", "َ "),),
    "presentation_forms": lambda t, v: (len(v) - v.count(" "), 0),
    "stranded_marks": lambda t, v: (t.count(" "), t.count(" ")),
}


@pytest.mark.parametrize("name", EXPECTED)
def test_every_line_of_a_whole_text(spark, folder, name):
    got = sorted(tuple(r) for r in QUERIES[name](spark, folder).collect())
    assert got == sorted((doc, k, *EXPECTED[name](t, v)) for doc, k, t, v in lines_of())


def test_scores_count_whole_texts(spark, folder):
    rows = list(lines_of())
    chars = sum(len(v) for *_, v in rows)
    got = {r["how"]: (r["chars"], r["forms"], r["reversed"]) for r in QUERIES["extractor_scores"](spark, folder).collect()}
    forms = sum(len(v) - v.count(" ") for *_, v in rows)
    assert got == {"raw": (chars, forms, sum(not v for *_, v in rows)), "nfkc": (chars, 0, sum(normalize("NFKC", v) == t[::-1] for _, _, t, v in rows))}


def test_right_to_left_letters_and_spaces_are_all_of_level_one():
    for text in (" ", "اب", " ﺍﺏ  ﺙ ", ARABIC + " " + FORMS, "אב ג ", *(" ".join((ARABIC[k:], FORMS[:k])) for k in range(len(ARABIC)))):
        assert set(levels_of(text, 1)) == {1} and reorder(text, True) == text[::-1]
    assert reorder("اب 12\nاب", True) == "\n12 بابا"
