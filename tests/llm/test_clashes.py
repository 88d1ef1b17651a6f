"""Operators on tables whose further columns have the names that operators use inside."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hunkwise.llm import chat, decontam, htmlextract, langid, linededup, media, mixing, pii, simhash, toxicity

NAMES = """a adds asked at b bits block bucket c1 c2 class copies counts cut d digest drawn draw drops edge end extra feats file first fold found fp g hamming hits hot hs id ik index kept key key_id
key_text kind lacks last least left length line linked links lo lost member n n_bytes need new ns offset p part pick place pos prop rank rate rest root roles row score score_ second shard sig size sort
source_size start starts stays sure t taken target th times token u w ws x _clean _d _dropped _found _hits _linked _lines _lost _new _text _th _toxicity __index_level_0__ KEY_ID Score""".split()
TEXTS = [
    "a first line that has many words in it and then some\nshort\nmail me at a.person@mail.example.com", "a first line that has many words in it and then some\nanother line altogether", None, "",
    "one two three four five six seven eight nine ten eleven twelve", "some quite ordinary words about a house and a garden in the north of the land", "some quite ordinary words about a house and a garden in the north of the land",
]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame([(k + 1, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def crowded(plain):
    return plain.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES if n.lower() not in [m.lower() for m in NAMES[: NAMES.index(n)]]])


def rows(df, names=("doc_id", "text")):
    return sorted(map(str, ([r[c] for c in names] for r in df.collect())))


@pytest.fixture(scope="module")
def tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve", "h", 1)], "item_id long, text string, h string, n int")
    return bench, spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (5, 0, "x")], "doc_id long, toxic int, p string")


def test_filters_keep_further_columns(plain, crowded, tables):
    bench, labels = tables
    for operate in (linededup.clean, simhash.keep_one, lambda d: decontam.clean(d, bench), lambda d: toxicity.drop_toxic(d, labels)):
        got = operate(crowded)
        assert got.columns == crowded.columns and rows(got) == rows(operate(plain))
        assert all(r[c] == f"own {c}" for r in got.collect() for c in crowded.columns[5:])


def test_pseudonyms_replace_columns_of_their_own_names(plain, crowded):
    got = pii.pseudonymise(crowded, "k")
    assert rows(got, ("doc_id", "_clean", "_found")) == rows(pii.pseudonymise(plain, "k"), ("doc_id", "_clean", "_found"))
    assert sorted(got.columns) == sorted(crowded.columns)


def test_queries_ignore_further_columns(plain, crowded, tables):
    bench, labels = tables
    for operate in (mixing.mix, langid.identify, media.media_columns, linededup.report, lambda d: pii.report(d, "k"), lambda d: decontam.report(d, bench), simhash.components, lambda d: toxicity.toxicity(d, labels)):
        one, two = operate(plain), operate(crowded)
        names = [c for c in one.columns if c not in ("shard", "offset")]
        assert one.columns == two.columns and rows(one, names) == rows(two, names)


def test_other_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<p>text</p>", "x", "y")], "page_id long, url string, html string, text string, n_chars string")
    assert [tuple(r) for r in htmlextract.extract(pages).collect()] == [(1, "u", "text", 4)]
    turns = spark.createDataFrame([(1, 0, "user", "Hi?", 1, "x", "y", "z")], "conv_id long, turn long, role string, text string, at int, part string, before string, begins string")
    assert chat.report(turns).count() == 1


def test_filters_of_repeated_ids(spark):
    """Rows (3, A), (5, A), (5, B): B is no copy of anything and stays."""
    a, b = "some words that make a text of their own here", "entirely different content under the same number"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert rows(simhash.keep_one(docs)) == rows(docs.where(F.col("text") == b).union(docs.limit(1)))
    more = spark.createDataFrame([(5, a), (7, a), (5, b), (3, b), (None, a), (None, "alone, without an id"), (None, "alone, without an id")], "doc_id long, text string")
    assert rows(simhash.keep_one(more)) == sorted(map(str, ([5, a], [3, b], [None, "alone, without an id"])))
