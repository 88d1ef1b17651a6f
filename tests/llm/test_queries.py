"""Registered queries over whole tables against plain Python, held-out accuracy, and what training may depend on."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
import regex

from hunkwise.llm import pii, toxicity
from hunkwise.llm.registry import QUERIES

from .test_operators import classes, near_lines
from .test_pipeline import DIR, WORD, order, without_repeated_lines

DOCS = pd.read_parquet(f"{DIR}/documents.parquet")
TEXT = {int(d): t for d, t in zip(DOCS.doc_id, DOCS.text.astype(object).where(DOCS.text.notna(), None), strict=True)}


def test_language_id_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op2_language_id"](spark, folder).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{folder}/documents.parquet").set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.index]).all()
    both = got.join(docs[["lang", "text"]])
    empty = ~both.text.fillna("").str.contains(r"[^\W\d_]", regex=True)
    assert (both.lang_pred[empty] == "und").all()
    asked = both[both.held_out & both.lang.notna() & ~empty]
    assert (asked.lang == asked.lang_pred).mean() > 0.99 and len(asked) > 200


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, folder).toPandas()
    labels = pd.read_parquet(f"{folder}/labels.parquet").groupby("doc_id").toxic.max()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    asked = got[got.held_out].merge(labels.reset_index(), on="doc_id")
    assert asked.predicted[asked.toxic == 1].mean() > 0.8 and asked.predicted[asked.toxic == 0].mean() < 0.02


def test_toxicity_training_does_not_depend_on_placing(spark):
    rows = [(None, "nothing named"), *[(k % 40, f"word{k % 7} word{k % 11} " + ("vile nasty" if k % 40 < 12 else "fine")) for k in range(120)], (7, None), (7, "")]
    labels = [(k, int(k < 12)) for k in range(40)] + [(3, 0), (3, None), (None, 1), (999, 1), (20, 5)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one, two = toxicity.train(docs, known), toxicity.train(docs.repartition(7), known.repartition(3))
    assert one.weights.keys() == two.weights.keys() and np.allclose([*one.weights.values()], [*two.weights.values()]) and one.bias == pytest.approx(two.bias)
    assert one.score("vile nasty") > one.score("fine")


def test_media(spark):
    got = {r.doc_id: r for r in QUERIES["op3_media_columns"](spark, DIR).collect()}
    assert len(got) == len(TEXT)
    stored: dict = {}
    for doc, text in TEXT.items():
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.width, r.height, r.length) == (64, len(padded) // 64, r.media_bytes)
        assert stored.setdefault(text or "", (r.media_sha256, r.feature, r.shard, r.offset)) == (r.media_sha256, r.feature, r.shard, r.offset)
    assert len({s[0] for s in stored.values()}) == len(stored)


def test_line_dedup(spark):
    rows = [(d, t, None, None, len(t or "")) for d, t in TEXT.items()]
    kept = {r[0]: r[1] for r in without_repeated_lines(rows)}
    lines = sorted({x for t in TEXT.values() if t for x in t.split("\n") if WORD.search(x)})
    # a document without any word left is missing from kept; all its lines with words are dropped
    got = {r.doc_id: r for r in QUERIES["op4_line_dedup"](spark, DIR).collect()}
    assert len(got) == len(TEXT) and len(lines) > 1000
    for doc, text in TEXT.items():
        if text is None:
            assert (got[doc].lines, got[doc].dropped, got[doc].kept_md5) == (0, 0, None)
            continue
        assert got[doc].lines == text.count("\n") + 1
        if doc in kept:
            assert (got[doc].kept_md5, got[doc].kept_chars) == (hashlib.md5(kept[doc].encode()).hexdigest(), len(kept[doc]))
        else:
            assert got[doc].dropped == sum(bool(WORD.search(x)) for x in text.split("\n"))
    assert order((1, "x")) < order((None, "x")) and classes("ab", [("a", "b")]) == {frozenset("ab")} and not near_lines("a", "b")


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban(value: str) -> bool:
    s = value.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_pseudonyms(spark):
    """Every match of the patterns changes if it is valid and stays if not; formats stay, equal values stay linked."""
    everything = regex.compile("|".join(f"(?:{p})" for _, p in pii.KINDS), regex.ASCII)
    kinds = [(k, regex.compile(p, regex.ASCII)) for k, p in pii.KINDS]
    got = {r.doc_id: r for r in QUERIES["op6_pii_pseudonyms"](spark, DIR).collect()}
    assert len(got) == len(TEXT)
    given: dict = {}
    seen: Counter = Counter()
    for doc, text in TEXT.items():
        matches = [m.group() for m in everything.finditer(text or "")]
        gaps = [g for g in (everything.sub("\0", text or "")).split("\0")]
        new = got[doc].text
        if not matches:
            assert (new, got[doc].n_found) == (text, 0)
            continue
        found = re.fullmatch("".join(re.escape(g) + "(.{1,80}?)" for g in gaps[:-1]) + re.escape(gaps[-1]), new, re.DOTALL)
        assert found  # nothing else changes
        changed = 0
        for old, value in zip(matches, found.groups(), strict=True):
            changed += value != old
            kind = next(k for k, p in kinds if p.fullmatch(old))
            seen[kind, value != old] += 1
            digits = lambda s: re.sub(r"\D", "", s)
            if kind == "card":
                assert (value != old) == luhn(digits(old)) and luhn(digits(value)) == luhn(digits(old))
            elif kind == "iban":
                assert iban(value) == iban(old) and (value[:2] == old[:2])
            elif kind == "ip" and value != old:
                assert all(0 <= int(x) <= 255 for x in value.split("."))
            elif kind == "email":
                assert value.split("@")[1] == old.split("@")[1]
            if kind != "ip":
                assert [(c.isdigit(), c.islower(), c.isupper()) for c in value] == [(c.isdigit(), c.islower(), c.isupper()) for c in old] or kind == "secret"
            plain = digits(old) if kind in ("card", "ssn") else old
            assert given.setdefault((kind, plain), digits(value) if kind in ("card", "ssn") else value) == (digits(value) if kind in ("card", "ssn") else value)
        assert got[doc].n_found == changed
    assert sum(n for (_, c), n in seen.items() if c) >= 20
    assert len({(k, v) for (k, _), v in given.items()}) == len(given)  # different values, different pseudonyms


class Article(HTMLParser):
    """The blocks inside a page's article elements."""

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article"):
            self.blocks.append("")
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_html(spark):
    pages = pd.read_parquet(f"{DIR}/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op8_html_extraction"](spark, DIR).collect()}
    assert len(got) == len(pages)
    for page, url, html in zip(pages.page_id, pages.url, pages.html, strict=True):
        parser = Article()
        parser.feed(html)
        want = "\n\n".join(" ".join(b.split()) for b in parser.blocks if b.strip())
        assert (got[page].text, got[page].url, got[page].n_chars) == (want, url, len(want))
