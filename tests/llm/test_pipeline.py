"""The corpus pipeline, stage by stage against brute force, on a small corpus with odd rows."""

from __future__ import annotations

import itertools
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from hunkwise.llm import mixing, toxicity

from .test_operators import classes, near_lines

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def order(row: tuple) -> tuple:
    """Rows without an id last; rows of one id by a hash of their text."""
    return row[0] is None, row[0] or 0, text_hash(row[1]) if row[1] is not None else 42


def without_repeated_lines(rows: list[tuple]) -> list[tuple]:
    distinct = sorted({r[:2] for r in rows if r[1] is not None}, key=order)
    lines = {x for _, t in distinct for x in t.split("\n") if WORD.search(x)}
    words = {x: Counter(x.split(" ")) for x in lines}
    by_size: dict = {}
    for x in lines:
        by_size.setdefault(words[x].total(), []).append(x)
    links = []
    for n, some in by_size.items():
        for m in range(n, n + 4):
            for a, b in itertools.product(some, by_size.get(m, [])):
                if (a < b or m > n) and ((words[a] - words[b]).total() <= 3 or n < 12) and abs(len(a) - len(b)) <= 200 and near_lines(a, b):
                    links.append((a, b))
    kind = {x: min(g) for g in classes(lines, links) for x in g}
    seen, made = set(), {}
    for doc, text in distinct:
        kept = []
        for x in text.split("\n"):
            if x in kind and kind[x] in seen:
                continue
            if x in kind:
                seen.add(kind[x])
            kept.append(x)
        made[doc, text] = "\n".join(kept)
    out = []
    for doc, text, lang, source, n in rows:
        new = made.get((doc, text), text)
        if new == text:
            out.append((doc, text, lang, source, n))
        elif WORD.search(new):
            out.append((doc, new, lang, source, len(new)))
    return out


def one_of_each(rows: list[tuple]) -> list[tuple]:
    def fingerprint(text: str | None) -> int:
        words = WORD.findall((text or "").translate(LOWER))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {t: fingerprint(t) for t in {r[1] for r in rows}}
    groups = classes(set(prints.values()), [p for p in itertools.combinations(set(prints.values()), 2) if (p[0] ^ p[1]).bit_count() <= 2])
    group = {p: min(g) for g in groups for p in g}
    first: dict = {}
    for r in sorted(rows, key=order):
        first.setdefault(group[prints[r[1]]], r)
    return list(first.values())


def without_leaks(rows: list[tuple], items: list[str | None]) -> list[tuple]:
    sizes = {min(5, len(WORD.findall((i or "").lower()))) for i in items} - {0}

    def shingles(text: str | None, size: int) -> list[str]:
        words = WORD.findall((text or "").lower())
        return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]

    docs = {r[:2] for r in rows}
    df = Counter(s for _, t in docs for k in sizes for s in set(shingles(t, k)))
    weight = lambda s: 1 + ((len(rows) // df[s]).bit_length() - 1) if df[s] else len(rows).bit_length()
    leaked = set()
    for item in {i for i in items if i and i.split()}:
        n = len(WORD.findall(item.lower()))
        size = min(5, n)
        bag = Counter(shingles(item, size))
        whole = sum(k * weight(s) for s, k in bag.items())
        for doc in docs - leaked:
            parts = shingles(doc[1], size)
            if any(s in bag for s in parts):
                for at in range(len(parts)):
                    if parts[at] in bag and sum(min(k, bag[s]) * weight(s) for s, k in Counter(parts[at : at + n - size + 1]).items()) >= 0.8 * whole - 1e-6:
                        leaked.add(doc)
                        break
    return [r for r in rows if r[:2] not in leaked]


def listed(df) -> list[tuple]:
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = pd.read_parquet(f"{DIR}/documents.parquet")[COLUMNS]
    item = pd.read_parquet(f"{DIR}/benchmark.parquet").text.iloc[0]
    top = int(docs.doc_id.max())
    odd = [
        (top + 1, None, "en", "a", 0), (top + 2, "", None, None, 0), (top + 3, "  \n\t", "en", "b", 4), (None, "a text that has no id but some words of its own in it", "en", "a", 50),
        (None, "a text that has no id but some words of its own in it", "en", "a", 50), (5, "another text under an id that is taken, on a line of its own", "fr", "b", 60),
        (top + 4, "same row twice, in every column, ties included", "en", "a", 46), (top + 4, "same row twice, in every column, ties included", "en", "a", 46),
        (top + 5, "word " * 40_000, "en", "c", 200_000), (top + 6, f"before it {item} and after it", "en", "c", 99), (top + 7, "short", "en", "c", 5), (top + 8, "short\nx", "en", "c", 7),
        (top + 9, docs.text.dropna().iloc[3], "en", "z", 1), (top + 10, docs.text.dropna().iloc[3] + " and two", "en", "z", 1),
    ]
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in docs.itertuples(index=False)] + odd
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DIR}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def same(got: list[tuple], want: list[tuple]) -> bool:
    return Counter(got) == Counter(want)


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = listed(docs)
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    brute = {
        "toxicity": lambda rs: [r for r in rs if model.score(r[1]) < 0.5], "line_dedup": without_repeated_lines, "simhash_dedup": one_of_each, "decontamination": lambda rs: without_leaks(rs, items),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, corpus)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got, want = listed(docs), brute[name](rows)
        if name == "simhash_dedup":  # rows that agree in id and text: any of them
            got, want = [r[:2] for r in got], [r[:2] for r in want]
        assert same(got, want), (name, list((Counter(got) - Counter(want)))[:3], list((Counter(want) - Counter(got)))[:3])
        assert len(want) < len(rows), name
        rows = listed(docs)
    name, stage = corpus_pipeline.STAGES[-1]
    got = stage(spark, docs, corpus)
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({mixing.SQL.format(docs=f"'{tmp_path}/decontamination/*.parquet'")}) WHERE copies > 0").fetchall()
    assert same([tuple(r) for r in got.collect()], want) and want


def test_run(spark, corpus):
    """The whole run, twice: reruns agree, and copies and leaks that were put in are gone."""
    one, two = (corpus_pipeline.run(spark, corpus).toPandas() for _ in range(2))
    key = ["doc_id", "copies", "taken"]
    assert sorted(map(repr, one[key].values.tolist())) == sorted(map(repr, two[key].values.tolist()))
    assert one.copies.min() > 0 and (one.taken == one.copies * one["size"]).all()


def test_run_on_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
