"""Registered queries against brute force over whole tables."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pandas as pd
import xxhash

from hunkwise.llm import decontam
from hunkwise.llm.registry import QUERIES

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(words: list[str], size: int) -> list[str]:
    return [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def test_decontamination(spark):
    """No similarity of these tables lies near the limit, so unweighted shingles decide alike."""
    docs, bench = pd.read_parquet(f"{DIR}/documents.parquet"), pd.read_parquet(f"{DIR}/benchmark.parquet")
    items = {i: WORD.findall((t or "").lower()) for i, t in zip(bench.item_id, bench.text, strict=True)}
    bags = {i: Counter(shingles(w, 5)) for i, w in items.items()}
    holders: dict[str, set] = {}
    for i, bag in bags.items():
        for s in bag:
            holders.setdefault(s, set()).add(i)
    want = set()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        words = WORD.findall((text or "").lower())
        for i in set().union(*[holders.get(s, set()) for s in shingles(words, 5)]):
            n = len(items[i])
            for start in range(max(1, len(words) - n + 1)):
                window = Counter(shingles(words[start : start + n], 5))
                if (window & bags[i]).total() >= 0.8 * (window | bags[i]).total():
                    want.add((doc, i))
                    break
    assert {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, DIR).collect()} == want


def test_decontamination_of_common_items(spark):
    """An item in a third of all documents is light; the few rare words of its edited copies must not hide them."""
    rng = random.Random(7)
    items = {1: [f"w{i}" for i in range(40)], 2: [f"u{i}" for i in range(12)], 3: [f"w{i}" for i in range(20, 50)]}
    docs = {}
    for d in range(300):
        words = [f"x{d}_{i}" for i in range(rng.randint(0, 20))]
        for i, item in items.items():
            if i == 1 and d % 3 == 0:
                words += item
            elif d % 11 == i:
                copy = list(item)
                for _ in range(rng.randint(1, 3)):
                    copy[rng.choice([0, 1, len(item) // 2, len(item) - 1])] = f"edit{rng.random()}"
                words += copy
        docs[d] = words + [f"y{d}_{i}" for i in range(rng.randint(0, 20))]
    df: Counter = Counter(s for words in docs.values() for s in set(shingles(words, 5)))
    weight = {s: 1 + (len(docs) // n).bit_length() - 1 for s, n in df.items()}
    rarest = 1 + len(docs).bit_length() - 1
    want = {}
    for (d, words), (i, item) in itertools.product(docs.items(), items.items()):
        bag = Counter(shingles(item, 5))
        whole = sum(n * weight.get(s, rarest) for s, n in bag.items())
        for start in range(len(words)):
            common = sum(n * weight[s] for s, n in (Counter(shingles(words[start : start + len(item)], 5)) & bag).items())
            if common >= 0.8 * whole:
                want[d, i] = max(want.get((d, i), 0), round(common / whole, 6))
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.similarity for r in decontam.report(rows, bench).collect()} == want
    assert len(want) > 110 and sum(x < 1 for x in want.values()) > 10


def test_simhash(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def fingerprint(text: str | None) -> int:
        hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles(WORD.findall((text or "").translate(lower)), 3)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {int(d): fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    least = {d: d for d in prints}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_simhash_dedup"](spark, DIR).collect()}
    assert found == {d: (f"{p:016x}", least[d]) for d, p in prints.items()}
