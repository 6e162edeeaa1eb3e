import math
import re
from collections import Counter

import numpy as np
import pytest

from levelstream.llm import ranked_search as R

ITEMS = [(1, "alpha beta gamma the of"), (1, "zebra"), (2, "The THE the déjà 日本語"), (3, None), (4, "nowhere-to-be-found"), (None, "x 42 it's"), (5, "alpha beta gamma the of"), (5, "alpha beta gamma the of")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    held = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:10])]
    return sorted(out, key=str)


@pytest.mark.parametrize("terms", [3, 1 << 16])
def test_against_brute_force(spark, docs, rows, monkeypatch, terms):
    monkeypatch.setattr(R, "BLOCK_TERMS", terms)
    items = spark.createDataFrame([(*i, "clash", 1) for i in ITEMS], "item_id long, text string, terms string, n int")
    got = R.rank(docs.withColumnRenamed("size", "score"), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:2] for r in rows], ITEMS)


def test_ties_repeats_long_texts_and_null_ids(spark):
    # an odd number of words, so that a cut of long texts falls anywhere
    long = "needle " + "hay straw " * 400_000 + "needle"
    docs = [(i % 20, "needle in a stack") for i in range(60)] + [(None, "needle in a stack"), (99, long), (100, "needle " * 300), (101, ""), (102, None), (103, "\x00\x7f")]
    items = [(0, "needle"), (1, "hay needle"), (2, "stack in stack")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = R.rank(table, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_bounds_are_never_under_scores():
    rng = np.random.default_rng(2)
    hashes, tf = rng.integers(0, 2**32, 500, dtype=np.uint32), np.minimum(rng.geometric(0.4, 500) ** 3, 5000)
    own = R.sketch(hashes, tf)
    assert len(own) == 1024
    at, m = hashes & np.uint32(1023), np.array([130])
    most = np.where(own == R.ANY, R.SCALE // R.TF_FACTOR, R.impact(own.astype(np.int64), m))
    assert (most[at] >= R.impact(tf, m)).all() and len(R.sketch(hashes[:0], tf[:0])) == R.LEAST


def test_empty(spark, no_docs, docs):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert R.rank(no_docs, items).count() == 0 and R.rank(docs, items.limit(0)).count() == 0
    assert R.rank(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).count() == 0
