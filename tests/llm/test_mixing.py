import heapq
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelstream.llm import mixing as M
from levelstream.llm.shared import numbered


def brute_targets(rows):
    size = defaultdict(int)
    for _, t, _, source, *_ in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            target[s] = 2 * size[s]
        left -= sum(2 * size[s] for s in over)
        open_ -= set(over)
    return size, target


def test_targets_and_amounts(docs, rows):
    got = M.mix(docs).collect()
    size, target = brute_targets(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.passes * r.size + sum(x.length for x in r.ranges)
        assert all(0 <= x.start and x.start + x.length <= r.size for x in r.ranges)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * M.BLOCK for s in target)
    again = M.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def runs(chosen):
    return sum(b and not a for a, b in zip([False, *chosen], chosen, strict=False))


def test_the_order_of_blocks_is_a_permutation_without_runs(spark):
    sizes = [1, 2, 3, 93, 341, 511, 512, 2000]
    rows = spark.createDataFrame([(n, c) for n in sizes for c in range(4)], "n long, c int")
    keys = F.transform(F.sequence(F.lit(1), F.lit(M.ROUNDS)), lambda r: F.pmod(F.xxhash64("c", r), F.col("n")))
    rows = rows.withColumn("keys", keys).select("n", "c", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: M.shuffled(b, F.col("n"), F.col("keys"))).alias("to"))
    for r in rows.collect():
        assert sorted(r.to) == list(range(r.n))
        half = r.n // 2
        if r.n > 90:  # of n places half taken at random have n / 4 runs, with a deviation of about sqrt(n) / 4
            assert abs(runs([x < half for x in r.to]) - r.n / 4) < 1.25 * r.n**0.5, (r.n, r.c)
            first = sum(x < half for x in r.to[:half])
            assert abs(first - half / 2) < 1.25 * r.n**0.5, (r.n, r.c)


def test_words_are_cut_as_they_stand():
    text = "  déjà\n\nvu  日本語 x\ty z "
    assert M.cut_words(text, [(0, 2)]) == "déjà\n\nvu"
    assert M.cut_words(text, [(0, 1), (1, 1), (3, 2), (5, 1)]) == "déjà\n\nvu x\ty z"
    assert M.cut_words(text, [(2, 1), (4, 1)]) == "日本語 y"


def test_mixed_texts_are_the_words_taken(docs, rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    want = {r.doc_id: r for r in M.mix(docs).collect()}
    got = defaultdict(list)
    for r in M.mixed_texts(docs, ("doc_id", "lang", "source")).collect():
        assert r.lang == "en"
        got[r.doc_id].append(r.text)
    for d, text, _, source, *_ in rows:
        some = [w for x in want[d].ranges for w in words(text)[x.start : x.start + x.length]]
        expected = sorted([words(text)] * want[d].passes * bool(words(text)) + ([some] if some else []))
        assert sorted(map(words, got[d])) == expected


def test_repeated_rows_and_null_ids_are_mixed(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = spark.createDataFrame([(None, text, "s", 1)] * 30 + [(7, text + " x", "s", 1)] * 30 + [(7, "other " + text, "s", 1)] * 3, "doc_id long, text string, source string, row_hash int")
    taken = M.mix(rows).agg(F.sum("taken")).first()[0]
    got = M.mixed_texts(rows)
    assert got.select(F.sum(F.size(F.split("text", " ")))).first()[0] == taken > 0
    assert got.where("doc_id is null").count() > 0


def by_heap(weights, caps, seats):
    """The plain way: the highest of the next quotients wins, of equals the first cell."""
    got = [0] * len(weights)
    heap = [(-w, i) for i, (w, cap) in enumerate(zip(weights, caps, strict=True)) if w > 0 and cap > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-(weights[i] / (2 * got[i] + 1)), i))
    return got


def test_apportionment_is_sainte_lague():
    rng, sets = random.Random(4), []
    for _ in range(2000):
        n = rng.choice([1, 2, 3, 7, 30])
        kind = rng.randrange(4)
        weights = [rng.choice([0.0, 1.0, 5.0]) if kind == 0 else float(rng.randrange(1, 60)) if kind == 1 else rng.random() ** 8 * 1000 if kind == 2 else rng.choice([1e-9, 1.0, 1e9]) for _ in range(n)]
        sets.append((weights, [rng.choice([1, 2, 5, 1000]) for _ in range(n)], rng.choice([0, 1, 3, 17, 200])))
    sets += [([1000.0] + [0.625] * 2000, [10**6] * 2001, 2250), ([5.0, 1.0], [5, 100], 50)]
    start = np.cumsum([0, *[len(w) for w, _, _ in sets]])[:-1]
    got = M.sainte_lague(start, np.concatenate([w for w, _, _ in sets]), np.concatenate([c for _, c, _ in sets]), np.array([n for *_, n in sets]))
    for a, (weights, caps, seats) in zip(start, sets, strict=True):
        assert got[a : a + len(weights)].tolist() == by_heap(weights, caps, seats)
    assert got[start[-2]] == 800 and got[start[-1] :].sum() == 50


@pytest.mark.parametrize("seats", [0, 1, 2250, 10**9])
def test_sources_are_apportioned_by_counts(spark, seats):
    weights = [1000.0] + [0.625] * 900 + [0.0, 3.5]
    caps = [10**6] + [2] * 902
    table = spark.createDataFrame([(i + 1, w, c) for i, (w, c) in enumerate(zip(weights, caps, strict=True))], "cell long, w double, cap long").repartition(3)
    got = {r.cell: r.quota for r in M.apportion_sources(table, "w", "cap", seats).collect()}
    want = by_heap(weights, caps, min(seats, 10**4)) if seats < 10**9 else [c if w else 0 for w, c in zip(weights, caps, strict=True)]
    assert {c: q for c, q in got.items() if q} == {i + 1: q for i, q in enumerate(want) if q}


def test_many_small_sources(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 41)), f"s{i}") for i in range(2000)] + [(9000 + i, "big " * 320, "t") for i in range(100)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    near = [abs(r.taken - r.target) <= max(1, r.source_size / M.FINE) for r in got]
    assert sum(near) >= 0.99 * len(got) and all(abs(r.taken - r.target) <= M.BLOCK for r in got if r.source != "t")
    assert abs(sum(r.taken for r in got) / sum(r.target for r in got) - 1) < 0.01
    assert all(r.taken == 2 * r.source_size for r in got if r.target == 2 * r.source_size)


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(0, 1000, 1, 7).select(F.xxhash64("id").alias("v"))
    got = numbered(rows, [F.col("v").desc()], "place").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.place)] == sorted((r.v for r in got), reverse=True) and {r.place for r in got} == set(range(1, 1001))


def test_edges(spark, no_docs):
    assert M.mix(no_docs).count() == 0
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (2, "a b", "s"), (2, "a b", "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.taken) for r in M.mix(rows).collect())[:2] == [(1, 0, 0), (1, 0, 0)]
