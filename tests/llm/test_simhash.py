import random
import re

import numpy as np
import pytest
import xxhash

from levelstream.llm import simhash as S
from levelstream.llm.shared import components


def brute_print(text):
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_brute_force(docs, rows):
    got = {r.doc_id: (r.print & (2**64 - 1), r.component_id) for r in S.near_duplicates(docs).collect()}
    prints = {d: brute_print(t) for d, t, *_ in rows}
    ids = sorted(prints)
    want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert got == {d: (prints[d], want[d]) for d in ids}


@pytest.mark.parametrize("blocks", [6, 7])
def test_links_in_a_dense_ball(spark, monkeypatch, blocks):
    rng = random.Random(3)
    monkeypatch.setattr(S, "TILE", 16)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for i in range(400):
        x = base[i % 6]
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    table = spark.createDataFrame([(x,) for x in signed], "print long").select("print", *S.distance_table())
    for r in table.collect():
        told = b"".join(r[c].to_bytes(8, "little", signed=True) for c in S.TABLE)
        assert list(told) == [((r.print ^ x) & (2**64 - 1)).bit_count() for x in S.REFERENCES]
    got = components(S.print_links(table, blocks))
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = brute_components(signed, pairs)
    linked = {x for p in pairs for x in p}
    assert {r.id: r.component for r in got.collect()} == {x: want[x] for x in linked}


def test_any_close_pair_shares_a_key():
    rng = random.Random(4)
    for blocks in (6, 7):
        masks = S._masks(blocks)
        assert len(masks) == {6: 15, 7: 35}[blocks]
        for _ in range(2000):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flips & m & (2**64 - 1) for m in masks)


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 2000), (5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 2000: 1000}


def test_edges(spark, no_docs):
    assert S.near_duplicates(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in S.near_duplicates(twice).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_long_text_slices(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr(S, "_SLICE", 100)
    assert S.fingerprint(text.encode()) == whole == brute_print(text)
    assert np.uint64(whole).dtype == np.uint64
