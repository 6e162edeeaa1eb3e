import hashlib
import random
import time

import numpy as np
import pytest

from levelstream.llm import substring_dedup as D


def brute(texts):
    count = {}
    for t in texts:
        for i in range(len(t) - D.LENGTH + 1):
            count[t[i : i + D.LENGTH]] = count.get(t[i : i + D.LENGTH], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - D.LENGTH + 1):
            if count[t[i : i + D.LENGTH]] > 1:
                gone[i : i + D.LENGTH] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    got = D.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_bytes string"), ("doc_id", "text", "n_bytes")).collect()
    assert all(r.kept_text == (r.text or "") for r in got if not r.n_removed)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert got == sorted((d, *b) for (d, _, _), b in zip(rows, brute([(t or "").encode() for _, t, _ in rows]), strict=True))


def hard(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "bé", "gamma", "dd", "ünd", "日本", "x"]) + rng.choice("abcdefgh") * rng.randrange(4)
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(60), text(45), "ab" * 300, "z" * 450]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "x" * 200), (4, "x" * 201), (5, "q" * 500)]
    for i in range(6, n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.randrange(4)
            if kind == 0:
                s = rng.choice(shared)
                a = rng.randrange(max(1, len(s) - 150))
                parts.append(s[a : a + rng.randrange(150, 400)])
            elif kind == 1 and len(rows) > 8:
                old = rng.choice(rows)[1] or ""
                cut = rng.randrange(len(old) + 1)
                parts.append(old[:cut] + rng.choice(["", "!", "edit"]) + old[cut:])
            else:
                parts.append(text(rng.randrange(2, 60)))
        rows.append((i, " ".join(parts)[:6000]))
    return [(d, t, "x") for d, t in rows]


@pytest.mark.parametrize(("seed", "group"), [(1, 512), (2, 512), (3, 3), (4, 1), (5, 2)])
def test_against_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(D, "GROUP", group)
    check(spark, hard(seed, 70))


def test_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    check(spark, [(1, text, ""), (1, text, ""), (2, text[:150] + "!" + text[150:], ""), (2, "other", "")])
    assert D.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nulls = spark.createDataFrame([(None, text), (None, text[:150] + "!" + text[150:]), (None, None), (0, text[1:])], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in D.remove_repeats(nulls, ("doc_id",)).collect())
    texts = [b"", text[1:].encode(), text.encode(), (text[:150] + "!" + text[150:]).encode()]
    assert got == [b[:2] for b in brute(texts)]


def test_thousands_of_equal_rows(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(900))
    rows = spark.createDataFrame([(1, text)] * 2500 + [(i, text) for i in range(2, 1500)] + [(0, "x " + text[:5000])], "doc_id long, text string")
    began = time.monotonic()
    got = D.remove_repeats(rows, ("doc_id",)).groupBy("doc_id", "n_removed").count().collect()
    assert time.monotonic() - began < 60
    assert sorted(map(tuple, got)) == sorted([(0, 5000, 1), (1, len(text), 2500), *((i, len(text), 1) for i in range(2, 1500))])


@pytest.mark.parametrize("kinds", [("one place",), ("one place", "hashes")])
def test_a_crowded_gram(spark, monkeypatch, kinds):
    """A passage in many texts: cut into parts, and sorted by bytes where hashes say too much."""
    monkeypatch.setattr(D, "GROUP", 4)
    if "hashes" in kinds:
        monkeypatch.setattr(D.Suffixes, "common", lambda s, x, y: np.minimum(s.length[x], s.length[y]) // 2)
    rng = random.Random(10)
    some = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    passage = some(260)
    rows = [(i, some(rng.randrange(150)) + passage[rng.randrange(60) :] + some(rng.randrange(150)), "") for i in range(60)]
    check(spark, rows)


def test_characters_cut_in_two_stay():
    data = "aé日z".encode()
    assert [D.without(data, [(low, high)]).decode() for low, high in ((0, 2), (1, 2), (2, 6), (1, 3), (0, 7), (4, 5))] == ["é日z", "aé日z", "aéz", "a日z", "", "aé日z"]


def test_anchors_over_slices(monkeypatch):
    data = bytes(random.Random(6).randrange(97, 103) for _ in range(9000))
    whole = [np.concatenate(x) for x in zip(*D.anchors(data), strict=True)]
    monkeypatch.setattr(D, "_SLICE", 1000)
    cut = [np.concatenate(x) for x in zip(*D.anchors(data), strict=True)]
    place = lambda a: sorted((s + k, s + m) for s, m, n in zip(a[0], a[1], a[2], strict=True) for k in range(n))
    assert place(whole) == place(cut) and [p[0] for p in place(whole)] == list(range(len(data) - D.LENGTH + 1))


def test_suffix_sort():
    rng = random.Random(7)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(4000)), np.uint8)
    group = np.sort(np.array([rng.randrange(7) for _ in range(500)]))
    start = np.array([rng.randrange(3900) for _ in group])
    end = np.minimum(start + np.array([rng.randrange(1, 100) for _ in group]), len(data))
    s = D.Suffixes(data, start, end)
    order = s.sort(group)
    text = data.tobytes()
    assert [(group[i], text[start[i] : end[i]]) for i in order] == sorted((g, text[a:b]) for g, a, b in zip(group, start, end, strict=True))
