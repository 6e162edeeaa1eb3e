import hashlib
import random

from levelstream.llm import chunk_prints as P


def test_against_brute_force(docs, rows):
    got = {r.doc_id: r for r in P.document_prints(docs).collect()}
    order = sorted(rows, key=lambda r: r[0])
    assert len(got) == len(rows)
    for i, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r, own = got[d], P.fingerprint(t)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (P.as_text(own), P.as_text(P.fingerprint(edited)))
        assert (r.near_edited, r.near_next) == (P.likeness(own, P.fingerprint(edited)), P.likeness(own, P.fingerprint(after)))


def test_gear_hash_is_the_rolling_one():
    data = bytes(random.Random(2).randrange(256) for _ in range(3000))
    strict, loose, h = [], [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(P._GEAR[b])) & 0xFFFFFFFF
        if h & int(P.LOOSE) == 0:
            loose.append(i + 1)
            if h & int(P.STRICT) == 0:
                strict.append(i + 1)
    import numpy as np

    assert P._marks(np.frombuffer(data, np.uint8)) == (strict, loose)


def test_chunks_cover_and_resist_a_shift():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    data = text.encode()
    cut = P.chunks(data)
    assert cut[0][0] == 0 and cut[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False))
    assert all(P.LEAST <= b - a <= P.MOST for a, b in cut[:-1])
    one = P.fingerprint(text)
    assert P.likeness(one, P.fingerprint("inserted " + text)) > 0.95
    assert P.likeness(one, P.fingerprint("".join(rng.choices("abcdefgh ", k=9000)))) < 0.05
    assert P.likeness({}, {}) == 1.0 and P.likeness({}, one) == 0.0


def test_edges(spark, no_docs):
    assert P.document_prints(no_docs).count() == 0
    rows = spark.createDataFrame([(5, "abcd"), (5, "abcd"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_chars, r.edited_sha256) for r in P.document_prints(rows).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(0, 0, sha("")), (5, 4, sha("abab")), (5, 4, sha("ab"))])
