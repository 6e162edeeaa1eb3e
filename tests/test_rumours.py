import math
import struct

import pytest
from pyspark.sql import functions as F

from levelstream.operators import rumours as R

xxhash = pytest.importorskip("xxhash")
BOUNDS = {"gain": (0.0, 3.0), "bias": (-10.0, 10.0)}
ROWS = [(i / 10, i / 10 * 1.5 - 4) for i in range(120)]


def model():
    return F.col("gain") * F.col("x") + F.col("bias")


def hashed(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h).intdigest()
    return h


def drawn(seed, turn, purpose, candidate, k=0):
    return (hashed(seed, turn, purpose, k, candidate) % (1 << 52)) / (1 << 52)


def anywhere(seed, turn, c):
    return [low + (high - low) * drawn(seed, turn, 0, c, k) for k, (low, high) in enumerate(BOUNDS.values())]


def fitness(p):
    return math.sqrt(sum((y - p[0] * x - p[1]) ** 2 for x, y in ROWS) / len(ROWS))


@pytest.fixture(scope="module")
def inputs(spark):
    return spark.createDataFrame(ROWS, "x double, expected double").repartition(3).cache()


def test_mutation_is_the_plain_one(inputs):
    best, value, held = None, math.inf, None
    for turn in range(6):
        for c in range(12):
            p = anywhere(3, turn, c)
            if held:
                p = [p[k] if c and drawn(3, turn, 1, c, k) < R.MUTATED else held[k] for k in range(2)]
            if fitness(p) < value:
                best, value = p, fitness(p)
        held = best
    got, score = R.mutate(inputs, BOUNDS, model(), size=12, rounds=5, seed=3)
    assert math.isclose(score, value, rel_tol=1e-9) and all(math.isclose(got[n], v, rel_tol=1e-9) for n, v in zip(BOUNDS, best, strict=True))


def plain_rumours(size, rounds, seed):
    def weight(turn, c):
        a, b = R.LISTENERS[int(drawn(seed, turn, 2, c) * len(R.LISTENERS))]
        return a + (b - a) * drawn(seed, turn, 3, c)

    life = lambda turn, c: R.LEAST_LIFE + int(drawn(seed, turn, 4, c) * (R.MOST_LIFE - R.LEAST_LIFE + 1))
    people = []
    for c in range(size):
        p = anywhere(seed, 0, c)
        people.append({"at": p, "best": p, "f": fitness(p), "bf": fitness(p), "w": weight(0, c), "life": life(0, c)})
    bank = {}
    lead = min(range(size), key=lambda c: (people[c]["bf"], c))
    for turn in range(1, rounds + 1):
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        order = sorted(range(size), key=lambda c: (signed(hashed(seed, turn, c)), c))
        banked, after, gains = sorted(bank, key=lambda m: (-bank[m], m)), [None] * size, {}
        for place, c in enumerate(order):
            me, others = people[c], size - place - 1
            anew, mask, tried = me["life"] <= 0, None, list(me["at"])
            if place < int(R.LISTENING * size) and others > 0:
                teller = people[order[place + 1 + int(drawn(seed, turn, 5, c) * others)]]
                mask = int(drawn(seed, turn, 6, c) * 4)
                if banked and drawn(seed, turn, 8, c) < R.FROM_BANK:
                    mask = banked[min(int(-math.log(1 - drawn(seed, turn, 7, c)) / 4 * R.BANK), len(banked) - 1)]
                source = int(drawn(seed, turn, 9, c) * 3)
                for k, (low, high) in enumerate(BOUNDS.values()):
                    bit, known = mask >> k & 1, teller["best"][k]
                    strange = low + (high - low) * drawn(seed, turn, 10, c, k)
                    said = [teller["at"][k], known, known * (1 - R.NOISE) + (strange if bit else known) * R.NOISE][source]
                    tried[k] = min(high, max(low, said * me["w"] + me["at"][k] * (1 - me["w"]) if bit else said))
            tried = anywhere(seed, turn, c) if anew else tried
            f = fitness(tried)
            if mask and not anew:
                gains[mask] = max(gains.get(mask, -math.inf), me["f"] - f)
            won = anew or f < me["f"]
            record = anew or (won and f < me["bf"])
            after[c] = {
                "at": tried if won else me["at"], "f": f if won else me["f"], "best": tried if record else me["best"], "bf": f if record else me["bf"],
                "w": weight(turn, c) if anew else me["w"], "life": life(turn, c) if anew else max(me["life"], 1) if c == lead else me["life"] - 1,
            }
        bank = R._banked(bank, sorted(gains.items(), key=lambda g: (-g[1], g[0]))[: R.BANK])
        people = after
        lead = min(range(size), key=lambda c: (people[c]["bf"], c))
    return people[lead]["best"], people[lead]["bf"]


def test_rumours_are_the_plain_ones(inputs, monkeypatch):
    monkeypatch.setattr(R, "MOST_LIFE", 4)  # so that some are born anew
    best, value = plain_rumours(10, 5, 7)
    got, score = R.rumours(inputs, BOUNDS, model(), size=10, rounds=5, seed=7)
    assert math.isclose(score, value, rel_tol=1e-6), (score, value)
    assert all(math.isclose(got[n], v, rel_tol=1e-6) for n, v in zip(BOUNDS, best, strict=True))


def test_rumours_find_the_line_and_take_empty_inputs(inputs):
    _, score = R.rumours(inputs, BOUNDS, model(), size=40, rounds=8, seed=2)
    start = min(fitness(anywhere(2, 0, c)) for c in range(40))
    assert score < start
    for search in (R.mutate, R.rumours):
        assert search(inputs.limit(0), BOUNDS, model(), size=6, rounds=2) == ({}, math.inf)
    with pytest.raises(ValueError):
        R.rumours(inputs, {f"p{k}": (0.0, 1.0) for k in range(61)}, model())


def test_the_bank_keeps_what_helps():
    bank = R._banked({}, [(k, float(k)) for k in range(1, R.BANK + 1)])
    assert len(bank) == R.BANK
    after = R._banked(bank, [(999, 100.0), (5, 50.0), (6, -1.0)])
    assert after[999] == 100.0 and 1 not in after and math.isclose(after[5], (5 * 0.95 + 50) / 2) and math.isclose(after[6], 6 * 0.95)
