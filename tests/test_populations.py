import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelstream.operators import fitting, populations as P

BOUNDS = {"a": (-1.0, 3.0), "b": (10.0, 10.5), "c": (0.0, 1.0)}


def inverse(n, base):
    out, unit = 0.0, 1.0
    while n:
        unit /= base
        out += n % base * unit
        n //= base
    return out


def test_the_sequence_is_the_closed_form(spark):
    assert P.primes(6) == [2, 3, 5, 7, 11, 13]
    for base in (2, 3, 7):
        rows = spark.range(0, 2000, 1, 7).select("id", P.radical_inverse(F.col("id"), base).alias("x")).collect()
        assert all(math.isclose(r.x, inverse(r.id, base), abs_tol=1e-12) for r in rows)
    big = spark.createDataFrame([(2**61,), (-1,), (None,)], "n long").select(P.radical_inverse(F.col("n"), 2)).collect()
    assert big[0][0] == 2.0**-62 and big[1][0] is None and big[2][0] is None


def test_populations_do_not_depend_on_partitions(spark):
    for name, start in P.STARTS.items():
        one = sorted(map(tuple, start(spark, BOUNDS, 50).collect()))
        assert one == sorted(map(tuple, start(spark, BOUNDS, 50).repartition(9).collect())), name
        assert all(-1 <= r[1] <= 3 and 10 <= r[2] <= 10.5 and 0 <= r[3] <= 1 for r in one)
    line = sorted(map(tuple, P.diagonal(spark, BOUNDS, 5).collect()))
    assert [r[1:] for r in line] == [(-1 + k, 10 + k / 8, k / 4) for k in range(5)]
    cross = sorted(map(tuple, P.diagonal(spark, BOUNDS, 5, True).collect()))
    assert cross[1][1:] == (0.0, 10.375, 0.25) and cross[2] == line[2]


@pytest.mark.parametrize("start", ["halton", "diagonal", "cross"])
def test_searches_begin_evenly_and_find_the_line(spark, start):
    inputs = spark.range(200).select((F.col("id") / 10).alias("x"), (F.col("id") / 10 * 1.5 - 4).alias("expected"))
    model = F.col("gain") * F.col("x") + F.col("bias")
    for search in (fitting.evolve, fitting.swarm):
        found, fitness = search(inputs, {"gain": (0.0, 3.0), "bias": (-10.0, 10.0)}, model, size=20, rounds=14, start=start)
        assert fitness < 1.5 and (found, fitness) == search(inputs, {"gain": (0.0, 3.0), "bias": (-10.0, 10.0)}, model, size=20, rounds=14, start=start)


def test_donors_are_others_and_different():
    rng = np.random.default_rng(1)
    for size in (6, 24):
        for _ in range(20):
            donors = fitting._donors(rng, size, 5)
            assert donors.shape == (5, size) and all(len({k, *donors[:, k].tolist()}) == 6 for k in range(size))
    assert fitting._donors(rng, 3, 5).shape == (5, 3)
