"""Fitting model parameters: every candidate is scored on every segment in one job, and the least wins.

The rows that do not depend on the parameters (interpolated inputs, references) are written once; candidates are a
small table joined to them, so a round costs one aggregation whatever the number of candidates. What comes to the
driver between rounds is one row of bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import populations


def grid(spark: SparkSession, bounds: dict[str, tuple[float, float]], steps: int) -> DataFrame:
    """All combinations of ``steps`` values of each parameter; their number is the caller's, and bounds the broadcast."""
    values = [[low + (high - low) * i / max(1, steps - 1) for i in range(steps)] for low, high in bounds.values()]
    rows = [(k, *map(float, x)) for k, x in enumerate(product(*values))]
    return spark.createDataFrame(rows, "candidate long, " + ", ".join(f"{n} double" for n in bounds))


#: Candidates of a round at most: each row meets every one of them.
MOST_CANDIDATES = 100_000


def scores(inputs: DataFrame, candidates: DataFrame, model: Column, by: list[str]) -> DataFrame:
    """(by, candidate, parameters, n, fitness): the root mean square of expected - model over the inputs.

    ``model`` is a column over the inputs' columns and the parameters. Sums combine before the shuffle. The candidates
    go to every task; more than MOST_CANDIDATES are refused.
    """
    if candidates.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates; score them in parts")
    names = [c for c in candidates.columns if c != "candidate"]
    rows = inputs.join(F.broadcast(candidates)).withColumn("d", F.col("expected") - model).where("d is not null")
    return rows.groupBy(*by, "candidate", *names).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("fitness"))


def best(scored: DataFrame, by: list[str]) -> DataFrame:
    """The candidate of least fitness, the earlier of equals; groups by ``by``."""
    names = [c for c in scored.columns if c not in by]
    return scored.groupBy(*by).agg(F.min_by(F.struct(*names), F.struct("fitness", "candidate")).alias("b")).select(*by, "b.*")


#: Ways of comparing solutions of several objectives that dominance does not order, and whether dominance decides before.
STRATEGIES = {
    "strict": True, "soft": True, "any": True, "euclidean_dominance": True, "weighted_euclidean_dominance": True, "ratio_dominance": True, "weighted_ratio_dominance": True,
    "max": False, "euclidean": False, "weighted_euclidean": False,
}


def better(a: Column, b: Column, objectives: int, strategy: str) -> Column:
    """Whether the array of objectives ``a`` is better (less) than ``b``.

    Dominance comes first where the strategy has it: no objective better is no, none worse is yes; then strict says no, soft
    compares how many are better and worse, any says yes. The others compare a distance from zero, in which the
    first objectives may weigh more, and at equal distances the first objective in which they differ. A solution with a null or non-finite objective is never better, and any other is better than it.
    """
    dominance = STRATEGIES[strategy]
    pairs = [(F.get(a, F.lit(i)), F.get(b, F.lit(i)), float(objectives - i)) for i in range(objectives)]
    sound = lambda k: F.forall(F.array(*[p[k] for p in pairs]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = lambda parts: sum(parts[1:], parts[0])
    wins, losses = total([(x < y).cast("int") for x, y, _ in pairs]), total([(y < x).cast("int") for x, y, _ in pairs])
    if objectives == 1:
        decided = pairs[0][0] < pairs[0][1]
    else:
        weigh = lambda w: w if strategy.startswith("weighted") else 1.0
        if strategy == "max":
            own, other = F.greatest(*[x for x, _, _ in pairs]), F.greatest(*[y for _, y, _ in pairs])
        elif "ratio" in strategy:
            share = lambda x, y: F.when(x + y != 0, x / F.nullif(x + y, F.lit(0.0))).otherwise(0.5)
            own = total([F.when(x != y, F.pow(share(x, y), F.lit(2.0)) * weigh(w)).otherwise(0.0) for x, y, w in pairs])
            other = total([F.when(x != y, F.pow(1 - share(x, y), F.lit(2.0)) * weigh(w)).otherwise(0.0) for x, y, w in pairs])
        else:
            own, other = (total([F.when(p[0] != p[1], p[k] * p[k] * weigh(p[2])).otherwise(0.0) for p in pairs]) for k in (0, 1))
        first = F.lit(False)
        for x, y, _ in reversed(pairs):
            first = F.when(x != y, x < y).otherwise(first)
        decided = F.when(own < other, True).when(own > other, False).otherwise(first)
        if dominance:
            rest = {"strict": F.lit(False), "soft": wins > losses, "any": F.lit(True)}.get(strategy, decided)
            decided = F.when(wins == 0, False).when(losses == 0, True).otherwise(rest)
    return F.when(~sound(0), False).when(~sound(1), True).otherwise(decided)


def front(scored: DataFrame, by: list[str], objectives: list[str], strategy: str = "strict") -> DataFrame:
    """The candidates of each group to which no other is better: of a strict strategy the Pareto front.

    Each candidate meets all others of its group. Without groups every task holds them all, so more than
    MOST_CANDIDATES are refused, as in ``scores``.
    """
    if not by and scored.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates; compare them in groups")
    rows = scored.withColumn("goals", F.array(*[F.col(o).cast("double") for o in objectives]))
    a, b = rows.alias("a"), rows.select(*by, "candidate", "goals").alias("b")
    same = F.col("a.candidate") != F.col("b.candidate")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    beaten = better(F.col("b.goals"), F.col("a.goals"), len(objectives), strategy)
    return a.join(b, same & beaten, "left_anti").drop("goals")


def refine(inputs: DataFrame, bounds: dict[str, tuple[float, float]], model: Column, steps: int = 5, rounds: int = 4) -> tuple[dict[str, float], float]:
    """Parameters of least fitness over all inputs, by grids that shrink around the best of the round before."""
    spark, now = inputs.sparkSession, dict(bounds)
    found, fitness = {}, float("inf")
    for _ in range(rounds):
        row = best(scores(inputs, grid(spark, now, steps), model, []), []).first()
        if row is None or row.fitness is None:
            break
        if row.fitness < fitness:
            found, fitness = {n: row[n] for n in bounds}, row.fitness
        for n, (low, high) in now.items():
            half = (high - low) / (steps - 1)
            now[n] = (max(bounds[n][0], found[n] - half), min(bounds[n][1], found[n] + half))
    return found, fitness


def _fitness(inputs: DataFrame, names: list[str], model: Column) -> Callable:
    """A function of a population (an array, a row a candidate) that scores all of it in one job."""
    import numpy as np

    spark = inputs.sparkSession
    schema = "candidate long, " + ", ".join(f"{n} double" for n in names)

    def fitness(population):
        rows = [(i, *map(float, x)) for i, x in enumerate(population)]
        out = np.full(len(population), np.inf)
        for r in scores(inputs, spark.createDataFrame(rows, schema), model, []).select("candidate", "fitness").collect():  # one row a candidate
            out[r.candidate] = r.fitness
        return out

    return fitness


def _first(spark: SparkSession, bounds: dict[str, tuple[float, float]], size: int, start: str, rng):
    """The first population, a row a candidate: at random, or one of the even ones of ``populations``."""
    import numpy as np

    if start == "random":
        low, high = (np.array([bounds[n][k] for n in bounds]) for k in (0, 1))
        return low + rng.random((size, len(bounds))) * (high - low)
    rows = populations.STARTS[start](spark, bounds, size).orderBy("candidate").collect()  # one row a candidate
    return np.array([[r[n] for n in bounds] for r in rows])


def _donors(rng, size: int, count: int):
    """For each candidate so many others, all different: an array (count, size) of places. Small populations repeat."""
    import numpy as np

    order = rng.random((size, size))
    np.fill_diagonal(order, np.inf)
    others = np.argsort(order, axis=1)[:, : max(1, size - 1)]
    return np.resize(others.T, (count, size)) if others.shape[1] < count else others[:, :count].T


def evolve(inputs: DataFrame, bounds: dict[str, tuple[float, float]], model: Column, size: int = 24, rounds: int = 12, seed: int = 1, start: str = "random") -> tuple[dict[str, float], float]:
    """Differential evolution that adapts itself: each round scores all trials in one job, and a trial replaces its parent if it is better.

    A candidate has its own way of making trials (from the best, from a random one, from itself towards the best or towards a
    random one, with one or two differences), factor and share of crossed parameters. It keeps them while its trials
    win and draws others when they lose. The donors of a trial are others and all different. ``start`` names the first
    population: random, halton, diagonal or cross.
    """
    import numpy as np

    rng, names = np.random.default_rng(seed), list(bounds)
    low, high = (np.array([bounds[n][k] for n in names]) for k in (0, 1))
    fitness = _fitness(inputs, names, model)
    people = _first(inputs.sparkSession, bounds, size, start, rng)
    score = fitness(people)
    draw = lambda n: (rng.integers(0, 6, n), rng.uniform(0.4, 0.9, n), rng.uniform(0.5, 1.0, n))
    way, factor, crossed = draw(size)
    for _ in range(rounds):
        lead, f = people[np.argmin(score)], factor[:, None]
        a, b, c, d, e = (people[k] for k in _donors(rng, size, 5))
        made = [lead + f * (a - b), c + f * (a - b), people + f * (lead - people) + f * (a - b), people + f * (c - people) + f * (a - b), lead + f * (a - b) + f * (c - d), e + f * (a - b) + f * (c - d)]
        trial = np.choose(way[:, None], made)
        cross = rng.random(people.shape) < crossed[:, None]
        cross[np.arange(size), rng.integers(0, len(names), size)] = True
        trial = np.clip(np.where(cross, trial, people), low, high)
        got = fitness(trial)
        better = got < score
        people[better], score[better] = trial[better], got[better]
        way[~better], factor[~better], crossed[~better] = draw(int((~better).sum()))
    k = int(np.argmin(score))
    return dict(zip(names, people[k].tolist(), strict=True)), float(score[k])


# How much of its velocity a particle keeps, the pulls of its own best place and of the swarm's, and the
# most it moves in a round as a share of the bounds.
INERTIA, OWN_PULL, SWARM_PULL, MOST_MOVE = 0.7298, 1.55, 2.05, 0.4


def swarm(inputs: DataFrame, bounds: dict[str, tuple[float, float]], model: Column, size: int = 24, rounds: int = 12, seed: int = 1, start: str = "random") -> tuple[dict[str, float], float]:
    """A particle swarm: each round scores all particles in one job, and they move on towards the best places known.

    ``start`` is as in ``evolve``.
    """
    import numpy as np

    rng, names = np.random.default_rng(seed), list(bounds)
    low, high = (np.array([bounds[n][k] for n in names]) for k in (0, 1))
    fitness = _fitness(inputs, names, model)
    most = MOST_MOVE * (high - low)
    place = _first(inputs.sparkSession, bounds, size, start, rng)
    speed = rng.uniform(-most, most, place.shape)
    best, score = place.copy(), fitness(place)
    for _ in range(rounds):
        own, all_ = rng.random(place.shape), rng.random(place.shape)
        speed = INERTIA * speed + OWN_PULL * own * (best - place) + SWARM_PULL * all_ * (best[np.argmin(score)] - place)
        speed = np.clip(speed, -most, most)
        place = np.clip(place + speed, low, high)
        got = fitness(place)
        better = got < score
        best[better], score[better] = place[better], got[better]
    k = int(np.argmin(score))
    return dict(zip(names, best[k].tolist(), strict=True)), float(score[k])
