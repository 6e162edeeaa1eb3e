"""Searches whose population is a table: mutations of the best one, and rumours between neighbours.

Chance is a hash of seed, round, candidate and purpose, so a run gives the same on any partitioning and after any
lost task. A round scores all candidates in one job; the driver sees one row of the best, and of the rumours a bank
of at most BANK rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fitting
from .segment_fits import cut

Bounds = dict[str, tuple[float, float]]

# The share of parameters that a mutation draws anew; rumours that are taken from the bank, its size and
# decay; the weights of the kinds of listeners, of ten; the share of noise in a rumour; rounds to live; listeners.
MUTATED = 0.7
FROM_BANK, BANK, DECAY = 0.6, 32, 0.05
LISTENERS = ((0.1, 0.3),) * 2 + ((0.4, 0.6),) * 3 + ((0.8, 0.9),) * 3 + ((1.1, 1.4),) * 2
NOISE = 0.15
LEAST_LIFE, MOST_LIFE = 2, 100
LISTENING = 0.9
#: Parameters of a rumour are the bits of a long.
MOST_PARAMETERS = 60


def draw(seed: int, turn: int, purpose: int, candidate: Column, k: int = 0) -> Column:
    """An even number in [0, 1)."""
    long = lambda x: F.lit(x).cast("long")
    return F.pmod(F.xxhash64(long(seed), long(turn), long(purpose), long(k), candidate), long(1 << 52)) / float(1 << 52)


def _anywhere(seed: int, turn: int, bounds: Bounds) -> dict[str, Column]:
    return {n: F.lit(float(low)) + F.lit(float(high - low)) * draw(seed, turn, 0, F.col("candidate"), k) for k, (n, (low, high)) in enumerate(bounds.items())}


def _people(inputs: DataFrame, size: int) -> DataFrame:
    return inputs.sparkSession.range(size).withColumnRenamed("id", "candidate")


def mutate(inputs: DataFrame, bounds: Bounds, model: Column, size: int = 24, rounds: int = 12, seed: int = 1, share: float = MUTATED) -> tuple[dict[str, float], float]:
    """The best candidate stays; each round all others are copies of it in which a parameter is drawn anew with chance ``share``.

    Inputs and model are as in ``fitting.scores``. An input without rows, or a model without a number, gives no
    parameters and an infinite fitness.
    """
    found, fitness = {}, float("inf")
    for turn in range(rounds + 1):
        at = _anywhere(seed, turn, bounds)
        if found:
            changed = {n: draw(seed, turn, 1, F.col("candidate"), k) < share for k, n in enumerate(bounds)}
            at = {n: F.when((F.col("candidate") > 0) & changed[n], x).otherwise(F.lit(found[n])) for n, x in at.items()}
        people = _people(inputs, size).select("candidate", *[x.alias(n) for n, x in at.items()])
        row = fitting.best(fitting.scores(inputs, people, model, []), []).first()
        if row is not None and row.fitness is not None and row.fitness < fitness:
            found, fitness = {n: row[n] for n in bounds}, row.fitness
    return found, fitness


def _weight(seed: int, turn: int) -> Column:
    """How much a candidate believes, by its kind."""
    kind = F.floor(draw(seed, turn, 2, F.col("candidate")) * len(LISTENERS)).cast("int")
    ends = F.get(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in LISTENERS]), kind)
    return ends[0] + (ends[1] - ends[0]) * draw(seed, turn, 3, F.col("candidate"))


def _life(seed: int, turn: int) -> Column:
    return (LEAST_LIFE + F.floor(draw(seed, turn, 4, F.col("candidate")) * (MOST_LIFE - LEAST_LIFE + 1))).cast("long")


def _rumour(state: DataFrame, bounds: Bounds, bank: list[int], size: int, seed: int, turn: int) -> DataFrame:
    """``state`` with what each candidate tries next, the parameters it hears of (``mask``) and whether it is born anew."""
    me = F.col("candidate")
    # a population has fewer candidates than a round may score, so one window orders it
    placed = state.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed).cast("long"), F.lit(turn).cast("long"), me), me)) - 1)
    others = F.lit(size) - F.col("place") - 1
    placed = placed.withColumn("teller", F.when((F.col("place") < int(LISTENING * size)) & (others > 0), F.col("place") + 1 + F.floor(draw(seed, turn, 5, me) * others)))
    told = placed.select(F.col("place").alias("told_by"), *[F.col(n).alias(f"{n}_told") for n in bounds], *[F.col(f"{n}_best").alias(f"{n}_known") for n in bounds])
    heard = placed.join(told, placed["teller"] == told["told_by"], "left")
    noise = F.floor(draw(seed, turn, 6, me) * float(1 << len(bounds))).cast("long")
    rank = F.least(F.floor(-F.log(1 - draw(seed, turn, 7, me)) / 4 * BANK).cast("int"), F.lit(len(bank) - 1))
    mask = F.when(draw(seed, turn, 8, me) < FROM_BANK, F.get(F.array(*[F.lit(b).cast("long") for b in bank]), rank)).otherwise(noise) if bank else noise
    source = F.floor(draw(seed, turn, 9, me) * 3)
    anew, w = F.col("life") <= 0, F.col("weight")
    tries = []
    for k, (n, (low, high)) in enumerate(bounds.items()):
        bit = F.shiftright("mask", k).bitwiseAND(F.lit(1).cast("long")) == 1
        strange = F.lit(float(low)) + F.lit(float(high - low)) * draw(seed, turn, 10, me, k)
        known = F.col(f"{n}_known")
        said = F.when(source == 0, F.col(f"{n}_told")).when(source == 1, known).otherwise(known * (1 - NOISE) + F.when(bit, strange * NOISE).otherwise(known * NOISE))
        taken = F.when(bit, said * w + F.col(n) * (1 - w)).otherwise(said)
        rumoured = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(taken, F.col(n))))
        tries.append(F.when(anew, _anywhere(seed, turn, bounds)[n]).otherwise(rumoured).alias(f"{n}_next"))
    return heard.withColumn("mask", F.when(F.col("teller").isNotNull(), mask)).select(*state.columns, "mask", anew.alias("anew"), *tries)


def _banked(bank: dict[int, float], gains: list[tuple[int, float]]) -> dict[int, float]:
    """The bank after a round: gains fade, those that grow are averaged, and new masks push out the weakest."""
    after = {m: g * (1 - DECAY) for m, g in bank.items()}
    for mask, gain in gains:
        if mask in after:
            after[mask] = gain if after[mask] < 0 < gain else (after[mask] + gain) / 2 if gain > after[mask] else after[mask]
        elif len(after) < BANK:
            after[mask] = gain
        else:
            weakest = min(after, key=lambda m: (after[m], -m))
            if after[weakest] < gain:
                del after[weakest]
                after[mask] = gain
    return after


def rumours(inputs: DataFrame, bounds: Bounds, model: Column, size: int = 24, rounds: int = 12, seed: int = 1) -> tuple[dict[str, float], float]:
    """Candidates hear of the parameters of another one, believe it more or less, and keep what makes them better.

    Each round puts the candidates into a new order; most of them listen to one that comes later: to its place, its
    best place, or that with noise. Of the parameters that the rumour is about they take a weighted mean, of all
    others the teller's. Which parameters a rumour is about comes from a bank of those that have helped, or by chance.
    All but the best are born anew when their rounds are over. Inputs, model and empty cases are as in ``mutate``.
    """
    if len(bounds) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")

    def scored(people: DataFrame, names: list[str]) -> DataFrame:
        asked = people.select("candidate", *[F.col(m).alias(n) for m, n in zip(names, bounds, strict=True)])
        known = fitting.scores(inputs, asked, model, []).select("candidate", F.nanvl("fitness", F.lit(float("inf"))).alias("got"))
        return people.join(known, "candidate", "left").withColumn("got", F.coalesce("got", F.lit(float("inf"))))

    first = cut(_people(inputs, size).select("candidate", *[x.alias(n) for n, x in _anywhere(seed, 0, bounds).items()]))
    own = scored(first, list(bounds))
    state = cut(own.select("candidate", *bounds, *[F.col(n).alias(f"{n}_best") for n in bounds], F.col("got").alias("fitness"), F.col("got").alias("best_fitness"), _weight(seed, 0).alias("weight"), _life(seed, 0).alias("life")))
    leader = lambda s: s.orderBy("best_fitness", "candidate").select("candidate", "best_fitness", *[f"{n}_best" for n in bounds]).first()
    bank: dict[int, float] = {}
    best = leader(state)
    found, fitness = ({n: best[f"{n}_best"] for n in bounds}, best.best_fitness) if best and best.best_fitness < float("inf") else ({}, float("inf"))
    for turn in range(1, rounds + 1) if best else ():
        order = sorted(bank, key=lambda m: (-bank[m], m))
        tried = cut(scored(cut(_rumour(state, bounds, order, size, seed, turn)), [f"{n}_next" for n in bounds]))
        won = F.col("anew") | (F.col("got") < F.col("fitness"))
        gain = F.col("fitness") - F.col("got")
        gains = tried.where((F.col("mask") > 0) & ~F.col("anew") & (F.abs(gain) < float("inf"))).groupBy("mask").agg(F.max(gain).alias("gain")).orderBy(F.col("gain").desc(), "mask").limit(BANK)
        bank = _banked(bank, [(r["mask"], r["gain"]) for r in gains.collect()])
        record = F.col("anew") | (won & (F.col("got") < F.col("best_fitness")))
        elder = F.when(F.col("candidate") == best.candidate, F.greatest(F.col("life"), F.lit(1))).otherwise(F.col("life") - 1)
        state = tried.select(
            "candidate", *[F.when(won, F.col(f"{n}_next")).otherwise(F.col(n)).alias(n) for n in bounds], *[F.when(record, F.col(f"{n}_next")).otherwise(F.col(f"{n}_best")).alias(f"{n}_best") for n in bounds],
            F.when(won, F.col("got")).otherwise(F.col("fitness")).alias("fitness"), F.when(record, F.col("got")).otherwise(F.col("best_fitness")).alias("best_fitness"),
            F.when(F.col("anew"), _weight(seed, turn)).otherwise(F.col("weight")).alias("weight"), F.when(F.col("anew"), _life(seed, turn)).otherwise(elder).alias("life"),
        )
        best = leader(state)
        if best.best_fitness < fitness:
            found, fitness = {n: best[f"{n}_best"] for n in bounds}, best.best_fitness
    return found, fitness
