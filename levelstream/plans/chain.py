"""A chain of operators from configuration text: each section is an operator, applied in the order of the sections.

    [01 mask]
    signal = click
    bits = 1101 1110

Values are numbers, true or false, or text; $(NAME) is replaced by a given variable. An empty value is nothing.
"""

from __future__ import annotations

import configparser
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelstream.operators import routing, windows

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "map": routing.map_signal,
    "decouple": routing.decouple,
    "mask": routing.mask,
    "unmask": routing.unmask,
    "noise": routing.add_noise,
    "drop_repeats": routing.drop_repeats,
    "boluses_of_carbs": routing.boluses_of_carbs,
    "mean_response": windows.mean_response,
    "median_response": windows.median_response,
    "cut_segments": windows.cut_segments,
    "markers": windows.with_markers,
    "replay": windows.replay,
}


def _value(text: str):
    if text == "":
        return None
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return int(text) if re.fullmatch(r"[+-]?[1-9]\d{0,6}|0", text) else text


def parse(text: str, variables: dict[str, str] | None = None) -> list[tuple[str, dict]]:
    """(operator, parameters) of each section, sections sorted as text."""
    variables = variables or {}
    text = re.sub(r"\$\((\w+)\)", lambda m: variables.get(m[1], m[0]), text)
    config = configparser.ConfigParser(interpolation=None, delimiters=("=",))
    config.read_string(text)
    steps = []
    for section in sorted(config.sections()):
        name = section.split()[-1]
        if name not in OPERATORS:
            raise ValueError(f"no operator {name!r} in section {section!r}")
        steps.append((name, {k: (v if k == "bits" else _value(v)) for k, v in config[section].items()}))
    return steps


def apply(events: DataFrame, text: str, variables: dict[str, str] | None = None) -> DataFrame:
    """``events`` through the chain; Catalyst sees one plan."""
    return reduce(lambda df, step: OPERATORS[step[0]](df, **step[1]), parse(text, variables), events)


def optimize(events: DataFrame, text: str, candidates: list[dict[str, str]], metric: Callable[[DataFrame], Column]) -> DataFrame:
    """(candidate, fitness) for each set of variables, ``fitness`` being an aggregate over what the chain makes of the events.

    The chain is cut before the first operator that has a variable of the candidates: what comes before is the same
    for all and is kept, the rest is applied for each of them. All are scored in one job, so their number is the
    caller's and bounds the plan.
    """
    names = {n for c in candidates for n in c}
    steps = parse(text)
    varies = [any(isinstance(v, str) and names & set(re.findall(r"\$\((\w+)\)", v)) for v in values.values()) for _, values in steps]
    cut = varies.index(True) if True in varies else len(steps)
    head = reduce(lambda df, step: OPERATORS[step[0]](df, **step[1]), steps[:cut], events).persist()

    def scored(k: int, values: dict[str, str]) -> DataFrame:
        body = parse(text, values)[cut:]
        made = reduce(lambda df, step: OPERATORS[step[0]](df, **step[1]), body, head)
        return made.agg(metric(made).cast("double").alias("fitness")).select(F.lit(k).cast("long").alias("candidate"), "fitness")

    return reduce(DataFrame.unionByName, [scored(k, c) for k, c in enumerate(candidates)])
