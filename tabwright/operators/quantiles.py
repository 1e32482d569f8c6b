"""Exact linear-interpolation quantiles that never hold a whole column in one task.

`percentile` keeps one counter per distinct value, so it is used only where the number of
distinct values is known to be small. A larger column is narrowed first: a bounded sketch
brackets each wanted rank, one counting pass proves the bracket, and the exact aggregate
then runs on the few values inside it. Every step is a narrow scan with a one-row result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import named
from tabwright.session import batches

EXACT_DISTINCT = 100_000  # most distinct values one exact aggregate may hold
SKETCH_ACCURACY = 10_000
COLUMNS_PER_JOB = 40


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    counts: dict[str, int],
    distinct: dict[str, int],
    limit: int = EXACT_DISTINCT,
) -> dict[str, list[float | None]]:
    """{column: [quantile per prob]}; `counts` and `distinct` come from the facts scan."""
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    filled = [c for c in columns if counts[c] > 0]
    small = [c for c in filled if distinct[c] <= limit]
    for group in batches(small, COLUMNS_PER_JOB):
        row = df.agg(
            *[F.percentile(named(c), F.array(*map(F.lit, probs))).alias(f"q{i}") for i, c in enumerate(group)]
        ).first()
        for i, c in enumerate(group):
            result[c] = [float(v) for v in row[f"q{i}"]]
    large = [c for c in filled if distinct[c] > limit]
    for group in batches(large, COLUMNS_PER_JOB // 4):
        for (c, j), value in _narrowed(df, group, probs, counts, limit).items():
            result[c][j] = value
    return result


def _narrowed(df, columns, probs, counts, limit):
    """Bracket, prove and resolve every (column, prob) pair of a few large columns."""
    unproven = {
        (c, j): {
            "at": (counts[c] - 1) * p,  # fractional rank that is wanted
            "below": 0,  # rows under the bracket
            "inside": counts[c],  # rows in the bracket
            "lo": None,
            "hi": None,
            "margin": 3.0 / SKETCH_ACCURACY,
        }
        for c in columns
        for j, p in enumerate(probs)
    }
    resolved: dict[tuple[str, int], float] = {}
    proven: dict[tuple[str, int], dict] = {}
    while unproven:
        keys = list(unproven)
        brackets = _brackets(df, unproven)
        tried = {k: {**unproven[k], "lo": brackets[k][0], "hi": brackets[k][1]} for k in keys}
        checks = []
        for i, key in enumerate(keys):
            held = _inside(key[0], tried[key])
            checks += [
                F.count_if(named(key[0]) < F.lit(tried[key]["lo"])).alias(f"b{i}"),
                F.count(held).alias(f"n{i}"),
                # a bracket that must be small by its share needs no distinct count
                (F.approx_count_distinct(held) if _expected(unproven[key]) > limit else F.count(held)).alias(f"d{i}"),
            ]
        proof = df.agg(*checks).first()
        for i, key in enumerate(keys):
            state, before = tried[key], unproven.pop(key)
            state["below"], state["inside"] = proof[f"b{i}"], proof[f"n{i}"]
            if not state["below"] <= math.floor(state["at"]) <= math.ceil(state["at"]) < state["below"] + state["inside"]:
                unproven[key] = {**before, "margin": before["margin"] * 8}
            elif state["lo"] == state["hi"]:
                resolved[key] = float(state["lo"])
            elif proof[f"d{i}"] <= limit or state["inside"] == before["inside"]:
                proven[key] = state
            else:
                unproven[key] = state
    if proven:
        exact = df.agg(
            *[
                F.percentile(_inside(key[0], state), F.lit(_share(state))).alias(f"q{i}")
                for i, (key, state) in enumerate(proven.items())
            ]
        ).first()
        resolved.update({key: float(exact[f"q{i}"]) for i, key in enumerate(proven)})
    return resolved


def _expected(state):
    """About how many rows the next bracket will hold."""
    return 2 * state["margin"] * state["inside"]


def _share(state):
    """Position of the wanted rank among the values of the bracket, in [0, 1]."""
    return min(max((state["at"] - state["below"]) / max(state["inside"] - 1, 1), 0.0), 1.0)


def _brackets(df, states):
    """(low, high) value around every wanted rank; ranks of one set of values share one sketch."""
    groups: dict[tuple, list] = {}
    for key, s in states.items():
        whole = s["margin"] >= 1
        groups.setdefault((key[0], s["lo"], s["hi"], whole), []).append(key)
    exprs = []
    for i, ((name, _, _, whole), keys) in enumerate(groups.items()):
        held = _inside(name, states[keys[0]])
        if whole:
            exprs.append(F.array(F.min(held), F.max(held)).alias(f"s{i}"))
            continue
        shares = []
        for key in keys:
            at, margin = _share(states[key]), states[key]["margin"]
            shares += [F.lit(max(at - margin, 0.0)), F.lit(min(at + margin, 1.0))]
        exprs.append(F.percentile_approx(held, F.array(*shares), SKETCH_ACCURACY).alias(f"s{i}"))
    row = df.agg(*exprs).first()
    found = {}
    for i, ((_, _, _, whole), keys) in enumerate(groups.items()):
        for j, key in enumerate(keys):
            found[key] = tuple(row[f"s{i}"]) if whole else (row[f"s{i}"][2 * j], row[f"s{i}"][2 * j + 1])
    return found


def _inside(name, state):
    c = named(name)
    if state["lo"] is None:
        return c
    return F.when((c >= F.lit(state["lo"])) & (c <= F.lit(state["hi"])), c)
