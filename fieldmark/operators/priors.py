"""How strongly each level of a hierarchy holds on to the level above, chosen level by level on held-out counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The factors tried, and the digits that losses are compared to.
FACTORS, DIGITS = (0.25, 0.5, 1.0, 2.0, 4.0), 12


def posterior(levels: list[str], strengths: list[Column]) -> Column:
    """Posterior mean from sums e_<level> and d_<level>: the first level is plainly smoothed, each further one takes the level above as
    prior trials of its own strength. A level without trials is skipped."""
    e, d = (lambda x: F.coalesce(F.col(f"e_{x}"), F.lit(0.0))), (lambda x: F.coalesce(F.col(f"d_{x}"), F.lit(0.0)))
    p = (d(levels[0]) + 1) / (e(levels[0]) + 2)
    for level, s in zip(levels[1:], strengths):
        p = F.when(e(level) > 0, (p * s + d(level)) / (s + e(level))).otherwise(p)
    return p


def of_group(group: str, strengths: dict, default: float) -> Column:
    out = F.lit(float(default))
    for key, value in strengths.items():
        out = F.when(F.col(group) == key, F.lit(float(value))).otherwise(out)
    return out


def tuned(rows: DataFrame, levels: list[str], group: str, total: str, positive: str, start: dict[str, float], factors=FACTORS) -> list[tuple]:
    """(level, group, strength, brier, weight, selected) of each level but the first, group and strength tried.

    rows: a context each, with sums of training by level, and the held-out trials and positives. One aggregate a level, with all strengths side by
    side; what it selects holds when the next level is tried. The Brier score is by trials; ties go to the lower strength. Groups
    are few (they come to the driver); rows without trials or group don't count, and a group without rows keeps its start.
    """
    rows = rows.filter((F.col(total) > 0) & F.col(group).isNotNull())
    chosen, out = {level: {} for level in levels[1:]}, []
    for level in levels[1:]:
        tried = sorted({start[level] * f for f in factors if start[level] * f > 0})
        losses = []
        for i, s in enumerate(tried):
            p = posterior(levels, [F.lit(float(s)) if x == level else of_group(group, chosen[x], start[x]) for x in levels[1:]])
            losses.append(F.sum(F.col(positive) * F.pow(1 - p, 2.0) + (F.col(total) - F.col(positive)) * F.pow(p, 2.0)).alias(f"loss{i}"))
        for r in rows.groupBy(group).agg(F.sum(total).alias("weight"), *losses).collect():
            briers = [round(r[f"loss{i}"] / r["weight"], DIGITS) for i in range(len(tried))]
            best = min(range(len(tried)), key=lambda i: (briers[i], tried[i]))
            chosen[level][r[group]] = tried[best]
            out += [(level, r[group], tried[i], briers[i], float(r["weight"]), i == best) for i in range(len(tried))]
    return out
