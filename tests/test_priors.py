"""Prior strengths against a plain search."""

import random

from fieldmark.operators.priors import tuned

LEVELS, START, FACTORS = ["a", "b", "c"], {"b": 8.0, "c": 4.0}, (0.5, 1.0, 4.0)


def plain(rows):
    chosen, out = {x: {} for x in START}, set()
    for level in START:
        for g in {r[0] for r in rows}:
            scores = {}
            for s in (START[level] * f for f in FACTORS):
                loss = weight = 0
                for group, t, k, *sums in rows:
                    if group == g and t > 0:
                        p = (sums[1] + 1) / (sums[0] + 2)
                        for i, x in enumerate(START):
                            n, y, own = sums[2 + 2 * i] or 0, sums[3 + 2 * i] or 0, s if x == level else chosen[x].get(g, START[x])
                            p = (p * own + y) / (own + n) if n else p
                        loss, weight = loss + k * (1 - p) ** 2 + (t - k) * p**2, weight + t
                if weight:
                    scores[s] = (round(loss / weight, 10), s)
            if scores:
                chosen[level][g] = min(scores.values())[1]
                out |= {(level, g, s, v[0], s == chosen[level][g]) for s, v in scores.items()}
    return out


def test_strengths_as_by_plain_search(spark):
    rng, rows = random.Random(3), []
    for g, rate in (("rare", 0.05), ("common", 0.6), ("none", 0.2)):
        for _ in range(60):
            counts = [(n, sum(rng.random() < rate for _ in range(n))) for n in (80, rng.randint(0, 30), rng.randint(0, 6))]
            t = 0 if g == "none" else rng.randint(0, 9)
            rows.append((g, t, sum(rng.random() < rate for _ in range(t)), *[x for c in counts for x in c]))
    rows.append(("rare", 3, 1, 80, 4, None, None, None, None))
    df = spark.createDataFrame([*rows, (None, 5, 5, 1, 1, 1, 1, 1, 1)], "g string, t int, k int, " + ", ".join(f"e_{x} int, d_{x} int" for x in LEVELS))
    got = tuned(df, LEVELS, "g", "t", "k", START, FACTORS)
    assert {(level, g, s, round(brier, 10), best) for level, g, s, brier, _, best in got} == plain(rows)
    assert {r[1] for r in got} == {"rare", "common"} and tuned(df.filter("false"), LEVELS, "g", "t", "k", START) == []
