"""Profiles of cells: k-means from fixed seeds, empty clusters refilled, small ones merged into the nearest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.core import top_k
from fieldmark.sources.shared import kept

# Rounds, cells that a profile needs, digits that distances are compared to.
ROUNDS, LEAST, DIGITS = 30, 32, 12
#: Standardised values are kept to nine digits and added as decimals, so sums don't depend on the order of rows.
EXACT = "decimal(28,9)"


@dataclass
class Profiles:
    """Centroids over standardised columns, with the mean and deviation of each; few numbers, held by the driver."""

    columns: list[str]
    means: list[float]
    deviations: list[float]
    centroids: list[list[float]]


def standardised(df: DataFrame, columns: list[str], means: list[float], deviations: list[float]) -> DataFrame:
    """df with its columns to mean 0 and deviation 1, to nine digits; a column of one value becomes 0."""
    return df.withColumns({c: F.round((F.col(c) - m) / (s or 1.0), 9) for c, m, s in zip(columns, means, deviations)})


def squared(columns: list[str], to: list[float]) -> Column:
    return F.round(sum((F.pow(F.col(c) - F.lit(x), 2.0) for c, x in zip(columns, to)), F.lit(0.0)), DIGITS)


def nearest(columns: list[str], centroids: list[list[float]], among: list[int] | None = None) -> Column:
    """The struct (distance, cluster) of the nearest centroid, the lower number among equals."""
    of = range(len(centroids)) if among is None else among
    return F.array_min(F.array(*[F.struct(squared(columns, centroids[k]).alias("distance"), F.lit(k).alias("cluster")) for k in of]))


def seeds(rows: DataFrame, id: str, columns: list[str], count: int) -> list[list[float]]:
    """The row next to the mean, then each time the row farthest from all seeds so far; ties go to the least id. One scan a seed."""
    chosen, places = [], []
    for _ in range(count):
        least = F.array_min(F.array(*[squared(columns, p) for p in places])) if places else -squared(columns, [0.0] * len(columns))
        best = rows.filter(~F.col(id).isin(chosen)).agg(F.min(F.struct((-least).alias("far"), F.col(id).alias("id"), *columns)).alias("best")).first()["best"]
        if best is None:
            break
        chosen.append(best["id"])
        places.append([best[c] for c in columns])
    return places


def clusters(rows: DataFrame, id: str, columns: list[str], centroids: list[list[float]], moved: dict, name: str) -> DataFrame:
    """rows with the number of their cluster: the one they were moved to, else the nearest."""
    own = nearest(columns, centroids)["cluster"]
    for key, k in moved.items():  # at most one for each cluster
        own = F.when(F.col(id) == key, k).otherwise(own)
    return rows.withColumn(name, own)


def refilled(rows: DataFrame, id: str, columns: list[str], centroids: list[list[float]], sizes: dict[int, int]) -> dict:
    """For each empty cluster, in order, the row farthest from its centroid in a cluster of more than one.

    No cluster gives more rows than there are empty ones, so each gives its farthest few to choose from.
    """
    empty = [k for k in range(len(centroids)) if not sizes.get(k)]
    if not empty:
        return {}
    near = rows.select(F.col(id).alias("id"), nearest(columns, centroids).alias("n")).select("id", "n.*")
    offered = top_k(near, ["cluster"], len(empty), F.col("distance").desc(), F.col("id")).collect()
    left, moved = dict(sizes), {}
    for k in empty:
        open_ = [r for r in offered if r["id"] not in moved and left[r["cluster"]] > 1]
        if open_:
            best = min(open_, key=lambda r: (-r["distance"], r["id"]))
            moved[best["id"]] = k
            left[best["cluster"]] -= 1
    return moved


def fitted(df: DataFrame, id: str, columns: list[str], count: int, rounds: int = ROUNDS, least: int = LEAST) -> tuple[DataFrame, Profiles]:
    """(rows, profiles). rows: id, profile (0 up, in the order of their seeds), distance (squared, to the centroid of the final profile).

    One scan a round: sizes and sums by cluster, and how many rows changed; the centroids come to the driver. It stops
    when no row changes. Profiles of fewer than `least` rows go: each of their rows joins the nearest that stays. Rows with a
    null in id or a column are left out; without rows, or if no profile is large enough, ValueError. Rows of one id should be one.
    """
    df = df.select(id, *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    m = df.agg(*[F.avg(F.round(c, 9).cast(EXACT)).cast("double").alias(f"m{i}") for i, c in enumerate(columns)], F.count("*").alias("n")).first()
    if not m["n"]:
        raise ValueError("no rows to find profiles in")
    means = [m[i] for i in range(len(columns))]
    d = df.agg(*[F.avg(F.round(F.pow(F.col(c) - x, 2.0), 9).cast(EXACT)).cast("double") for c, x in zip(columns, means)]).first()
    deviations = [v**0.5 for v in d]
    rows = kept(standardised(df, columns, means, deviations), "profile-rows")

    def sums(of: DataFrame, key: str) -> dict:
        found = of.groupBy(key).agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"), *[F.sum(F.col(c).cast(EXACT)).alias(f"s{i}") for i, c in enumerate(columns)]).collect()
        return {r[key]: (r["n"], r["changed"], [float(r[f"s{i}"]) / r["n"] for i in range(len(columns))]) for r in found}

    centroids, before = seeds(rows, id, columns, count), None
    for _ in range(rounds):
        at = lambda moved: clusters(rows if before is None else clusters(rows, id, columns, *before, "was"), id, columns, centroids, moved, "cluster")  # noqa: B023, E731
        changed = F.lit(True) if before is None else F.col("was") != F.col("cluster")
        found = sums(at({}).withColumn("changed", changed), "cluster")
        moved = refilled(rows, id, columns, centroids, {k: v[0] for k, v in found.items()})
        if moved:
            found = sums(at(moved).withColumn("changed", changed), "cluster")
        before = (centroids, moved)
        centroids = [found[k][2] if k in found else c for k, c in enumerate(centroids)]
        if not any(v[1] for v in found.values()):
            break
    stay = [k for k in range(len(centroids)) if k in found and found[k][0] >= least]
    if not stay:
        raise ValueError(f"no profile has {least} rows")
    own = clusters(rows, id, columns, *before, "was").withColumn("cluster", F.when(F.col("was").isin(stay), F.col("was")).otherwise(nearest(columns, centroids, stay)["cluster"]))
    final = sums(own.withColumn("changed", F.lit(False)), "cluster")
    number = {k: i for i, k in enumerate(stay)}
    profiles = Profiles(columns, means, deviations, [final[k][2] for k in stay])
    renumbered = F.coalesce(*[F.when(F.col("cluster") == k, i) for k, i in number.items()])
    distance = F.coalesce(*[F.when(F.col("cluster") == k, squared(columns, profiles.centroids[i])) for k, i in number.items()])
    return own.select(id, renumbered.cast("int").alias("profile"), distance.alias("distance")), profiles


def profiled(df: DataFrame, profiles: Profiles) -> DataFrame:
    """df with profile and distance: the nearest profile of rows that needn't have been fitted; both null where a column is."""
    near = nearest(profiles.columns, profiles.centroids)
    of = standardised(df.select("*", F.struct(*profiles.columns).alias("_own")), profiles.columns, profiles.means, profiles.deviations)
    whole = F.col(profiles.columns[0]).isNotNull()
    for c in profiles.columns[1:]:
        whole = whole & F.col(c).isNotNull()
    out = of.withColumn("_near", F.when(whole, near)).withColumns({"profile": F.col("_near.cluster"), "distance": F.col("_near.distance")})
    return out.withColumns({c: F.col(f"_own.{c}") for c in profiles.columns}).drop("_own", "_near")
