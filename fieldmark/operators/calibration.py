"""Calibrators of probabilities, fitted for all scopes at once by sums that Spark adds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.shared import kept


# How near to 0 and 1 probabilities may be, when a calibrator is applied and when it is fitted.
APPLIED, FITTED = 1e-9, 1e-8


def _logs(p: Column, least: float) -> tuple[Column, Column]:
    inner = F.greatest(F.lit(least), F.least(F.lit(1 - least), p))
    return F.log(inner), -F.log1p(-inner)


def calibrated(p: Column, a: Column, b: Column, c: Column) -> Column:
    """logistic(a ln p - b ln(1 - p) + c)."""
    x, y = _logs(p, APPLIED)
    return 1 / (1 + F.exp(-(a * x + b * y + c)))


def _bounded(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def beta_calibration(df: DataFrame, scope: str, p: str, total: str, positives: str, ridge: float = 1e-3, steps: int = 50, within: float = 1e-7) -> DataFrame:
    """scope, a, b, c: one calibrator a scope, pulled to the identity (1, 1, 0) by a ridge.

    A Newton step is one partial aggregate over the rows, nine sums a scope, and a 3 x 3 system
    solved as columns, so a scope of any size is spread over all tasks; the driver sees one number a
    step. Rows without scope, probability or trials are left out; scopes with fewer than three rows
    keep the identity; no rows give no scopes.
    """
    x, y = _logs(F.col(p), FITTED)
    rows = kept(df.filter(f"{scope} IS NOT NULL AND {p} IS NOT NULL AND {total} > 0 AND {positives} >= 0").select(F.col(scope).alias("scope"), x.alias("x"), y.alias("y"), F.col(total).cast("double").alias("t"), F.least(positives, total).cast("double").alias("k")), "trials")
    now = rows.groupBy("scope").agg((F.count("*") >= 3).alias("fit")).select("scope", "fit", F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("c"))
    now = kept(now, "calibrators")
    z = 1 / (1 + F.exp(-(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c"))))
    miss, spread = F.col("k") - F.col("t") * F.col("z"), F.greatest(F.lit(1e-9), F.col("t") * F.col("z") * (1 - F.col("z")))
    sums = {"g1": "x * miss", "g2": "y * miss", "g3": "miss", "h11": "x * x * v", "h12": "x * y * v", "h13": "x * v", "h22": "y * y * v", "h23": "y * v", "h33": "v"}
    pull = {"g1": ridge * (1 - F.col("a")), "g2": ridge * (1 - F.col("b")), "g3": -ridge * F.col("c"), **{h: F.lit(ridge) for h in ("h11", "h22", "h33")}}
    g1, g2, g3, h11, h12, h13, h22, h23, h33 = map(F.col, sums)
    det = h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13)
    move = {  # by Cramer's rule
        "da": g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3),
        "db": h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13),
        "dc": h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13),
    }
    for _ in range(steps):
        met = rows.join(now.filter("fit"), "scope").withColumn("z", z).withColumns({"miss": miss, "v": spread})
        added = met.groupBy("scope", "a", "b", "c").agg(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()]).withColumns({n: F.col(n) + w for n, w in pull.items()})
        moved = added.withColumns({n: F.coalesce(F.try_divide(m, det), F.lit(0.0)) for n, m in move.items()})
        new = moved.select(F.col("scope").alias("s"), _bounded(F.col("a") + _bounded(F.col("da"), -2, 2), 0.01, 10).alias("na"), _bounded(F.col("b") + _bounded(F.col("db"), -2, 2), 0.01, 10).alias("nb"), _bounded(F.col("c") + _bounded(F.col("dc"), -2, 2), -10, 10).alias("nc"), F.greatest(*[F.abs(n) for n in move]).alias("far"))
        # A scope that has come to rest takes no part in later steps.
        now = kept(now.join(new, F.col("scope") == F.col("s"), "left").select("scope", (F.col("fit") & (F.coalesce("far", F.lit(0.0)) >= within)).alias("fit"), F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), F.coalesce("nc", "c").alias("c")), "calibrators")
        if now.filter("fit").isEmpty():
            break
    return now.drop("fit")


def cross_fitted(df: DataFrame, scope: str, fold: str, p: str, total: str, positives: str, folds: int) -> DataFrame:
    """df with q: p calibrated by what the other folds of its scope say, or p itself if they say nothing. Folds are 0..folds-1;
    rows go once to each other fold, so the work grows with the rows times the folds."""
    key = F.struct(F.col(scope).alias("s"), F.col("held").cast("int").alias("f"))
    others = df.select(scope, fold, p, total, positives, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held")).filter(F.col("held") != F.col(fold)).withColumn("part", key)
    found = beta_calibration(others, "part", p, total, positives).select(F.col("scope.s").alias("_s"), F.col("scope.f").alias("_f"), "a", "b", "c")
    rows = df.join(found, (F.col(scope) == F.col("_s")) & (F.col(fold) == F.col("_f")), "left")
    return rows.withColumn("q", F.when(F.col("a").isNull(), F.col(p)).otherwise(calibrated(F.col(p), F.col("a"), F.col("b"), F.col("c")))).drop("a", "b", "c", "_s", "_f")


# Counts of positives at which groups of items begin, the last those from which an item is calibrated by itself; ridge of the one-parameter families.
BOUNDS, RIDGE = (30, 60, 120, 200), 0.1
#: Families in order of preference, and how much of a fit is taken.
FAMILIES, SHRINKAGES = ("identity", "intercept", "temperature", "beta"), (0.5, 1.0)


def calibrator_scope(item: Column, positives: Column, bounds: tuple[int, ...] = BOUNDS) -> Column:
    """species:<item> for items with enough positives, group:positive_<from>_<to> for those with fewer, null for those with too few to calibrate."""
    out = F.when(positives >= bounds[-1], F.concat(F.lit("species:"), item.cast("string")))
    for low, high in zip(bounds[-2::-1], bounds[:0:-1]):
        out = out.when(positives >= low, F.lit(f"group:positive_{low}_{high - 1}"))
    return out


def one_parameter(df: DataFrame, scope: str, p: str, total: str, positives: str, ridge: float = RIDGE, steps: int = 80, within: float = 1e-8) -> DataFrame:
    """scope, family, a, b, c: for each scope an intercept (1, 1, c) and a temperature (a, a, 0), both pulled to the identity by a ridge.

    Both families take their Newton steps together, one aggregate of four sums a scope each; the driver sees one flag a step. Rows without
    scope, probability or trials, or with more positives than trials, are left out; scopes with fewer than three rows have no fit.
    """
    x, y = _logs(F.col(p), FITTED)
    rows = df.filter(f"{scope} IS NOT NULL AND {p} IS NOT NULL AND {total} > 0 AND {positives} BETWEEN 0 AND {total}")
    rows = kept(rows.select(F.col(scope).alias("scope"), (x + y).alias("x"), F.col(total).cast("double").alias("t"), F.col(positives).cast("double").alias("k")), "logits")
    now = kept(rows.groupBy("scope").agg(F.count("*").alias("n")).filter("n >= 3").select("scope", F.lit(True).alias("fit"), F.lit(0.0).alias("c"), F.lit(True).alias("fit_s"), F.lit(1.0).alias("s")), "one-parameter")
    logistic = lambda z: 1 / (1 + F.exp(-z))
    for _ in range(steps):
        met = rows.join(now.filter("fit OR fit_s"), "scope").withColumns({"zc": logistic(F.col("x") + F.col("c")), "zs": logistic(F.col("x") * F.col("s"))})
        spread = lambda z, w: F.greatest(F.lit(1e-12), F.col("t") * F.col(z) * (1 - F.col(z)) * w)
        sums = met.groupBy("scope").agg(
            F.sum(F.col("k") - F.col("t") * F.col("zc")).alias("gc"), F.sum(spread("zc", F.lit(1.0))).alias("hc"),
            F.sum(F.col("x") * (F.col("k") - F.col("t") * F.col("zs"))).alias("gs"), F.sum(spread("zs", F.col("x") * F.col("x"))).alias("hs"),
        )
        dc, ds = _bounded((F.col("gc") - ridge * F.col("c")) / (F.col("hc") + ridge), -2, 2), _bounded((F.col("gs") - ridge * (F.col("s") - 1)) / (F.col("hs") + ridge), -1, 1)
        moved = now.join(sums, "scope", "left").withColumns({"dc": F.when(F.col("fit"), dc).otherwise(0.0), "ds": F.when(F.col("fit_s"), ds).otherwise(0.0)})
        # A family that has come to rest in a scope moves no more.
        now = kept(moved.select("scope", (F.abs("dc") >= within).alias("fit"), _bounded(F.col("c") + F.col("dc"), -12, 12).alias("c"), (F.abs("ds") >= within).alias("fit_s"), _bounded(F.col("s") + F.col("ds"), 0.05, 20).alias("s")), "one-parameter")
        if now.filter("fit OR fit_s").isEmpty():
            break
    fit = lambda name, a, c: F.struct(F.lit(name).alias("family"), a.alias("a"), a.alias("b"), c.alias("c"))
    return now.select("scope", F.inline(F.array(fit("intercept", F.lit(1.0), F.col("c")), fit("temperature", F.col("s"), F.lit(0.0)))))


def chosen_families(df: DataFrame, scope: str, fold: str, p: str, total: str, positives: str, folds: int) -> DataFrame:
    """scope, family, shrinkage, a, b, c, brier, selected: each family with each shrinkage, fitted to all folds of a scope, and its Brier score
    when each fold is calibrated by what the other folds fit.

    Shrinkage takes that part of the way from the identity to the fit; the identity is there once, with none. What no fold could fit is the identity.
    The least score is selected, rounded to 12 digits; ties go to the earlier family, then to the lower shrinkage. All folds are fitted side by side,
    rows going once to each other fold and once to the fit of all.
    """
    rows = df.filter(f"{scope} IS NOT NULL AND {p} IS NOT NULL AND {total} > 0 AND {positives} BETWEEN 0 AND {total}")
    rows = kept(rows.select(F.col(scope).alias("scope"), F.col(fold).cast("int").alias("fold"), F.col(p).cast("double").alias("p"), F.col(total).alias("total"), F.col(positives).alias("positives")), "calibrated-rows")
    each = rows.withColumn("held", F.explode(F.sequence(F.lit(-1), F.lit(folds - 1)))).filter("held <> fold").withColumn("part", F.struct("scope", "held"))
    fits = one_parameter(each, "part", "p", "total", "positives").withColumnRenamed("scope", "part")
    beta = beta_calibration(each, "part", "p", "total", "positives").select(F.col("scope").alias("part"), F.lit("beta").alias("family"), "a", "b", "c")
    fits = kept(fits.unionByName(beta).select(F.col("part.scope").alias("scope"), F.col("part.held").alias("held"), "family", "a", "b", "c"), "family-fits")

    kinds = [("identity", 0.0, 0)] + [(f, s, i) for i, f in enumerate(FAMILIES) if i for s in SHRINKAGES]
    variants = F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("shrinkage"), F.lit(i).alias("turn")) for f, s, i in kinds]))

    def with_fit(base: DataFrame) -> DataFrame:
        met = base.select("*", variants).join(fits, ["scope", "held", "family"], "left").fillna({"a": 1.0, "b": 1.0, "c": 0.0})
        part = lambda c, none: none + F.col("shrinkage") * (F.col(c) - none)
        return met.withColumns({"a": part("a", 1), "b": part("b", 1), "c": part("c", 0)})

    q = F.when(F.col("family") == "identity", F.col("p")).otherwise(calibrated(F.col("p"), F.col("a"), F.col("b"), F.col("c")))
    tested = with_fit(rows.withColumnRenamed("fold", "held")).withColumn("q", q)
    loss = F.col("positives") * F.pow(1 - F.col("q"), 2.0) + (F.col("total") - F.col("positives")) * F.pow(F.col("q"), 2.0)
    scores = kept(tested.groupBy("scope", "family", "shrinkage", "turn").agg(F.round(F.sum(loss) / F.sum("total"), 12).alias("brier")), "family-scores")
    best = scores.groupBy("scope").agg(F.min(F.struct("brier", "turn", "shrinkage")).alias("best"))
    final = with_fit(rows.select("scope").distinct().withColumn("held", F.lit(-1))).select("scope", "family", "shrinkage", "a", "b", "c")
    selected = (F.col("best.turn") == F.col("turn")) & (F.col("best.shrinkage") == F.col("shrinkage"))
    return final.join(scores, ["scope", "family", "shrinkage"]).join(best, "scope").select("scope", "family", "shrinkage", "a", "b", "c", "brier", selected.alias("selected"))
