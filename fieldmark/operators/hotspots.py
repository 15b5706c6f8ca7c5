"""Reverse hotspots: where and when a taxon is likely, with windows that touch in the same or the next cell merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.operators.core import first_by, islands, top_k
from fieldmark.operators.graph import components
from fieldmark.operators.places import ring
from fieldmark.sources.shared import kept

# Days between windows that still touch, rows of a taxon, rows that a search looks at.
TOUCH_DAYS, TOP, LOOKED_AT = 7, 300, 2000
SHARE, QUARTILE = 0.65, 0.75
BIN = 7  # days of a bin in which windows meet


def strong(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """keys, week, value of the weeks that reach both SHARE of the peak and the upper quartile; at most 52 rows a key."""
    of = W.partitionBy(*keys)
    rows = scores.withColumns({"_k": F.row_number().over(of.orderBy(value, "week")) - 1, "_n": F.count("*").over(of), "_peak": F.max(value).over(of)})
    quartile = F.max(F.when(F.col("_k") == F.floor((F.col("_n") - 1) * QUARTILE), F.col(value))).over(of)
    return rows.withColumn("_q", quartile).filter(F.col(value) + 1e-12 >= F.greatest(SHARE * F.col("_peak"), F.col("_q"))).drop("_k", "_n", "_peak", "_q")


def windows(scores: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """keys, start, end (days), peak_day, value: runs of strong weeks on the circle, each with its best week (ties: the first of the year)."""
    weeks = strong(scores, keys, value)
    of = W.partitionBy(*keys)
    runs = islands(weeks, keys, "week").withColumns({"_w": (F.count("*").over(of) > 1) & (F.min("begin").over(of) == 1) & (F.max("end").over(of) == 52), "_late": F.max("begin").over(of)})
    # A run that ends with week 52 goes on with the one that begins with week 1.
    runs = runs.select(*keys, "begin", "end", F.when(F.col("_w") & (F.col("begin") == 1), F.col("_late")).otherwise(F.col("begin")).alias("_from"), F.when(F.col("_w") & (F.col("begin") == F.col("_late")), F.min("end").over(of)).otherwise(F.col("end")).alias("_to"))
    inside = weeks.join(runs, keys).filter(F.col("week").between(F.col("begin"), F.col("end")))
    best = inside.groupBy(*keys, "_from", "_to").agg(F.max(F.struct(F.col(value), (-F.col("week")).alias("_week"))).alias("_best"))
    middle = F.when(-F.col("_best._week") == 52, 361).otherwise(-F.col("_best._week") * 7 - 3)
    last = F.when(F.col("_to") == 52, 365).otherwise(F.col("_to") * 7)
    return best.select(*keys, ((F.col("_from") - 1) * 7 + 1).cast("int").alias("start"), last.cast("int").alias("end"), middle.cast("int").alias("peak_day"), F.col(f"_best.{value}").alias(value))


def pieces(start: Column, end: Column) -> Column:
    """The one or two stretches of days of a window on the circle, as structs a, b; both 1..365."""
    one = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    return F.when(start <= end, F.array(one(start, end))).otherwise(F.array(one(start, F.lit(365)), one(F.lit(1), end)))


def meet(left: Column, right: Column) -> Column:
    """Whether any of the pieces of two windows overlap."""
    return F.exists(left, lambda x: F.exists(right, lambda y: F.greatest(x["a"], y["a"]) <= F.least(x["b"], y["b"])))


def widened(start: Column, end: Column, days: int) -> Column:
    """The pieces of a window with so many days more at both ends; the whole year where they meet."""
    length = F.pmod(end - start, F.lit(365)) + 1
    whole = F.array(F.struct(F.lit(1).alias("a"), F.lit(365).alias("b")))
    a, b = F.pmod(start - 1 - days, F.lit(365)) + 1, F.pmod(end - 1 + days, F.lit(365)) + 1
    return F.when(length + 2 * days >= 365, whole).otherwise(pieces(a, b))


def binned(p: Column) -> Column:
    """The bins of BIN days that the pieces of a window touch."""
    return F.array_distinct(F.flatten(F.transform(p, lambda x: F.sequence(F.floor(x["a"] / BIN), F.floor(x["b"] / BIN)))))


def touching(rows: DataFrame, days: int = TOUCH_DAYS) -> DataFrame:
    """Pairs (id, other) of windows (id, taxon, level, unit, x, y, start, end) of one taxon and level that overlap or are at most `days` apart,
    in the same unit, or in cells next to each other (x and y are null for units that have no neighbours).

    Windows meet by taxon, cell and bin of days; the exact test follows.
    """
    mine = rows.select("id", "taxon", "level", "unit", "x", "y", pieces(F.col("start"), F.col("end")).alias("p"))
    wide = rows.select(F.col("id").alias("other"), "taxon", "level", "unit", "x", "y", widened(F.col("start"), F.col("end"), days).alias("q"))
    each = lambda d, p: d.withColumn("bin", F.explode(binned(F.col(p))))
    by_unit = each(mine, "p").drop("x", "y").join(each(wide, "q").drop("x", "y"), ["taxon", "level", "unit", "bin"])
    by_cell = each(mine.filter("x IS NOT NULL"), "p").drop("unit").join(each(ring(wide.filter("x IS NOT NULL")), "q").drop("unit"), ["taxon", "level", "x", "y", "bin"])
    met = by_unit.select("id", "other", "p", "q").unionByName(by_cell.select("id", "other", "p", "q"))
    return met.filter((F.col("id") < F.col("other")) & meet(F.col("p"), F.col("q"))).select("id", "other").distinct()


def one_season(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end: everything but the longest stretch of days that is in none of a key's windows; at most 365 days a key are held."""
    days = rows.select(*keys, F.explode(pieces(F.col("start"), F.col("end"))).alias("p")).select(*keys, F.explode(F.sequence("p.a", "p.b")).alias("d")).distinct()
    of = W.partitionBy(*keys)
    first, after = F.min("d").over(of), F.lead("d").over(of.orderBy("d"))
    gaps = days.withColumns({"next": F.coalesce(after, first), "gap": F.coalesce(after, first + 365) - F.col("d") - 1})
    m = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.struct("gap", (-F.col("d")).alias("back"), "next")).alias("m"))
    whole = F.col("n") == 365
    return m.select(*keys, F.when(whole, 1).otherwise(F.col("m.next")).cast("int").alias("start"), F.when(whole, 365).otherwise(-F.col("m.back")).cast("int").alias("end"))


def merged(candidates: DataFrame, top: int = TOP, days: int = TOUCH_DAYS) -> DataFrame:
    """taxon, rank, unit, level, start, end, peak_day, score, members, west, south, east, north.

    candidates: taxon, level, unit, x, y, start, end, peak_day, score, west, south, east, north. Windows that touch become one
    hotspot, named by its best window (ties: unit, start, end), with one season of them all, the units it covers and the box around
    them. Hotspots with the same level, unit and season are one. The first `top` of each taxon by score stay. Inside a taxon nothing is
    gathered in one task but its last ranking, which Spark cuts to `top` rows before the shuffle.
    """
    rows = kept(candidates.withColumn("id", F.concat_ws("|", "taxon", "level", "unit", "start", "end")), "windows")
    named = components(touching(rows, days), "id", "other").withColumnRenamed("id", "of")
    rows = kept(rows.join(named, F.col("id") == F.col("of"), "left").withColumn("spot", F.coalesce("component", "id")).drop("of", "component"), "spots")
    order = [F.col("score").desc(), F.col("unit"), F.col("start"), F.col("end")]
    while True:
        best = first_by(rows, ["taxon", "spot"], *order).select("taxon", "spot", "unit", "level", "peak_day", "score")
        found = kept(best.join(one_season(rows, ["spot"]), "spot"), "spots-merged")
        again = found.groupBy("taxon", "level", "unit", "start", "end").agg(F.min("spot").alias("least"), F.count("*").alias("n"), F.collect_set("spot").alias("spots")).filter("n > 1")
        if again.isEmpty():
            break
        same = again.select(F.explode("spots").alias("was"), "least")
        rows = kept(rows.join(same, F.col("spot") == F.col("was"), "left").withColumn("spot", F.coalesce("least", "spot")).drop("was", "least"), "spots")
    covers = rows.groupBy("spot").agg(F.array_sort(F.collect_set("unit")).alias("members"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    ranked = top_k(found, ["taxon"], top, *order)
    return ranked.join(covers, "spot").select("taxon", "rank", "unit", "level", "start", "end", "peak_day", "score", "members", "west", "south", "east", "north")


def on_date(year: Column, day: Column) -> Column:
    """The date of a day of the season (1..365, without Feb 29) in a year."""
    plain = F.date_add(F.lit("2001-01-01").cast("date"), (F.greatest(F.least(F.round(day), F.lit(365)), F.lit(1)) - 1).cast("int"))
    return F.make_date(year, F.month(plain), F.dayofmonth(plain))


def searched(hotspots: DataFrame, units: DataFrame, level: str = "", code: str = "", name: str = "", season: tuple[int, int] | None = None, year: int = 2001, looked_at: int = LOOKED_AT) -> DataFrame:
    """The hotspots of each taxon among its first `looked_at` by score that lie in a region and season, with their units' names and dates.

    units: level, unit, name, city_name, district. level and code are matched whole (code also against the hotspot's members), name is looked for
    in the three names; an empty one asks for nothing. season: first and last day, around the turn of the year if the last is before the first. A
    season that ends before it begins ends in the next year; label is its dates as M/D-M/D.
    """
    u = units.select(F.col("level").alias("ulevel"), F.col("unit").alias("uunit"), "name", "city_name", "district")
    rows = top_k(hotspots.drop("rank"), ["taxon"], looked_at, F.col("score").desc(), F.col("unit"), F.col("start"), F.col("end"))
    rows = rows.join(u, (F.col("level") == F.col("ulevel")) & (F.col("unit") == F.col("uunit"))).drop("ulevel", "uunit")
    if level:
        rows = rows.filter(F.col("level") == level)
    if code:
        rows = rows.filter((F.col("unit") == code) | F.array_contains("members", code))
    if name:
        said = lambda c: F.coalesce(F.contains(F.col(c), F.lit(name)), F.lit(False))
        rows = rows.filter(said("name") | said("city_name") | said("district"))
    if season:
        rows = rows.filter(meet(pieces(F.col("start"), F.col("end")), pieces(F.lit(season[0]), F.lit(season[1]))))
    first, last = on_date(F.lit(year), F.col("start")), on_date(F.lit(year) + F.when(F.col("end") < F.col("start"), 1).otherwise(0), F.col("end"))
    label = F.concat(F.date_format(first, "M/d"), F.lit("-"), F.date_format(last, "M/d"))
    return rows.withColumns({"first_date": first, "last_date": last, "peak_date": on_date(F.lit(year), F.col("peak_day")), "label": label})
