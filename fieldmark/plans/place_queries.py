"""Registered queries over places, seasons and evidence, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.season import haversine_m
from fieldmark.operators.core import top_k
from fieldmark.operators.places import cell, ring, split_by_cell
from fieldmark.plans.checklist_queries import day, query
from fieldmark.sources.tables import checklists, observations, observers, table
from fieldmark.streaming.feed import counted, latest

CELL_SQL = "CAST(floor(lon * 5) AS BIGINT) AS x, CAST(floor(lat * 5) AS BIGINT) AS y"
CELLS_SQL = f"c AS (SELECT {CELL_SQL}, count(*) AS lists, count(*) FILTER (state = 'F') AS hits FROM cl JOIN pp USING (observer) GROUP BY 1, 2)"
DIAGONAL_SQL = "2 * 6378137.0 * asin(least(1.0, sqrt(pow(sin(radians({n} - {s}) / 2), 2) + cos(radians({s})) * cos(radians({n})) * pow(sin(radians({e} - {w}) / 2), 2))))"


def cells(spark, d):
    """x, y, lists, hits: one row for each cell with checklists."""
    rows = checklists(spark, d).groupBy("observer").agg(F.count("*").alias("lists"), F.count_if(F.col("state") == "F").alias("hits")).join(observers(spark, d), "observer")
    return rows.groupBy(*cell()).agg(F.sum("lists").alias("lists"), F.sum("hits").alias("hits"))


@query(f"""WITH {CELLS_SQL} SELECT a.x, a.y, CAST(sum(b.lists) AS BIGINT) AS lists, CAST(sum(b.hits) AS BIGINT) AS hits
FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y""")
def neighbour_evidence(spark, d):
    """Exposure and detections of each cell and its ring. Cells are handed to their neighbours and summed, no pairs of cells are joined."""
    c = cells(spark, d)
    given = ring(c).groupBy("x", "y").agg(F.sum("lists").alias("lists"), F.sum("hits").alias("hits"))
    return given.join(c.select("x", "y"), ["x", "y"], "left_semi")


@query(f"""WITH {CELLS_SQL}, v AS (SELECT x, y FROM c WHERE substr(sha256(concat(CAST(x AS VARCHAR), ':', CAST(y AS VARCHAR))), 1, 1) IN ('0', '1', '2'))
SELECT x, y, lists, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.x = c.x AND v.y = c.y) THEN 'validation'
  WHEN EXISTS (SELECT 1 FROM v WHERE abs(v.x - c.x) <= 1 AND abs(v.y - c.y) <= 1) THEN 'buffer' ELSE 'training' END AS role FROM c""")
def spatial_holdout(spark, d):
    """Cells as validation, by a hash, as buffer next to those, or as training."""
    c = cells(spark, d)
    chosen = F.substring(F.sha2(F.concat_ws(":", "x", "y"), 256), 1, 1).isin("0", "1", "2")
    return split_by_cell(c.select("x", "y", "lists"), chosen)


@query(f"""WITH b AS (SELECT point, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n, count(*) AS places FROM pp GROUP BY point)
SELECT point, places, round({DIAGONAL_SQL.format(n="n", s="s", e="e", w="w")}, 2) AS drift_m, {DIAGONAL_SQL.format(n="n", s="s", e="e", w="w")} <= 500000 AS stable FROM b""")
def point_drift(spark, d):
    """How far a named point's coordinates stray: the diagonal of their box."""
    b = observers(spark, d).groupBy("point").agg(F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("n"), F.count("*").alias("places"))
    across = haversine_m(F.col("w"), F.col("s"), F.col("e"), F.col("n"))
    return b.select("point", "places", F.round(across, 2).alias("drift_m"), (across <= 500_000).alias("stable"))


@query("""SELECT province, city, point, CAST(grouping(province, city, point) AS BIGINT) AS depth, count(*) AS lists, count(DISTINCT observer) AS observers,
count(DISTINCT year(day)) AS years, count(*) >= 30 AND count(DISTINCT year(day)) >= 3 AS supported FROM cl JOIN pp USING (observer) GROUP BY ROLLUP (province, city, point)""")
def unit_support(spark, d):
    """Checklists, observers and years of each point, city, province and of all. Lists are summed by observer and
    year first; distinct observers are a sum, as each has one place, and years are a bitmap of at most 64."""
    per = checklists(spark, d).groupBy("observer").agg(F.count("*").alias("n"), F.bit_or(F.expr("shiftleft(1L, cast(year(day) - 1970 AS int))")).alias("bits"))
    rows = per.join(observers(spark, d).select("observer", "province", "city", "point"), "observer").rollup("province", "city", "point")
    out = rows.agg(F.grouping_id().alias("depth"), F.sum("n").alias("lists"), F.count("*").alias("observers"), F.bit_count(F.bit_or("bits")).cast("bigint").alias("years"))
    return out.withColumn("supported", (F.col("lists") >= 30) & (F.col("years") >= 3))


@query("""WITH p AS (SELECT province, city, point, count(*) AS n FROM cl JOIN pp USING (observer) GROUP BY ALL)
SELECT city, point, CASE WHEN n >= 30 THEN 'point' WHEN sum(n) OVER (PARTITION BY city) >= 30 THEN 'city' WHEN sum(n) OVER (PARTITION BY province) >= 30 THEN 'province' ELSE 'all' END AS unit FROM p""")
def deepest_supported(spark, d):
    """The smallest unit around each point that has enough checklists."""
    lists = checklists(spark, d).groupBy("observer").agg(F.count("*").alias("n"))
    p = lists.join(observers(spark, d), "observer").groupBy("province", "city", "point").agg(F.sum("n").alias("n"))
    around = lambda key: F.sum("n").over(W.partitionBy(key))
    unit = F.when(F.col("n") >= 30, "point").when(F.col("in_city") >= 30, "city").when(F.col("in_province") >= 30, "province").otherwise("all")
    return p.withColumns({"in_city": around("city"), "in_province": around("province")}).select("city", "point", unit.alias("unit"))


@query(f"""WITH e AS (SELECT DISTINCT taxon, observer, day, {CELL_SQL} FROM cl JOIN ob USING (report_id) JOIN pp USING (observer))
SELECT taxon, count(*) AS evidence, count(DISTINCT observer) AS observers FROM e GROUP BY taxon""")
def independent_evidence(spark, d):
    """Records of a taxon that differ in observer, date or cell. An observer has one cell, so the pair of observer and date decides."""
    rows = checklists(spark, d).join(observations(spark, d), "report_id").join(observers(spark, d).select("observer"), "observer", "left_semi")
    days = rows.select("taxon", "observer", "day").distinct().groupBy("taxon", "observer").agg(F.count("*").alias("n"))
    return days.groupBy("taxon").agg(F.sum("n").alias("evidence"), F.count("*").alias("observers"))


@query("""WITH t AS (SELECT taxon, sum(n) AS total FROM ob GROUP BY taxon)
SELECT report_id, taxon, idx, round(n * CASE WHEN total > 500 THEN 500 / total ELSE 1 END, 6) AS weight FROM ob JOIN t USING (taxon)""")
def capped_weight(spark, d):
    """Weights scaled so that no taxon's records weigh more than 500 in all."""
    ob = observations(spark, d)
    t = ob.groupBy("taxon").agg(F.sum("n").alias("total"))
    scale = F.when(F.col("total") > 500, 500 / F.col("total")).otherwise(1)
    return ob.join(t, "taxon").select("report_id", "taxon", "idx", F.round(F.col("n") * scale, 6).alias("weight"))


@query("""WITH s AS (SELECT DISTINCT taxon, CAST(least(365, dayofyear(day)) AS INT) AS d FROM cl JOIN ob USING (report_id)),
g AS (SELECT taxon, d, coalesce(lead(d) OVER w, min(d) OVER (PARTITION BY taxon)) AS next, coalesce(lead(d) OVER w, 365 + min(d) OVER (PARTITION BY taxon)) - d AS gap FROM s WINDOW w AS (PARTITION BY taxon ORDER BY d)),
r AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY gap DESC, d) AS k FROM g)
SELECT taxon, next AS begin_day, d AS end_day, CAST(366 - gap AS INT) AS length FROM r WHERE k = 1""")
def circular_season(spark, d):
    """A taxon's season around the year: all but the longest gap between its days (at most 365 a taxon)."""
    s = checklists(spark, d).join(observations(spark, d), "report_id").select("taxon", F.least(F.lit(365), F.dayofyear("day")).alias("d")).distinct()
    by = W.partitionBy("taxon")
    first, after = F.min("d").over(by), F.lead("d").over(by.orderBy("d"))
    g = s.withColumns({"next": F.coalesce(after, first), "gap": F.coalesce(after, first + 365) - F.col("d")})
    longest = g.groupBy("taxon").agg(F.max(F.struct("gap", (-F.col("d")).alias("back"), "next")).alias("m"))
    return longest.select("taxon", F.col("m.next").alias("begin_day"), (-F.col("m.back")).alias("end_day"), (366 - F.col("m.gap")).cast("int").alias("length"))


@query("""WITH r AS (SELECT point, report_id, day, row_number() OVER (PARTITION BY point ORDER BY day DESC, report_id DESC) AS k FROM cl JOIN pp USING (observer)),
t AS (SELECT report_id, count(DISTINCT taxon) AS taxa FROM ob GROUP BY report_id)
SELECT point, string_agg(concat(CAST(report_id AS VARCHAR), '@', strftime(day, '%Y-%m-%d'), ':', CAST(coalesce(taxa, 0) AS VARCHAR)), ',' ORDER BY k) AS latest FROM r LEFT JOIN t USING (report_id) WHERE k <= 8 GROUP BY point""")
def place_detail(spark, d):
    """Each point's eight latest checklists with their numbers of taxa. Points are cut to eight before observations are joined."""
    r = checklists(spark, d).join(observers(spark, d).select("observer", "point"), "observer").select("point", "report_id", "day")
    r = top_k(r, ["point"], 8, F.col("day").desc(), F.col("report_id").desc(), rank="k")
    t = observations(spark, d).join(r.select("report_id"), "report_id", "left_semi").groupBy("report_id").agg(F.countDistinct("taxon").alias("taxa"))
    shown = F.concat("report_id", F.lit("@"), day("day"), F.lit(":"), F.coalesce("taxa", F.lit(0)))
    rows = r.join(t, "report_id", "left").groupBy("point").agg(F.sort_array(F.collect_list(F.struct("k", shown.alias("s")))).alias("a"))
    return rows.select("point", F.array_join("a.s", ",").alias("latest"))


@query(f"""WITH p AS (SELECT city, round(lon, 2) AS lon, round(lat, 2) AS lat, count(*) AS observers FROM pp GROUP BY ALL)
SELECT a.city, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2, round({DIAGONAL_SQL.format(n="b.lat", s="a.lat", e="b.lon", w="a.lon")}, 2) AS metres
FROM p a JOIN p b ON a.city = b.city AND (a.lon < b.lon OR (a.lon = b.lon AND a.lat < b.lat)) AND {DIAGONAL_SQL.format(n="b.lat", s="a.lat", e="b.lon", w="a.lon")} <= 12000""")
def near_places(spark, d):
    """Pairs of a city's places within 12 km. Coordinates are rounded and counted once; cells wider than that meet their ring by an equi join."""
    p = observers(spark, d).groupBy("city", F.round("lon", 2).alias("lon"), F.round("lat", 2).alias("lat")).agg(F.count("*").alias("observers"))
    p = p.withColumns({"x": F.floor(F.col("lon") / 0.15), "y": F.floor(F.col("lat") / 0.15)}).drop("observers")
    a = ring(p).select("city", "x", "y", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    b = p.withColumnsRenamed({"lon": "lon2", "lat": "lat2"})
    ahead = (F.col("lon1") < F.col("lon2")) | ((F.col("lon1") == F.col("lon2")) & (F.col("lat1") < F.col("lat2")))
    pairs = a.join(b, ["city", "x", "y"]).filter(ahead).withColumn("m", haversine_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")))
    return pairs.filter("m <= 12000").select("city", "lon1", "lat1", "lon2", "lat2", F.round("m", 2).alias("metres"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2", bound=False)
def stream_daily_counts(spark, d):
    """The feed's daily counts by type, kept as streaming state; reads what is there, then stops."""
    return counted(spark, d).select("day", "event_type", "n")


@query("""WITH r AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, event_id, event_type FROM r WHERE k = 1""", bound=False)
def upsert_latest(spark, d):
    """The last write of each key wins, for all its columns."""
    return latest(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")
