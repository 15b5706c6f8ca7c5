"""Registered queries over occurrence events and reverse hotspots, and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions.season import season_week
from fieldmark.operators import events, hotspots
from fieldmark.operators.core import first_by, kernel, smoothed
from fieldmark.operators.places import cell
from fieldmark.plans.checklist_queries import KERNEL_SQL, WEEK, day, query
from fieldmark.sources.shared import kept
from fieldmark.sources.tables import BINDING, checklists, observations, observers, table, taxa

DETECTIONS_SQL = f"""{BINDING}, det AS (SELECT taxon, report_id, idx, CAST(observer AS VARCHAR) AS observer, day, CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y, n / 50 AS weight FROM cl JOIN ob USING (report_id) JOIN pp USING (observer)),
ev AS (SELECT taxon, observer, day, x, y, concat_ws(':', taxon, date_diff('day', DATE '1970-01-01', day), x, y) AS id, count(*) AS raw, min(report_id) AS report, sum(weight) AS weight FROM det GROUP BY ALL),
bk AS (SELECT DISTINCT taxon, day, x, y, id FROM ev), ln AS (SELECT a.id, b.id AS other FROM bk a JOIN bk b ON a.taxon = b.taxon AND abs(date_diff('day', a.day, b.day)) <= 3 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.id <> b.id),
rc AS (SELECT id, id AS reach FROM bk UNION SELECT rc.id, ln.other FROM rc JOIN ln ON ln.id = rc.reach), cp AS (SELECT id, min(reach) AS event FROM rc GROUP BY id), ce AS (SELECT ev.*, event FROM ev JOIN cp USING (id)),
be AS (SELECT taxon, event, min(day) AS s, max(day) AS e, count(*) AS independent, sum(raw) AS raw, count(DISTINCT observer) AS observers, count(DISTINCT (x, y)) AS cells, min((x, y)) AS f, min(report) AS report, sum(weight) AS weight FROM ce GROUP BY ALL),
tt AS (SELECT taxon, sum(raw) AS raw, sum(independent) AS independent, count(*) AS events, max(independent) / sum(independent) AS share FROM be GROUP BY taxon), ty AS (SELECT taxon, count(DISTINCT observer) AS observers, list_sort(list(DISTINCT year(day))) AS years FROM ce GROUP BY taxon),
tx2 AS (SELECT *, share >= 0.8 AS dominated, len(years) = 1 AS one_year FROM tt JOIN ty USING (taxon)),
ne AS (SELECT be.*, row_number() OVER (PARTITION BY be.taxon ORDER BY s, e, f, be.report) AS number, CASE WHEN (dominated OR one_year) AND weight > 1 THEN 1 / weight ELSE 1.0 END AS multiplier FROM be JOIN tx2 USING (taxon))"""


def detections(spark, d):
    """taxon, report_id, idx, observer, day, x, y, weight: cells are a degree wide, so that events have neighbours."""
    rows = checklists(spark, d).join(observers(spark, d), "observer").join(observations(spark, d), "report_id")
    return rows.select("taxon", "report_id", "idx", "observer", "day", *cell(1), (F.col("n") / 50).alias("weight"))


def evidence(spark, d):
    return kept(events.clustered(events.independent(detections(spark, d))), "evidence")


@query(f"""WITH RECURSIVE {DETECTIONS_SQL} SELECT taxon, number, strftime(s, '%Y-%m-%d') AS first_day, strftime(e, '%Y-%m-%d') AS last_day, independent, CAST(raw AS BIGINT) AS raw, observers, cells, round(weight, 6) AS weight, round(multiplier, 6) AS multiplier FROM ne""", bound=False)
def event_clusters(spark, d):
    """Each taxon's occurrence events: detections at most three days and one ring of cells apart chain, numbered by date and cell, with the factor that caps their weight."""
    rows = evidence(spark, d)
    out = events.numbered_events(rows, events.taxon_events(rows))
    return out.select("taxon", "number", day("start").alias("first_day"), day("end").alias("last_day"), "independent", "raw", "observers", "cells", F.round("weight", 6).alias("weight"), F.round("multiplier", 6).alias("multiplier"))


@query(f"""WITH RECURSIVE {DETECTIONS_SQL} SELECT taxon, CAST(raw AS BIGINT) AS raw, CAST(independent AS BIGINT) AS independent, observers, events, array_to_string(years, ',') AS years, round(share, 6) AS share, dominated OR one_year AS candidate,
CASE WHEN dominated AND one_year THEN 'event_dominated_and_single_support_year' WHEN dominated THEN 'event_dominated' WHEN one_year THEN 'single_support_year' END AS reason FROM tx2""", bound=False)
def event_taxa(spark, d):
    """Each taxon's evidence, events and years, the share of its largest event, and why it may be a vagrant."""
    return events.taxon_events(evidence(spark, d)).select("taxon", "raw", "independent", "observers", "events", F.array_join("years", ",").alias("years"), F.round("share", 6).alias("share"), "candidate", "reason")


@query(f"""WITH RECURSIVE {DETECTIONS_SQL} SELECT d.report_id, d.taxon, d.idx, ne.number AS event, round(d.weight * multiplier, 6) AS weight FROM det d JOIN ce ON ce.taxon = d.taxon AND ce.observer = d.observer AND ce.day = d.day AND ce.x = d.x AND ce.y = d.y JOIN ne ON ne.taxon = ce.taxon AND ne.event = ce.event""", bound=False)
def event_weights(spark, d):
    """The weight of each detection once events of likely vagrants are capped."""
    rows = evidence(spark, d)
    found = kept(events.numbered_events(rows, events.taxon_events(rows)), "events")
    return events.weighed(detections(spark, d), rows, found).select("report_id", "taxon", "idx", F.col("number").alias("event"), F.round("effective", 6).alias("weight"))


HALF = 2  # cells a degree
CANDIDATES_SQL = f"""{BINDING}, pu AS (SELECT observer, 'grid' AS level, concat(CAST(floor(lon * {HALF}) AS BIGINT), ':', CAST(floor(lat * {HALF}) AS BIGINT)) AS unit FROM pp UNION ALL SELECT observer, 'city', CAST(city AS VARCHAR) FROM pp),
wl AS (SELECT report_id, level, unit, {WEEK} AS week FROM cl JOIN pu USING (observer)), {KERNEL_SQL}, xe AS (SELECT level, unit, week, CAST(count(*) AS DOUBLE) AS e FROM wl GROUP BY ALL), xd AS (SELECT level, unit, week, family AS taxon, CAST(count(DISTINCT report_id) AS DOUBLE) AS k FROM wl JOIN ob USING (report_id) JOIN tx USING (taxon) GROUP BY ALL),
se AS (SELECT level, unit, target, sum(e * w) AS e FROM xe JOIN kn USING (week) GROUP BY ALL), sd AS (SELECT level, unit, taxon, target, sum(k * w) AS k FROM xd JOIN kn USING (week) GROUP BY ALL), sc AS (SELECT level, unit, taxon, target AS week, round((k + 1) / (e + 2), 9) AS score FROM sd JOIN se USING (level, unit, target)),
so AS (SELECT *, row_number() OVER (PARTITION BY taxon, level, unit ORDER BY score, week) - 1 AS k, count(*) OVER (PARTITION BY taxon, level, unit) AS c FROM sc), sh AS (SELECT taxon, level, unit, greatest(0.65::DOUBLE * max(score), max(score) FILTER (k = CAST(floor((c - 1) * 0.75) AS BIGINT))) AS least FROM so GROUP BY ALL), st AS (SELECT taxon, level, unit, week, score FROM sc JOIN sh USING (taxon, level, unit) WHERE score + 1e-12 >= least),
sg AS (SELECT *, week - row_number() OVER (PARTITION BY taxon, level, unit ORDER BY week) AS g FROM st), sr AS (SELECT taxon, level, unit, g, min(week) AS b, max(week) AS e FROM sg GROUP BY ALL), sw AS (SELECT *, count(*) OVER v > 1 AND min(b) OVER v = 1 AND max(e) OVER v = 52 AS wraps, max(b) OVER v AS late, min(e) OVER v AS early FROM sr WINDOW v AS (PARTITION BY taxon, level, unit)),
wn AS (SELECT taxon, level, unit, CASE WHEN wraps AND b = 1 THEN late ELSE b END AS b, CASE WHEN wraps AND b = late THEN early ELSE e END AS e, arg_max(week, (score, -week)) AS best, max(score) AS score FROM sg JOIN sw USING (taxon, level, unit, g) GROUP BY ALL),
cd AS (SELECT concat_ws('|', taxon, level, unit, s, e) AS id, * FROM (SELECT taxon, level, unit, (b - 1) * 7 + 1 AS s, CASE WHEN e = 52 THEN 365 ELSE e * 7 END AS e, CASE WHEN best = 52 THEN 361 ELSE best * 7 - 3 END AS peak, score, CASE WHEN level = 'grid' THEN CAST(split_part(unit, ':', 1) AS BIGINT) END AS x, CASE WHEN level = 'grid' THEN CAST(split_part(unit, ':', 2) AS BIGINT) END AS y FROM wn)),
ln AS (SELECT a.id, b.id AS other FROM cd a JOIN cd b ON a.taxon = b.taxon AND a.level = b.level AND a.id <> b.id AND (a.unit = b.unit OR abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)
  AND ((b.s - a.e + 365) % 365 <= 7 OR (a.s - b.e + 365) % 365 <= 7 OR (b.s - a.s + 365) % 365 <= (a.e - a.s + 365) % 365 OR (a.s - b.s + 365) % 365 <= (b.e - b.s + 365) % 365)),
rc AS (SELECT id, id AS reach FROM cd UNION SELECT rc.id, ln.other FROM rc JOIN ln ON ln.id = rc.reach), sp AS (SELECT id, min(reach) AS spot FROM rc GROUP BY id), cs AS (SELECT cd.*, spot FROM cd JOIN sp USING (id)),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY score DESC, unit, s, e) AS k FROM cs) WHERE k = 1),
dy AS (SELECT DISTINCT spot, (s - 1 + i) % 365 + 1 AS d FROM (SELECT *, unnest(range((e - s + 365) % 365 + 1)) AS i FROM cs)),
gp AS (SELECT spot, d, coalesce(lead(d) OVER v, 365 + min(d) OVER (PARTITION BY spot)) - d - 1 AS gap, coalesce(lead(d) OVER v, min(d) OVER (PARTITION BY spot)) AS next, count(*) OVER (PARTITION BY spot) AS n FROM dy WINDOW v AS (PARTITION BY spot ORDER BY d)),
ms AS (SELECT spot, CASE WHEN n = 365 THEN 1 ELSE next END AS s, CASE WHEN n = 365 THEN 365 ELSE d END AS e FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY gap DESC, d) AS k FROM gp) WHERE k = 1),
hs AS (SELECT bp.taxon, bp.level, bp.unit, ms.s, ms.e, max_by(bp.peak, bp.score) AS peak, max(bp.score) AS score, list(spot) AS spots FROM bp JOIN ms USING (spot) GROUP BY ALL),
bx AS (SELECT city, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM pp GROUP BY city),
mb AS (SELECT h.taxon, h.level, h.unit, h.s, h.e, list_sort(list(DISTINCT c.unit)) AS members, min(CASE WHEN c.level = 'grid' THEN c.x * 1.0::DOUBLE / {HALF} ELSE bx.w END) AS west, min(CASE WHEN c.level = 'grid' THEN c.y * 1.0::DOUBLE / {HALF} ELSE bx.s END) AS south, max(CASE WHEN c.level = 'grid' THEN (c.x + 1) * 1.0::DOUBLE / {HALF} ELSE bx.e END) AS east, max(CASE WHEN c.level = 'grid' THEN (c.y + 1) * 1.0::DOUBLE / {HALF} ELSE bx.n END) AS north
  FROM (SELECT *, unnest(spots) AS spot FROM hs) h JOIN cs c ON c.spot = h.spot LEFT JOIN bx ON c.level = 'city' AND CAST(bx.city AS VARCHAR) = c.unit GROUP BY ALL),
rk AS (SELECT hs.*, members, west, south, east, north, CAST(row_number() OVER (PARTITION BY hs.taxon ORDER BY hs.score DESC, hs.unit, hs.s, hs.e) AS INT) AS rank FROM hs JOIN mb ON mb.taxon = hs.taxon AND mb.level = hs.level AND mb.unit = hs.unit AND mb.s = hs.s AND mb.e = hs.e)"""


def candidates(spark, d):
    """Windows of each family in each cell and city: taxon, level, unit, x, y, start, end, peak_day, score and the unit's box."""
    o = observers(spark, d)
    grid = o.select("observer", F.lit("grid").alias("level"), F.floor(F.col("lon") * HALF).alias("x"), F.floor(F.col("lat") * HALF).alias("y")).withColumn("unit", F.concat_ws(":", "x", "y"))
    units = grid.drop("x", "y").unionByName(o.select("observer", F.lit("city").alias("level"), F.col("city").cast("string").alias("unit")))
    lists = checklists(spark, d).join(units, "observer").select("report_id", "level", "unit", season_week(F.col("day")).alias("week"))
    seen = observations(spark, d).join(taxa(spark, d).select("taxon", F.col("family")), "taxon").select("report_id", F.col("family").alias("taxon")).distinct()
    k = kernel(spark)
    e = smoothed(lists.groupBy("level", "unit", "week").agg(F.count("*").cast("double").alias("e")), k, ["level", "unit"], "week", "e")
    s = smoothed(lists.join(seen, "report_id").groupBy("level", "unit", "week", "taxon").agg(F.count("*").cast("double").alias("k")), k, ["level", "unit", "taxon"], "week", "k")
    scores = s.join(e, ["level", "unit", "target"]).select("taxon", "level", "unit", F.col("target").alias("week"), F.round((F.col("k") + 1) / (F.col("e") + 2), 9).alias("score"))
    found = hotspots.windows(kept(scores, "unit-scores"), ["taxon", "level", "unit"])
    part = lambda i: F.when(F.col("level") == "grid", F.split_part("unit", F.lit(":"), F.lit(i)).cast("bigint"))
    box = o.groupBy(F.col("city").cast("string").alias("of")).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    rows = found.withColumns({"x": part(1), "y": part(2)}).join(box, (F.col("level") == "city") & (F.col("unit") == F.col("of")), "left")
    side = lambda name, c, own: F.coalesce(c / HALF, F.col(own)).alias(name)
    return rows.select("taxon", "level", "unit", "x", "y", "start", "end", "peak_day", "score", side("west", F.col("x"), "w"), side("south", F.col("y"), "s"), side("east", F.col("x") + 1, "e"), side("north", F.col("y") + 1, "n"))


def merged_hotspots(spark, d):
    return kept(hotspots.merged(candidates(spark, d)), "hotspots")


@query(f"""WITH RECURSIVE {CANDIDATES_SQL} SELECT taxon, rank, level, unit, CAST(s AS INT) AS start_day, CAST(e AS INT) AS end_day, CAST(peak AS INT) AS peak_day, round(score, 6) AS score, array_to_string(members, ',') AS members, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM rk WHERE rank <= 300""", bound=False)
def reverse_windows(spark, d):
    """Where and when each family is likely: windows that touch in one unit or in neighbouring cells merged, the best 300 a family."""
    rows = merged_hotspots(spark, d)
    return rows.select("taxon", "rank", "level", "unit", F.col("start").alias("start_day"), F.col("end").alias("end_day"), "peak_day", F.round("score", 6).alias("score"), F.array_join("members", ",").alias("members"), *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


DATE_SQL = "make_date(CAST({year} AS INT), CAST(month(DATE '2001-01-01' + CAST({day} - 1 AS INT)) AS INT), CAST(day(DATE '2001-01-01' + CAST({day} - 1 AS INT)) AS INT))"


@query(f"""WITH RECURSIVE {CANDIDATES_SQL}, nu AS (SELECT 'city' AS level, CAST(n_nationkey AS VARCHAR) AS unit, n_name AS name, n_name AS city_name, r_name AS district FROM nation JOIN region ON n_regionkey = r_regionkey),
gc AS (SELECT concat(CAST(floor(lon * {HALF}) AS BIGINT), ':', CAST(floor(lat * {HALF}) AS BIGINT)) AS unit, city, count(*) AS n FROM pp GROUP BY ALL), gn AS (SELECT 'grid', unit, unit, n_name, r_name FROM (SELECT unit, arg_max(city, (n, -city)) AS city FROM gc GROUP BY unit) JOIN nation ON n_nationkey = city JOIN region ON n_regionkey = r_regionkey),
un AS (SELECT * FROM nu UNION ALL SELECT * FROM gn), fr AS (SELECT rk.*, name, city_name, {DATE_SQL.format(year="2004", day="s")} AS f, {DATE_SQL.format(year="CASE WHEN e < s THEN 2005 ELSE 2004 END", day="e")} AS l, {DATE_SQL.format(year="2004", day="peak")} AS p
  FROM rk JOIN un ON un.level = rk.level AND un.unit = rk.unit WHERE rank <= 300 AND (contains(name, 'IA') OR contains(city_name, 'IA') OR contains(district, 'IA')) AND NOT (s <= e AND e < 330 AND s > 45))
SELECT taxon, level, unit, name, city_name, round(score, 6) AS score, strftime(f, '%Y-%m-%d') AS first_date, strftime(l, '%Y-%m-%d') AS last_date, strftime(p, '%Y-%m-%d') AS peak_date, concat(month(f), '/', day(f), '-', month(l), '/', day(l)) AS label FROM fr""", bound=False)
def hotspot_search(spark, d):
    """Hotspots in winter (day 330 to 45) in regions whose names have "IA" in them, with the dates of a leap year."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    named = lambda level, unit, name: n.select(F.lit(level).alias("level"), unit, name, F.col("n_name").alias("city_name"), F.col("r_name").alias("district"))
    city = named("city", F.col("n_nationkey").cast("string").alias("unit"), F.col("n_name").alias("name"))
    o = observers(spark, d).select(F.concat_ws(":", F.floor(F.col("lon") * HALF), F.floor(F.col("lat") * HALF)).alias("unit"), "city").groupBy("unit", "city").agg(F.count("*").alias("n"))
    most = first_by(o, ["unit"], F.col("n").desc(), F.col("city")).select("unit", "city").join(n, F.col("city") == F.col("n_nationkey"))
    grid = most.select(F.lit("grid").alias("level"), "unit", F.col("unit").alias("name"), F.col("n_name").alias("city_name"), F.col("r_name").alias("district"))
    rows = hotspots.searched(merged_hotspots(spark, d), city.unionByName(grid), name="IA", season=(330, 45), year=2004)
    return rows.select("taxon", "level", "unit", "name", "city_name", F.round("score", 6).alias("score"), day("first_date").alias("first_date"), day("last_date").alias("last_date"), day("peak_date").alias("peak_date"), "label")
