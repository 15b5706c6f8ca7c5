"""Registered queries over seasons on a circle, habitat, terrain, ranks and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.season import circular, season_week
from fieldmark.operators.core import first_by, islands, kernel, smoothed, spread, top_k
from fieldmark.operators.neighbours import chosen, nearest_rows, pools
from fieldmark.operators.places import cell, ring
from fieldmark.plans.checklist_queries import KERNEL_SQL, QUERIES, SQL, WEEK, query
from fieldmark.plans.place_queries import CELL_SQL
from fieldmark.sources.shared import kept
from fieldmark.sources.tables import checklists, observations, observers, table, taxa

STRONG_SQL = f"""w AS (SELECT taxon, {WEEK} AS week, count(*) AS n FROM cl JOIN ob USING (report_id) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY n, week) - 1 AS k, count(*) OVER (PARTITION BY taxon) AS c, max(n) OVER (PARTITION BY taxon) AS peak FROM w),
h AS (SELECT taxon, greatest(0.65::DOUBLE * max(peak), max(n) FILTER (k = CAST(floor((c - 1) * 0.75) AS BIGINT))) AS least FROM o GROUP BY taxon), st AS (SELECT taxon, week FROM w JOIN h USING (taxon) WHERE n + 1e-12 >= least),
g AS (SELECT taxon, week, week - row_number() OVER (PARTITION BY taxon ORDER BY week) AS g FROM st), r AS (SELECT taxon, min(week) AS first, max(week) AS last FROM g GROUP BY taxon, g),
e AS (SELECT *, count(*) OVER (PARTITION BY taxon) > 1 AND min(first) OVER (PARTITION BY taxon) = 1 AND max(last) OVER (PARTITION BY taxon) = 52 AS wraps, max(first) OVER (PARTITION BY taxon) AS late FROM r),
sw AS (SELECT taxon, CAST(CASE WHEN wraps AND first = 1 THEN late ELSE first END AS INT) AS first_week, CAST(last AS INT) AS last_week FROM e WHERE NOT (wraps AND last = 52))"""


def strong_weeks(spark, d):
    """taxon, week of the weeks that reach both 0.65 of the taxon's peak and its upper quartile."""
    n = checklists(spark, d).join(observations(spark, d), "report_id").groupBy("taxon", season_week(F.col("day")).alias("week")).agg(F.count("*").alias("n"))
    of = W.partitionBy("taxon")
    ranked = n.withColumns({"k": F.row_number().over(of.orderBy("n", "week")) - 1, "c": F.count("*").over(of), "peak": F.max("n").over(of)})
    quartile = F.max(F.when(F.col("k") == F.floor((F.col("c") - 1) * 0.75), F.col("n"))).over(of)
    return ranked.withColumn("quartile", quartile).filter(F.col("n") + 1e-12 >= F.greatest(0.65 * F.col("peak"), F.col("quartile"))).select("taxon", "week")


@query(f"WITH {STRONG_SQL} SELECT * FROM sw")
def season_windows_on_circle(spark, d):
    """Each taxon's seasons: runs of strong weeks, where one that ends with week 52 goes on with one that begins with week 1."""
    runs, of = islands(strong_weeks(spark, d), ["taxon"], "week"), W.partitionBy("taxon")
    wraps = (F.count("*").over(of) > 1) & (F.min("begin").over(of) == 1) & (F.max("end").over(of) == 52)
    rows = runs.withColumns({"wraps": wraps, "late": F.max("begin").over(of)}).filter(~(F.col("wraps") & (F.col("end") == 52)))
    return rows.select("taxon", F.when(F.col("wraps") & (F.col("begin") == 1), F.col("late")).otherwise(F.col("begin")).alias("first_week"), F.col("end").alias("last_week"))


@query(f"""WITH {STRONG_SQL}, dy AS (SELECT DISTINCT taxon, unnest(range((week - 1) * 7 + 1, CASE WHEN week = 52 THEN 366 ELSE week * 7 + 1 END)) AS d FROM st),
gp AS (SELECT taxon, d, coalesce(lead(d) OVER v, 365 + min(d) OVER (PARTITION BY taxon)) - d - 1 AS gap, coalesce(lead(d) OVER v, min(d) OVER (PARTITION BY taxon)) AS next FROM dy WINDOW v AS (PARTITION BY taxon ORDER BY d)), rk AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY gap DESC, d) AS k, count(*) OVER (PARTITION BY taxon) AS days FROM gp)
SELECT taxon, CAST(CASE WHEN days = 365 THEN 1 ELSE next END AS INT) AS start_day, CAST(CASE WHEN days = 365 THEN 365 ELSE d END AS INT) AS end_day FROM rk WHERE k = 1""")
def merged_season(spark, d):
    """One season of all of a taxon's windows: everything but the longest stretch of days in none; all year where there is no such stretch."""
    days = strong_weeks(spark, d).select("taxon", F.explode(F.sequence((F.col("week") - 1) * 7 + 1, F.when(F.col("week") == 52, 365).otherwise(F.col("week") * 7))).alias("d"))
    of = W.partitionBy("taxon")
    first, after = F.min("d").over(of), F.lead("d").over(of.orderBy("d"))
    g = days.withColumns({"next": F.coalesce(after, first), "gap": F.coalesce(after, first + 365) - F.col("d") - 1})
    m = g.groupBy("taxon").agg(F.count("*").alias("days"), F.max(F.struct("gap", (-F.col("d")).alias("back"), "next")).alias("m"))
    whole = F.col("days") == 365
    return m.select("taxon", F.when(whole, 1).otherwise(F.col("m.next")).cast("int").alias("start_day"), F.when(whole, 365).otherwise(-F.col("m.back")).cast("int").alias("end_day"))


GROUPS = 5
SHARES_SQL = f"""em AS (SELECT vec_id, label, {", ".join(f"list_sum(list_transform(list_filter(list_zip(embedding, range(64)), lambda x: x[2] % {GROUPS} = {g}), lambda x: abs(x[1]::DOUBLE))) AS a{g}" for g in range(GROUPS))} FROM embeddings),
sh AS (SELECT vec_id, label, {", ".join(f"sqrt(a{g} / ({' + '.join(f'a{h}' for h in range(GROUPS))})) AS s{g}" for g in range(GROUPS))} FROM em)"""
RADIUS, NEAREST, BANDWIDTH, ENOUGH = 0.045, 24, 0.02, 8


def habitat_shares(spark, d):
    """vec_id, label, s0..s4: roots of the shares of five groups of classes, which add up to one."""
    of = lambda g: F.filter(F.transform("embedding", lambda x, i: F.when(i % GROUPS == g, F.abs(x.cast("double")))), lambda x: x.isNotNull())
    sums = [F.aggregate(of(g), F.lit(0.0), lambda a, x: a + x).alias(f"a{g}") for g in range(GROUPS)]
    rows = table(spark, d, "embeddings").select("vec_id", "label", *sums)
    total = sum(F.col(f"a{g}") for g in range(GROUPS))
    return rows.select("vec_id", "label", *[F.sqrt(F.col(f"a{g}") / total).alias(f"s{g}") for g in range(GROUPS)])


@query(f"""WITH {SHARES_SQL}, pr AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, sqrt({" + ".join(f"pow(a.s{g} - b.s{g}, 2)" for g in range(GROUPS))}) / sqrt(2) AS dist FROM sh a JOIN sh b ON a.vec_id <> b.vec_id AND sqrt({" + ".join(f"pow(a.s{g} - b.s{g}, 2)" for g in range(GROUPS))}) / sqrt(2) <= {RADIUS}),
po AS (SELECT *, count(*) FILTER (same) OVER (PARTITION BY a) >= {ENOUGH} AS local FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(dist, 12), b) AS k FROM po WHERE same OR NOT local)
SELECT a, count(*) AS neighbours, max(CAST(local AS INT)) AS local, round(sum(exp(-0.5 * pow(dist / {BANDWIDTH}, 2))), 6) AS weight, CAST(sum(b) AS BIGINT) AS ids FROM rk WHERE k <= {NEAREST} GROUP BY a""", bound=False)
def habitat_neighbours(spark, d):
    """Each cell's 24 nearest cells by Hellinger distance within a radius, of its own label if that has eight of them, else of all,
    with Gaussian weights. Cells meet in grids as fine as each place allows, copies of a vector are asked for once."""
    dims = [f"s{g}" for g in range(GROUPS)]
    rows = habitat_shares(spark, d).withColumns({c: F.col(c) / 2**0.5 for c in dims})
    of = lambda own: nearest_rows(rows, "vec_id", "label", dims, NEAREST, RADIUS, own)
    near = chosen(kept(pools(of(True), of(False)), "habitat-pools"), NEAREST, ENOUGH).withColumn("local", F.col("locals") >= ENOUGH)
    return near.groupBy("a").agg(F.count("*").alias("neighbours"), F.max(F.col("local").cast("int")).alias("local"), F.round(F.sum(F.exp(-0.5 * F.pow(F.col("dist") / BANDWIDTH, 2))), 6).alias("weight"), F.sum("b").alias("ids"))


PIXELS_SQL = f"px AS (SELECT {CELL_SQL}, CASE WHEN observer % 23 <> 0 THEN observer * 7 % 11 END AS class, c_acctbal AS height FROM pp JOIN customer ON c_custkey = observer)"
FRACTIONS_SQL = f"{PIXELS_SQL}, fr AS (SELECT x, y, count(class)::DOUBLE / count(*) AS coverage, {', '.join(f'count(*) FILTER (class = {c})::DOUBLE / nullif(count(class), 0) AS f{c}' for c in range(11))} FROM px GROUP BY x, y)"


def pixels(spark, d):
    """x, y, class (null where invalid), height: a pixel an observer."""
    p = observers(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("observer"), F.col("c_acctbal").alias("height")), "observer")
    return p.select(*cell(), F.when(F.col("observer") % 23 != 0, F.col("observer") * 7 % 11).alias("class"), "height")


def fractions(spark, d):
    """x, y, coverage, f0..f10: shares of the classes among valid pixels; all in one aggregate."""
    valid = F.count("class")
    return pixels(spark, d).groupBy("x", "y").agg((valid / F.count("*")).alias("coverage"), *[F.try_divide(F.count_if(F.col("class") == c), valid).alias(f"f{c}") for c in range(11)])


@query(f"WITH {FRACTIONS_SQL} SELECT x, y, round(coverage, 6) AS coverage, coverage >= 0.9 AS usable, {', '.join(f'round(f{c}, 6) AS f{c}' for c in range(11))} FROM fr")
def land_cover(spark, d):
    f = fractions(spark, d)
    return f.select("x", "y", F.round("coverage", 6).alias("coverage"), (F.col("coverage") >= 0.9).alias("usable"), *[F.round(f"f{c}", 6).alias(f"f{c}") for c in range(11)])


@query(f"""WITH {FRACTIONS_SQL} SELECT x, y, CASE WHEN f8 + f9 + f10 >= 0.25 THEN 'water' WHEN f5 >= 0.3 THEN 'urban' WHEN f1 >= 0.5 THEN 'forest' WHEN f4 >= 0.4 THEN 'cropland' WHEN f2 + f3 + f6 + f7 + f0 >= 0.5 THEN 'open' ELSE 'mixed' END AS habitat FROM fr WHERE coverage > 0""")
def habitat_class(spark, d):
    """The class of each cell's habitat: the first rule of a cascade over its land cover that holds."""
    c = lambda *n: sum((F.col(f"f{k}") for k in n[1:]), F.col(f"f{n[0]}"))
    rules = F.when(c(8, 9, 10) >= 0.25, "water").when(c(5) >= 0.3, "urban").when(c(1) >= 0.5, "forest").when(c(4) >= 0.4, "cropland").when(c(2, 3, 6, 7, 0) >= 0.5, "open").otherwise("mixed")
    return fractions(spark, d).filter("coverage > 0").select("x", "y", rules.alias("habitat"))


@query(f"""WITH {FRACTIONS_SQL}, rg AS (SELECT a.x, a.y, {', '.join(f'sum(b.coverage * b.f{c}) / sum(b.coverage) AS r{c}' for c in range(11))} FROM fr a JOIN fr b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND b.coverage > 0 GROUP BY a.x, a.y)
SELECT x, y, round(r1, 6) AS forest, round(r5, 6) AS urban, round(-({' + '.join(f'CASE WHEN r{c} > 0 THEN r{c} * ln(r{c}) ELSE 0 END' for c in range(11))}) / ln(11), 6) + 0.0 AS entropy FROM rg""")
def ring_composition(spark, d):
    """Land cover of each cell and its ring, weighted by coverage, and how mixed it is (entropy, 1: all classes alike). Cells hand their sums to their neighbours."""
    f = fractions(spark, d)
    given = ring(f.filter("coverage > 0")).groupBy("x", "y").agg(*[(F.sum(F.col("coverage") * F.col(f"f{c}")) / F.sum("coverage")).alias(f"r{c}") for c in range(11)])
    entropy = -sum((F.when(F.col(f"r{c}") > 0, F.col(f"r{c}") * F.log(F.col(f"r{c}"))).otherwise(0.0) for c in range(11)), F.lit(0.0)) / F.log(F.lit(11.0))
    return given.join(f.select("x", "y"), ["x", "y"], "left_semi").select("x", "y", F.round("r1", 6).alias("forest"), F.round("r5", 6).alias("urban"), (F.round(entropy, 6) + 0.0).alias("entropy"))


TERRAIN_SQL = f"{PIXELS_SQL}, te AS (SELECT x, y, count(*) AS samples, avg(height) AS mean, stddev_pop(height) AS spread FROM px GROUP BY x, y)"


@query(f"WITH {TERRAIN_SQL} SELECT x, y, samples, CASE WHEN samples >= 4 THEN round(mean, 4) END AS mean, CASE WHEN samples >= 4 THEN round(spread, 4) END AS spread FROM te")
def terrain(spark, d):
    """Mean and spread of the heights in each cell; null where there are too few samples."""
    t = pixels(spark, d).groupBy("x", "y").agg(F.count("*").alias("samples"), F.avg("height").alias("mean"), F.stddev_pop("height").alias("spread"))
    return t.select("x", "y", "samples", *[F.when(F.col("samples") >= 4, F.round(c, 4)).alias(c) for c in ("mean", "spread")])


@query(f"""WITH {TERRAIN_SQL}, nb AS (SELECT a.x, a.y, count(*) AS n, sum((b.x - a.x) * (CASE WHEN b.y = a.y THEN 2 ELSE 1 END) * b.mean) / 8 / 100.0 AS gx, sum((b.y - a.y) * (CASE WHEN b.x = a.x THEN 2 ELSE 1 END) * b.mean) / 8 / 100.0 AS gy FROM te a JOIN te b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y)
SELECT x, y, round(degrees(atan(sqrt(gx * gx + gy * gy))), 4) AS slope FROM nb WHERE n = 9""")
def horn_slope(spark, d, spacing: float = 100.0):
    """Slope by Horn's weights over the nine cells around; where one is missing there is none. Heights are handed to the neighbours with their weights and summed."""
    t = pixels(spark, d).groupBy("x", "y").agg(F.avg("height").alias("mean")).withColumns({"x0": F.col("x"), "y0": F.col("y")})
    dx, dy = F.col("x0") - F.col("x"), F.col("y0") - F.col("y")
    twice = lambda k: F.when(k == 0, 2).otherwise(1)
    g = ring(t).groupBy("x", "y").agg(F.count("*").alias("n"), F.max(((dx == 0) & (dy == 0)).cast("int")).alias("own"), (F.sum(dx * twice(dy) * F.col("mean")) / 8 / spacing).alias("gx"), (F.sum(dy * twice(dx) * F.col("mean")) / 8 / spacing).alias("gy"))
    return g.filter("n = 9 AND own = 1").select("x", "y", F.round(F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))), 4).alias("slope"))


@query(f"""WITH w AS (SELECT city, {WEEK} AS week, count(*) AS lists, count(DISTINCT observer) AS observers, list(DISTINCT year(day)) AS years FROM cl JOIN pp USING (observer) GROUP BY 1, 2), a AS (SELECT *, CASE WHEN week = 52 THEN 361.5 ELSE week * 7 - 3 END AS mid FROM w), k AS (SELECT *, least(abs(10 - mid), 365 - abs(10 - mid)) AS far FROM a)
SELECT city, round(sum(lists * exp(-0.5 * pow(far / 14.0, 2))), 6) AS support, max(observers) AS observers, array_to_string(list_sort(list_distinct(flatten(list(years)))), ',') AS years FROM k WHERE far <= 49 GROUP BY city""")
def support_near_day(spark, d, at: int = 10, bandwidth: float = 14.0):
    """Smoothed checklists around a day of the year, the most observers of a week in reach, and the years of all of them."""
    w = checklists(spark, d).join(observers(spark, d).select("observer", "city"), "observer").groupBy("city", season_week(F.col("day")).alias("week")).agg(F.count("*").alias("lists"), F.countDistinct("observer").alias("observers"), F.collect_set(F.year("day")).alias("years"))
    far = circular(F.lit(float(at)), F.when(F.col("week") == 52, 361.5).otherwise(F.col("week") * 7 - 3.0), 365)
    k = w.withColumn("far", far).filter(F.col("far") <= 3.5 * bandwidth)
    years = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))), ",")
    return k.groupBy("city").agg(F.round(F.sum(F.col("lists") * F.exp(-0.5 * F.pow(F.col("far") / bandwidth, 2))), 6).alias("support"), F.max("observers").alias("observers"), years.alias("years"))


@query("""WITH r AS (SELECT report_id, taxon, idx, n, CASE WHEN red THEN 2 WHEN n >= 25 THEN 1 ELSE 0 END AS gain FROM ob), k AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY n DESC, idx, taxon, gain) AS k, row_number() OVER (PARTITION BY report_id ORDER BY gain DESC) AS ideal FROM r),
g AS (SELECT report_id, sum(CASE WHEN k <= 10 THEN (pow(2, gain) - 1) / log2(k + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, gain) - 1) / log2(ideal + 1) ELSE 0 END) AS best FROM k GROUP BY report_id)
SELECT report_id, round(dcg, 6) AS dcg, round(dcg / best, 6) AS ndcg FROM g WHERE best > 0""")
def graded_ndcg(spark, d):
    """Discounted gain of the first ten of each checklist's ranking with graded gains, and its share of the best order's."""
    r = observations(spark, d).withColumn("gain", F.when(F.col("red"), 2).when(F.col("n") >= 25, 1).otherwise(0))
    by = W.partitionBy("report_id")
    k = r.withColumns({"k": F.row_number().over(by.orderBy(F.col("n").desc(), "idx", "taxon", "gain")), "ideal": F.row_number().over(by.orderBy(F.col("gain").desc()))})
    dcg = lambda at: F.sum(F.when(F.col(at) <= 10, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col(at) + 1)).otherwise(0.0))
    return k.groupBy("report_id").agg(dcg("k").alias("dcg"), dcg("ideal").alias("best")).filter("best > 0").select("report_id", F.round("dcg", 6).alias("dcg"), F.round(F.col("dcg") / F.col("best"), 6).alias("ndcg"))


@query("""WITH t AS (SELECT point, count(*) AS lists, count(DISTINCT observer) AS observers, (sum(CASE WHEN state = 'F' THEN 1 ELSE 0 END) + 1)::DOUBLE / (count(*) + 2) AS p FROM cl JOIN pp USING (observer) GROUP BY point), w AS (SELECT *, 3.29 * sqrt(p * (1 - p) / (lists + 3)) AS width FROM t)
SELECT point, CASE WHEN p >= 0.5 THEN 'very_high' WHEN p >= 0.25 THEN 'high' WHEN p >= 0.1 THEN 'medium' WHEN p >= 0.03 THEN 'low' ELSE 'very_low' END AS probability, CASE WHEN lists >= 100 AND observers >= 15 AND width <= 0.15 THEN 'high' WHEN lists >= 30 AND observers >= 5 AND width <= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM w""")
def score_levels(spark, d):
    """How likely a finished list is at each point and how sure that is, in words."""
    p = checklists(spark, d).join(observers(spark, d), "observer").groupBy("point").agg(F.count("*").alias("lists"), F.countDistinct("observer").alias("observers"), ((F.count_if(F.col("state") == "F") + 1) / (F.count("*") + 2)).alias("p"))
    p = p.withColumn("width", 3.29 * F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("lists") + 3)))
    level = F.when(F.col("p") >= 0.5, "very_high").when(F.col("p") >= 0.25, "high").when(F.col("p") >= 0.1, "medium").when(F.col("p") >= 0.03, "low").otherwise("very_low")
    sure = lambda lists, who, wide: (F.col("lists") >= lists) & (F.col("observers") >= who) & (F.col("width") <= wide)
    return p.select("point", level.alias("probability"), F.when(sure(100, 15, 0.15), "high").when(sure(30, 5, 0.3), "medium").otherwise("low").alias("confidence"))


@query("""WITH s AS (SELECT * FROM ob WHERE report_id % 3 <> 0), t AS (SELECT * FROM ob WHERE report_id % 3 = 0 AND idx <> 6), b AS (SELECT * FROM s UNION ALL SELECT * FROM t)
SELECT (SELECT count(*) FROM (SELECT * FROM ob EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM ob)) AS added""")
def split_restored(spark, d):
    """Whether the parts of a split are the whole again, repeats included: rows that are missing and rows that are too many."""
    o = observations(spark, d)
    b = o.filter("report_id % 3 <> 0").unionByName(o.filter("report_id % 3 = 0 AND idx <> 6"))
    side = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias(n))
    return side(o, b, "missing").crossJoin(F.broadcast(side(b, o, "added")))


@query("""WITH g AS (SELECT taxon FROM ob GROUP BY taxon ORDER BY count(*) DESC, taxon LIMIT 160), c AS (SELECT DISTINCT city FROM pp), s AS (SELECT city, taxon FROM c, g UNION SELECT DISTINCT city, taxon FROM cl JOIN ob USING (report_id) JOIN pp USING (observer))
SELECT city, count(*) AS candidates, count(*) FILTER (taxon IN (SELECT taxon FROM g)) AS common FROM s GROUP BY city""")
def candidate_taxa(spark, d, most: int = 160):
    """Taxa that are scored for a city: the most frequent ones of all, and those that were seen in it."""
    o = observations(spark, d)
    common = o.groupBy("taxon").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "taxon").limit(most).select("taxon")
    cities = observers(spark, d).select("city").distinct()
    seen = checklists(spark, d).join(o, "report_id").join(observers(spark, d).select("observer", "city"), "observer").select("city", "taxon").distinct()
    # 160 rows at most: broadcast to the cities.
    rows = cities.crossJoin(F.broadcast(common)).unionByName(seen).distinct().join(F.broadcast(common.withColumn("known", F.lit(1))), "taxon", "left")
    return rows.groupBy("city").agg(F.count("*").alias("candidates"), F.count("known").alias("common"))


@query("""WITH f AS (SELECT DISTINCT year(day) AS fold FROM cl), n AS (SELECT year(day) AS fold, count(*) AS lists FROM cl GROUP BY 1)
SELECT concat_ws('+', a.fold, b.fold, c.fold) AS folds, CAST(x.lists + y.lists + z.lists AS BIGINT) AS lists FROM f a JOIN f b ON a.fold < b.fold JOIN f c ON b.fold < c.fold JOIN n x ON x.fold = a.fold JOIN n y ON y.fold = b.fold JOIN n z ON z.fold = c.fold""")
def fold_combinations(spark, d):
    """All choices of three years and their numbers of checklists; years are counted first, one row each."""
    n = checklists(spark, d).groupBy(F.year("day").alias("fold")).agg(F.count("*").alias("lists"))
    a, b, c = (n.select(F.col("fold").alias(f"f{k}"), F.col("lists").alias(f"n{k}")) for k in range(3))
    rows = a.join(F.broadcast(b), F.col("f0") < F.col("f1")).join(F.broadcast(c), F.col("f1") < F.col("f2"))
    return rows.select(F.concat_ws("+", "f0", "f1", "f2").alias("folds"), (F.col("n0") + F.col("n1") + F.col("n2")).alias("lists"))


@query(f"""SELECT t.city, t.week, t.rank, t.taxon, x.name, t.score FROM ({SQL["weekly_top_taxa"]}) t JOIN (SELECT p_partkey AS taxon, p_name AS name FROM part) x USING (taxon) WHERE t.week = 20""", bound=False)
def forward_lookup(spark, d, week: int = 20):
    """What is forecast for a week everywhere, with the taxa's names."""
    return QUERIES["weekly_top_taxa"](spark, d).filter(F.col("week") == week).join(taxa(spark, d).select("taxon", "name"), "taxon").select("city", "week", "rank", "taxon", "name", "score")


@query("""WITH g AS (SELECT city, CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y, point, observer, lon FROM pp), c AS (SELECT observer, count(*) AS lists FROM cl GROUP BY observer), k AS (SELECT city, x, y, point, count(*) AS members, max(lon) - min(lon) > 0.5 AS wide, sum(coalesce(lists, 0)) < 20 AS thin FROM g LEFT JOIN c USING (observer) GROUP BY ALL)
SELECT city, x, y, point, members, concat_ws(',', CASE WHEN wide THEN 'wide' END, CASE WHEN thin THEN 'thin' END) AS reasons FROM k WHERE members >= 2 AND (wide OR thin)""")
def rejected_aliases(spark, d):
    """Groups of places of one name that aren't taken for one, with the reasons."""
    c = checklists(spark, d).groupBy("observer").agg(F.count("*").alias("lists"))
    g = observers(spark, d).select("city", "point", "observer", "lon", *cell(1)).join(c, "observer", "left")
    k = g.groupBy("city", "x", "y", "point").agg(F.count("*").alias("members"), (F.max("lon") - F.min("lon") > 0.5).alias("wide"), (F.sum(F.coalesce("lists", F.lit(0))) < 20).alias("thin")).filter("members >= 2 AND (wide OR thin)")
    return k.select("city", "x", "y", "point", "members", F.concat_ws(",", F.when(F.col("wide"), "wide"), F.when(F.col("thin"), "thin")).alias("reasons"))


@query("""WITH v AS (SELECT point, concat(city, '/', state) AS variant, count(*) AS reports FROM cl JOIN pp USING (observer) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY reports DESC, variant) AS k, sum(reports) OVER (PARTITION BY point) AS total FROM v)
SELECT point, variant, reports, round(reports * 1.0 / total, 6) AS share FROM r WHERE k = 1""")
def dominant_variant(spark, d):
    """The variant of each point that most reports have, and its share."""
    v = checklists(spark, d).join(observers(spark, d), "observer").groupBy("point", F.concat("city", F.lit("/"), "state").alias("variant")).agg(F.count("*").alias("reports"))
    v = v.withColumn("total", F.sum("reports").over(W.partitionBy("point")))
    return first_by(v, ["point"], F.col("reports").desc(), F.col("variant")).select("point", "variant", "reports", F.round(F.col("reports") / F.col("total"), 6).alias("share"))


@query(f"""WITH ov AS (SELECT observer, {CELL_SQL} FROM pp), rs AS (SELECT DISTINCT x, y FROM ov WHERE substr(sha256(concat(CAST(x AS VARCHAR), ':', CAST(y AS VARCHAR))), 1, 1) IN ('0', '1'))
SELECT taxon, count(DISTINCT CASE WHEN observer % 10 > 0 THEN observer END) AS known FROM cl JOIN ob USING (report_id) JOIN ov USING (observer) WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.x = ov.x AND rs.y = ov.y) GROUP BY taxon""")
def development_counts(spark, d):
    """How many known observers report each taxon outside the reserved cells."""
    o = observers(spark, d).select("observer", *cell())
    reserved = o.select("x", "y").distinct().filter(F.substring(F.sha2(F.concat_ws(":", "x", "y"), 256), 1, 1).isin("0", "1"))
    rows = checklists(spark, d).join(o.join(reserved, ["x", "y"], "left_anti"), "observer").join(observations(spark, d), "report_id")
    return rows.groupBy("taxon").agg(F.countDistinct(F.when(F.col("observer") % 10 > 0, F.col("observer"))).alias("known"))


@query("""WITH e AS (SELECT taxon, day, n, CASE WHEN day - lag(day) OVER (PARTITION BY taxon ORDER BY day) <= 3 THEN 0 ELSE 1 END AS fresh FROM (SELECT taxon, day, count(*) AS n FROM cl JOIN ob USING (report_id) GROUP BY taxon, day)), v AS (SELECT taxon, day, n, sum(fresh) OVER (PARTITION BY taxon ORDER BY day) AS event FROM e),
s AS (SELECT taxon, event, sum(n) AS n, min(year(day)) AS y FROM v GROUP BY taxon, event), t AS (SELECT taxon, count(*) AS events, CAST(max(n) AS BIGINT) AS largest, CAST(sum(n) AS BIGINT) AS records, count(DISTINCT y) AS years FROM s GROUP BY taxon)
SELECT taxon, events, years, round(largest * 1.0 / records, 6) AS dominant, CASE WHEN years = 1 THEN 'one year' WHEN largest * 1.0 / records >= 0.8 THEN 'dominant' ELSE '' END AS reason FROM t""")
def event_summary(spark, d):
    """Each taxon's occurrence events (days at most three apart), the share of the largest, and why it may be a vagrant. Reads all observations."""
    rows = spread(checklists(spark, d).join(observations(spark, d), "report_id").select("taxon", "day"), observations(spark, d), "taxon")
    days = rows.groupBy("taxon", "day").agg(F.count("*").alias("n"))
    by = W.partitionBy("taxon").orderBy("day")
    fresh = F.when(F.datediff("day", F.lag("day").over(by)) <= 3, 0).otherwise(1)
    v = days.withColumn("fresh", fresh).withColumn("event", F.sum("fresh").over(by))
    s = v.groupBy("taxon", "event").agg(F.sum("n").alias("n"), F.min(F.year("day")).alias("y"))
    y = s.groupBy("taxon", "y").agg(F.count("*").alias("events"), F.max("n").alias("most"), F.sum("n").alias("n"))
    t = y.groupBy("taxon").agg(F.sum("events").alias("events"), F.count("y").alias("years"), (F.max("most") / F.sum("n")).alias("share"))
    return t.select("taxon", "events", "years", F.round("share", 6).alias("dominant"), F.when(F.col("years") == 1, "one year").when(F.col("share") >= 0.8, "dominant").otherwise("").alias("reason"))


@query(f"""WITH wl AS (SELECT report_id, city, {WEEK} AS week FROM cl JOIN pp USING (observer)), ex AS (SELECT city, week, CAST(count(*) AS DOUBLE) AS e FROM wl GROUP BY 1, 2), de AS (SELECT city, week, family, CAST(count(DISTINCT report_id) AS DOUBLE) AS k FROM wl JOIN ob USING (report_id) JOIN tx USING (taxon) GROUP BY 1, 2, 3), {KERNEL_SQL},
se AS (SELECT city, target, sum(e * w) AS e FROM ex JOIN kn USING (week) GROUP BY 1, 2), sd AS (SELECT city, family, target, sum(k * w) AS k FROM de JOIN kn USING (week) GROUP BY 1, 2, 3), sc AS (SELECT city, family, target AS week, (k + 1) / (e + 2) AS p FROM sd JOIN se USING (city, target)), pk AS (SELECT family, city, max(round(p, 9)) AS peak FROM sc GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY peak DESC, city) AS rank FROM pk)
SELECT family, city, round(peak, 6) AS peak, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 3""")
def reverse_hotspots(spark, d):
    """Where each family is most likely to be found in its best week: the three cities with the highest smoothed chance."""
    wl = checklists(spark, d).join(observers(spark, d).select("observer", "city"), "observer").select("report_id", "city", season_week(F.col("day")).alias("week"))
    seen = observations(spark, d).join(taxa(spark, d).select("taxon", "family"), "taxon").select("report_id", "family").distinct()
    k = kernel(spark)
    e = smoothed(wl.groupBy("city", "week").agg(F.count("*").cast("double").alias("e")), k, ["city"], "week", "e")
    s = smoothed(wl.join(seen, "report_id").groupBy("city", "week", "family").agg(F.count("*").cast("double").alias("k")), k, ["city", "family"], "week", "k")
    peaks = s.join(e, ["city", "target"]).groupBy("family", "city").agg(F.max(F.round((F.col("k") + 1) / (F.col("e") + 2), 9)).alias("peak"))
    return top_k(peaks, ["family"], 3, F.col("peak").desc(), F.col("city")).select("family", "city", F.round("peak", 6).alias("peak"), "rank")
