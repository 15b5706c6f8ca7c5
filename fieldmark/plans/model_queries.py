"""Registered queries of the frequency model: out-of-fold evaluation, ranges, evidence caps, calibrators, units and splits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.beta import beta_quantile
from fieldmark.functions.season import band, recency, season_day, season_week
from fieldmark.operators.calibration import calibrator_scope, chosen_families, cross_fitted
from fieldmark.operators.core import first_by, islands, weighted_quantile
from fieldmark.operators.numbering import numbered
from fieldmark.operators.places import cell, split_by_cell
from fieldmark.plans.checklist_queries import NOW, SEASON, WEEK, day, query
from fieldmark.plans.place_queries import CELL_SQL, CELLS_SQL, cells
from fieldmark.sources.tables import checklists, observations, observers, taxa
from fieldmark.streaming.feed import first_notices

FOLDS, QUANTILE, PRIOR, STABLE = 5, 0.9, 20.0, 0.001
CAPS = (0, 10, 25, 50, 100, -1)  # -1: no cap

OOF_SQL = """lf AS (SELECT report_id, city, CAST(year(day) % 5 AS INT) AS fold FROM cl JOIN pp USING (observer)),
ex AS (SELECT city, fold, count(*) AS total FROM lf GROUP BY city, fold),
de AS (SELECT city, fold, family, count(DISTINCT report_id) AS positives FROM lf JOIN ob USING (report_id) JOIN tx USING (taxon) GROUP BY city, fold, family),
gr AS (SELECT city, fold, family, total, coalesce(positives, 0) AS positives FROM ex CROSS JOIN (SELECT DISTINCT family FROM tx) LEFT JOIN de USING (city, fold, family)),
ev AS (SELECT *, CAST(sum(total) OVER (PARTITION BY city, family) - total AS BIGINT) AS e, CAST(sum(positives) OVER (PARTITION BY city, family) - positives AS BIGINT) AS d,
  CAST(sum(total) OVER (PARTITION BY family) - sum(total) OVER (PARTITION BY family, fold) AS BIGINT) AS be, CAST(sum(positives) OVER (PARTITION BY family) - sum(positives) OVER (PARTITION BY family, fold) AS BIGINT) AS bd FROM gr),
oof AS (SELECT *, CAST(d + 1 AS DOUBLE) / CAST(e + 2 AS DOUBLE) AS p, CAST(bd + 1 AS DOUBLE) / CAST(be + 2 AS DOUBLE) AS base FROM ev)"""
METRICS_SQL = """sc AS (SELECT unnest(['all', concat('fold:', fold), concat('family:', family)]) AS scope, * FROM oof),
bn AS (SELECT scope, least(9, floor(p * 10)) AS bin, count(*) AS n, sum(total) AS t, sum(positives) AS k, sum(total * p) AS tp,
  sum(positives * pow(1 - p, 2) + (total - positives) * pow(p, 2)) AS loss, sum(positives * pow(1 - base, 2) + (total - positives) * pow(base, 2)) AS base_loss FROM sc GROUP BY 1, 2),
me AS (SELECT scope, CAST(sum(n) AS BIGINT) AS n, round(sum(loss) / sum(t), 6) AS brier, round(1 - sum(loss) / sum(base_loss), 6) AS skill, round(sum(abs(tp - k)) / sum(t), 6) AS ece, round((sum(tp) - sum(k)) / sum(t), 6) AS bias FROM bn GROUP BY scope)"""
WIDTHS_SQL = """gp AS (SELECT *, abs(CAST(positives AS DOUBLE) / total - p) AS res, sum(positives) OVER (PARTITION BY family) AS seen FROM oof),
sd AS (SELECT unnest([concat('family:', family), concat('group:', (CASE WHEN seen >= 150 THEN 1 ELSE 0 END) + (CASE WHEN seen >= 200 THEN 1 ELSE 0 END) + (CASE WHEN seen >= 250 THEN 1 ELSE 0 END)), 'global']) AS scope, family, fold, res, total FROM gp),
cw AS (SELECT *, sum(total) OVER (PARTITION BY scope, fold ORDER BY res) AS c, sum(total) OVER (PARTITION BY scope, fold) AS t FROM sd),
wq AS (SELECT scope, fold, min(res) AS res FROM cw WHERE CAST(c AS DOUBLE) >= CAST(0.9 AS DOUBLE) * CAST(t AS DOUBLE) GROUP BY scope, fold)"""
CROSS_SQL = """hw AS (SELECT s.family, s.fold, least(1.0, max(q.res)) AS half FROM (SELECT DISTINCT scope, family, fold FROM sd) s JOIN wq q ON q.scope = s.scope AND q.fold <> s.fold GROUP BY s.family, s.fold)"""
CAPS_SQL = f"""cp AS (SELECT *, unnest([{", ".join(map(str, CAPS))}]) AS cap FROM oof),
cs AS (SELECT family, fold, cap, total, positives, ((CAST(bd + 1 AS DOUBLE) / (be + 2)) * 20.0::DOUBLE + CASE WHEN cap < 0 OR e <= cap THEN d ELSE CAST(d AS DOUBLE) * cap / e END) / (20.0::DOUBLE + CASE WHEN cap < 0 OR e <= cap THEN e ELSE cap END) AS p FROM cp),
cf AS (SELECT family, fold, cap, sum(total) AS t, sum(positives * pow(1 - p, 2) + (total - positives) * pow(p, 2)) AS loss FROM cs GROUP BY family, fold, cap)"""


def out_of_fold(spark, d):
    """city, fold, family, total, positives, and from the other folds: the city's e, d, the widest be, bd, and the chances p, base.

    A row for each city and fold with checklists and each family: that grid is what the scores are about.
    """
    lists = checklists(spark, d).join(observers(spark, d).select("observer", "city"), "observer").select("report_id", "city", (F.year("day") % FOLDS).cast("int").alias("fold"))
    families = taxa(spark, d).select("taxon", "family")
    seen = observations(spark, d).join(families, "taxon").select("report_id", "family").distinct()
    exposure = lists.groupBy("city", "fold").agg(F.count("*").alias("total"))
    found = lists.join(seen, "report_id").groupBy("city", "fold", "family").agg(F.count("*").alias("positives"))
    grid = exposure.crossJoin(families.select("family").distinct()).join(found, ["city", "fold", "family"], "left").fillna(0, ["positives"])
    rest = lambda x, *keys: F.sum(x).over(W.partitionBy(*keys))
    rows = grid.withColumns({"e": rest("total", "city", "family") - F.col("total"), "d": rest("positives", "city", "family") - F.col("positives"), "be": rest("total", "family") - rest("total", "family", "fold"), "bd": rest("positives", "family") - rest("positives", "family", "fold")})
    return rows.withColumns({"p": (F.col("d") + 1) / (F.col("e") + 2), "base": (F.col("bd") + 1) / (F.col("be") + 2)})


def loss(p):
    return F.sum(F.col("positives") * F.pow(1 - F.col(p), 2) + (F.col("total") - F.col("positives")) * F.pow(F.col(p), 2))


def metrics(rows):
    """scope, n, brier, skill, ece, bias: over all rows, by fold and by family, from sums of ten bins a scope."""
    scopes = F.explode(F.array(F.lit("all"), F.concat(F.lit("fold:"), "fold"), F.concat(F.lit("family:"), "family")))
    bins = rows.withColumn("scope", scopes).groupBy("scope", F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.sum("total").alias("t"), F.sum("positives").alias("k"), F.sum(F.col("total") * F.col("p")).alias("tp"), loss("p").alias("loss"), loss("base").alias("base_loss"))
    t = F.sum("t")
    return bins.groupBy("scope").agg(F.sum("n").alias("n"), F.round(F.sum("loss") / t, 6).alias("brier"), F.round(1 - F.sum("loss") / F.sum("base_loss"), 6).alias("skill"), F.round(F.sum(F.abs(F.col("tp") - F.col("k"))) / t, 6).alias("ece"), F.round((F.sum("tp") - F.sum("k")) / t, 6).alias("bias"))


def with_scopes(rows):
    """Rows with res = |observed - p|, once for each scope they belong to: family, group of families as common, all."""
    seen = F.sum("positives").over(W.partitionBy("family"))
    rows = rows.withColumns({"res": F.abs(F.col("positives") / F.col("total") - F.col("p")), "group": band(seen, 150, 200, 250)})
    return rows.withColumn("scope", F.explode(F.array(F.concat(F.lit("family:"), "family"), F.concat(F.lit("group:"), "group"), F.lit("global"))))


def cross_ranges(scoped):
    """family, fold, half: the widest quantile of residuals that any of its scopes has in any other fold."""
    widths = weighted_quantile(scoped, ["scope", "fold"], "res", "total", QUANTILE)
    others = widths.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).filter("held <> fold").groupBy("scope", "held").agg(F.max("res").alias("half"))
    mine = scoped.select("scope", "family", "fold").distinct()
    return mine.join(others, (mine["scope"] == others["scope"]) & (F.col("fold") == F.col("held"))).groupBy("family", "fold").agg(F.least(F.lit(1.0), F.max("half")).alias("half"))


@query(f"WITH {OOF_SQL} SELECT city, fold, family, total, positives, round(p, 6) AS p, round(base, 6) AS base FROM oof")
def oof_scores(spark, d):
    return out_of_fold(spark, d).select("city", "fold", "family", "total", "positives", F.round("p", 6).alias("p"), F.round("base", 6).alias("base"))


@query(f"WITH {OOF_SQL}, {METRICS_SQL} SELECT * FROM me")
def oof_metrics(spark, d):
    return metrics(out_of_fold(spark, d))


@query(f"""WITH {OOF_SQL}, {METRICS_SQL}
SELECT scope, concat_ws(',', CASE WHEN skill < 0 THEN 'skill' END, CASE WHEN ece > 0.02 THEN 'ece' END, CASE WHEN abs(bias) > 0.01 THEN 'bias' END) AS failed FROM me WHERE skill < 0 OR ece > 0.02 OR abs(bias) > 0.01""")
def release_gate(spark, d):
    """Scopes that fail, with the names of the failed tests."""
    tests = {"skill": F.col("skill") < 0, "ece": F.col("ece") > 0.02, "bias": F.abs("bias") > 0.01}
    rows = metrics(out_of_fold(spark, d)).select("scope", F.concat_ws(",", *[F.when(bad, n) for n, bad in tests.items()]).alias("failed"))
    return rows.filter("failed <> ''")


@query(f"""WITH {OOF_SQL}, fb AS (SELECT family, fold, round((sum(total * p) - sum(positives)) / sum(total), 6) AS bias FROM oof GROUP BY family, fold),
fd AS (SELECT family, bias, CASE WHEN bias > 0.005 THEN 1 WHEN bias < -0.005 THEN -1 ELSE 0 END AS way FROM fb)
SELECT family, round(max(abs(bias)), 6) AS worst, CASE WHEN min(way) = max(way) THEN CASE min(way) WHEN 1 THEN 'over' WHEN -1 THEN 'under' ELSE 'balanced' END WHEN min(way) = -1 AND max(way) = 1 THEN 'reversing' ELSE 'partial' END AS pattern FROM fd GROUP BY family""")
def bias_audit(spark, d):
    """Which way each family's chances are off, and whether folds agree."""
    bias = F.round((F.sum(F.col("total") * F.col("p")) - F.sum("positives")) / F.sum("total"), 6)
    rows = out_of_fold(spark, d).groupBy("family", "fold").agg(bias.alias("bias")).withColumn("way", F.when(F.col("bias") > 0.005, 1).when(F.col("bias") < -0.005, -1).otherwise(0))
    low, high = F.min("way"), F.max("way")
    same = F.when(low == 1, "over").when(low == -1, "under").otherwise("balanced")
    return rows.groupBy("family").agg(F.round(F.max(F.abs("bias")), 6).alias("worst"), F.when(low == high, same).when((low == -1) & (high == 1), "reversing").otherwise("partial").alias("pattern"))


@query(f"WITH {OOF_SQL}, {WIDTHS_SQL} SELECT scope, round(max(res), 6) AS half, count(*) AS folds FROM wq GROUP BY scope HAVING count(*) >= 3")
def range_widths(spark, d):
    """Half width of each scope's reference range: the widest of its folds' 90 % quantiles."""
    widths = weighted_quantile(with_scopes(out_of_fold(spark, d)), ["scope", "fold"], "res", "total", QUANTILE)
    return widths.groupBy("scope").agg(F.round(F.max("res"), 6).alias("half"), F.count("*").alias("folds")).filter("folds >= 3")


@query(f"""WITH {OOF_SQL}, {WIDTHS_SQL}, {CROSS_SQL}
SELECT family, round(CAST(sum(CASE WHEN res <= half THEN total ELSE 0 END) AS DOUBLE) / sum(total), 6) AS coverage, round(sum(total * (least(1.0, p + half) - greatest(0.0, p - half))) / sum(total), 6) AS width FROM gp JOIN hw USING (family, fold) GROUP BY family""")
def range_coverage(spark, d):
    """How often what was observed lies in a range that other folds set, and how wide ranges are."""
    scoped = with_scopes(out_of_fold(spark, d))
    rows = scoped.filter("scope = 'global'").drop("scope").join(cross_ranges(scoped), ["family", "fold"])
    inside, width = F.sum(F.when(F.col("res") <= F.col("half"), F.col("total")).otherwise(0)), F.least(F.lit(1.0), F.col("p") + F.col("half")) - F.greatest(F.lit(0.0), F.col("p") - F.col("half"))
    return rows.groupBy("family").agg(F.round(inside / F.sum("total"), 6).alias("coverage"), F.round(F.sum(F.col("total") * width) / F.sum("total"), 6).alias("width"))


def cap_losses(spark, d):
    """family, fold, cap, t, loss: the Brier loss when a city's evidence is scaled down to at most cap lists and joined to the prior."""
    rows = out_of_fold(spark, d).withColumn("cap", F.explode(F.array(*map(F.lit, CAPS))))
    free = (F.col("cap") < 0) | (F.col("e") <= F.col("cap"))
    e, k = F.when(free, F.col("e")).otherwise(F.col("cap")), F.when(free, F.col("d").cast("double")).otherwise(F.col("d").cast("double") * F.col("cap") / F.col("e"))
    scored = rows.withColumn("q", (F.col("base") * PRIOR + k) / (PRIOR + e))
    return scored.groupBy("family", "fold", "cap").agg(F.sum("total").alias("t"), loss("q").alias("loss"))


@query(f"WITH {OOF_SQL}, {CAPS_SQL} SELECT family, cap, round(sum(loss) / sum(t), 6) AS brier FROM cf GROUP BY family, cap")
def cap_scores(spark, d):
    return cap_losses(spark, d).groupBy("family", "cap").agg(F.round(F.sum("loss") / F.sum("t"), 6).alias("brier"))


@query(f"""WITH {OOF_SQL}, {CAPS_SQL}, rg AS (SELECT *, (loss / t - min(loss / t) OVER (PARTITION BY family, fold)) / min(loss / t) OVER (PARTITION BY family, fold) AS regret FROM cf),
po AS (SELECT family, cap, sum(loss) / sum(t) AS brier, round(max(regret), 9) AS worst, round(avg(regret), 9) AS mean FROM rg GROUP BY family, cap),
el AS (SELECT *, min(brier) OVER (PARTITION BY family) AS best FROM po),
wi AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY worst, mean, round(brier, 9), cap) AS k FROM el WHERE (brier - best) / best <= 0.001 + 1e-12)
SELECT family, cap, round(worst, 6) AS worst FROM wi WHERE k = 1""")
def stable_caps(spark, d):
    """Of the caps within 0.1 % of each family's best, the one that does least badly in its worst fold."""
    best = F.min(F.col("loss") / F.col("t")).over(W.partitionBy("family", "fold"))
    rows = cap_losses(spark, d).withColumn("regret", (F.col("loss") / F.col("t") - best) / best)
    pooled = rows.groupBy("family", "cap").agg((F.sum("loss") / F.sum("t")).alias("brier"), F.round(F.max("regret"), 9).alias("worst"), F.round(F.avg("regret"), 9).alias("mean"))
    least = F.min("brier").over(W.partitionBy("family"))
    near = pooled.withColumn("off", (F.col("brier") - least) / least).filter(F.col("off") <= STABLE + 1e-12)
    return first_by(near, ["family"], F.col("worst"), F.col("mean"), F.round("brier", 9), F.col("cap")).select("family", "cap", F.round("worst", 6).alias("worst"))


@query()
def cross_calibration(spark, d):
    """Per family: Brier score and bias before and after calibrators that other folds fit, and whether they are accepted:
    the score at most 1 % worse, the bias at most 0.01 larger."""
    rows = cross_fitted(out_of_fold(spark, d), "family", "fold", "p", "total", "positives", FOLDS)
    bias = lambda p: F.abs(F.sum(F.col("total") * F.col(p)) - F.sum("positives")) / F.sum("total")
    out = rows.groupBy("family").agg((loss("p") / F.sum("total")).alias("raw"), (loss("q") / F.sum("total")).alias("calibrated"), bias("p").alias("raw_bias"), bias("q").alias("bias"))
    return out.withColumn("accepted", (F.col("calibrated") <= 1.01 * F.col("raw")) & (F.col("bias") <= F.col("raw_bias") + 0.01))


@query("""WITH n AS (SELECT taxon, count(DISTINCT report_id) AS positives FROM ob GROUP BY taxon),
s AS (SELECT *, CASE WHEN positives >= 30 THEN concat('species:', taxon) WHEN positives >= 20 THEN 'group:positive_20_29' WHEN positives >= 10 THEN 'group:positive_10_19' END AS scope FROM n)
SELECT scope, count(*) AS taxa, CAST(sum(positives) AS BIGINT) AS positives, min(taxon) AS first FROM s GROUP BY scope""")
def calibrator_scopes(spark, d):
    """Which taxa are calibrated by themselves, together with others of like support, or not at all (null); bounds are lower here, as taxa have few lists."""
    n = observations(spark, d).groupBy("taxon").agg(F.countDistinct("report_id").alias("positives"))
    scope = calibrator_scope(F.col("taxon"), F.col("positives"), (10, 20, 30)).alias("scope")
    return n.select("taxon", "positives", scope).groupBy("scope").agg(F.count("*").alias("taxa"), F.sum("positives").alias("positives"), F.min("taxon").alias("first"))


@query()
def calibrator_families(spark, d):
    """Each family of calibrators and each shrinkage in each scope: the fit of all folds, its Brier score across folds, and which is selected."""
    rows = out_of_fold(spark, d).withColumn("scope", calibrator_scope(F.col("family"), F.sum("positives").over(W.partitionBy("family"))))
    return chosen_families(rows, "scope", "fold", "p", "total", "positives", FOLDS).withColumns({c: F.round(c, 6) for c in ("a", "b", "c")})


@query()
def frequency_intervals(spark, d):
    """city, family, p, low, high: the share of lists with the family and its 5 % and 95 % Beta quantiles."""
    rows = out_of_fold(spark, d).groupBy("city", "family").agg((F.sum("positives") + 1).cast("double").alias("a"), (F.sum("total") - F.sum("positives") + 1).cast("double").alias("b"))
    bound = lambda q: F.round(beta_quantile("a", "b", F.lit(q)), 6)
    return rows.select("city", "family", F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("p"), bound(0.05).alias("low"), bound(0.95).alias("high"))


@query("SELECT report_id, CAST(row_number() OVER (ORDER BY day, report_id) AS BIGINT) AS number FROM cl")
def record_numbers(spark, d):
    """Dense numbers in order of day and id."""
    return numbered(checklists(spark, d).select("report_id", "day"), "number", "day", "report_id").select("report_id", F.col("number").cast("long").alias("number"))


@query("""WITH nm AS (SELECT taxon, name, CAST(floor((row_number() OVER (ORDER BY name, taxon) - 1) / 50) AS BIGINT) AS shard FROM tx)
SELECT name, min(shard) AS shard, count(*) AS taxa FROM nm GROUP BY name""")
def catalogue_shards(spark, d):
    """The first shard of fifty profiles that has each name."""
    rows = numbered(taxa(spark, d).select("taxon", "name"), "number", "name", "taxon").withColumn("shard", F.floor((F.col("number") - 1) / 50))
    return rows.groupBy("name").agg(F.min("shard").alias("shard"), F.count("*").alias("taxa"))


@query("""WITH k AS (SELECT report_id, idx, idx - row_number() OVER (PARTITION BY report_id ORDER BY idx) AS g FROM (SELECT DISTINCT report_id, idx FROM ob WHERE NOT red)),
f AS (SELECT report_id, count(*) AS done FROM k WHERE g = 0 GROUP BY report_id)
SELECT cl.report_id, coalesce(done, 0) AS done FROM cl LEFT JOIN f USING (report_id)""")
def contiguous_prefix(spark, d):
    """How far each list is complete from its first row on; lists without a first row are at 0."""
    runs = islands(observations(spark, d).filter("NOT red"), ["report_id"], "idx").filter("begin = 1").select("report_id", "size")
    return checklists(spark, d).select("report_id").join(runs, "report_id", "left").select("report_id", F.coalesce("size", F.lit(0)).alias("done"))


@query("""WITH w AS (SELECT CAST(max(day) - INTERVAL 24 MONTH AS DATE) + 1 AS first, max(day) AS last FROM cl),
r AS (SELECT * FROM cl, w WHERE day BETWEEN first AND last), s AS (SELECT report_id, taxon, count(*) AS n FROM r JOIN ob USING (report_id) WHERE NOT red GROUP BY report_id, taxon),
k AS (SELECT DISTINCT report_id FROM s)
SELECT (SELECT strftime(first, '%Y-%m-%d') FROM w) AS first_day, (SELECT strftime(last, '%Y-%m-%d') FROM w) AS last_day, (SELECT count(*) FROM k) AS records, (SELECT count(*) FROM s) AS record_species,
(SELECT count(DISTINCT taxon) FROM s) AS species, (SELECT count(DISTINCT (city, point)) FROM r JOIN k USING (report_id) JOIN pp USING (observer)) AS places""")
def mart_counts(spark, d):
    """Size of the map mart: two years up to the last day, without excluded rows and the records that then are empty."""
    lists = checklists(spark, d)
    last = lists.agg(F.max("day").alias("last")).withColumn("first", F.date_add(F.add_months("last", -24), 1))
    rows = lists.join(F.broadcast(last), F.col("day").between(F.col("first"), F.col("last"))).join(observers(spark, d).select("observer", "city", "point"), "observer")
    kept = rows.join(observations(spark, d).filter("NOT red").select("report_id", "taxon").distinct(), "report_id")
    counts = kept.agg(F.countDistinct("report_id").alias("records"), F.count("*").alias("record_species"), F.countDistinct("taxon").alias("species"), F.countDistinct("city", "point").alias("places"))
    return counts.crossJoin(F.broadcast(last)).select(day("first").alias("first_day"), day("last").alias("last_day"), "records", "record_species", "species", "places")


@query("""WITH r AS (SELECT taxon, {'day': day, 'report_id': report_id} AS rec FROM cl JOIN ob USING (report_id) WHERE NOT red), m AS (SELECT taxon, max(rec) AS rec FROM r GROUP BY taxon)
SELECT taxon, strftime(rec.day, '%Y-%m-%d') AS day, rec.report_id AS report_id FROM m""")
def taxon_latest(spark, d):
    """Each taxon's last record; an aggregate, so common taxa shrink before the shuffle."""
    rows = checklists(spark, d).join(observations(spark, d).filter("NOT red"), "report_id")
    return rows.groupBy("taxon").agg(F.max(F.struct("day", "report_id")).alias("last")).select("taxon", day("last.day").alias("day"), F.col("last.report_id").alias("report_id"))


@query(f"""WITH wl AS (SELECT report_id, observer, unnest([concat('province:', province), concat('city:', city), concat('point:', city, ':', point)]) AS unit, {WEEK} AS week, pow(2.0, -date_diff('day', day, DATE '{NOW}') / 365.2425 / 3.0) AS weight FROM cl JOIN pp USING (observer))
SELECT unit, week, round(sum(weight), 6) AS exposure, count(*) AS lists, count(DISTINCT observer) AS observers FROM wl GROUP BY unit, week""")
def weekly_exposure(spark, d):
    """Exposure at three levels at once: each list is handed to its units, then summed."""
    rows = checklists(spark, d).join(observers(spark, d), "observer")
    units = F.array(F.concat(F.lit("province:"), "province"), F.concat(F.lit("city:"), "city"), F.concat(F.lit("point:"), "city", F.lit(":"), "point"))
    rows = rows.select(F.explode(units).alias("unit"), season_week(F.col("day")).alias("week"), recency(F.col("day"), F.to_date(F.lit(NOW))).alias("weight"), "observer")
    return rows.groupBy("unit", "week").agg(F.round(F.sum("weight"), 6).alias("exposure"), F.count("*").alias("lists"), F.countDistinct("observer").alias("observers"))


@query(f"WITH w AS (SELECT city, count(DISTINCT {WEEK}) AS weeks FROM cl JOIN pp USING (observer) GROUP BY city) SELECT c.city, 52 - coalesce(weeks, 0) AS missing FROM (SELECT DISTINCT city FROM pp) c LEFT JOIN w USING (city)")
def missing_weeks(spark, d):
    """Season weeks without any list, by city."""
    weeks = checklists(spark, d).join(observers(spark, d).select("observer", "city"), "observer").groupBy("city").agg(F.countDistinct(season_week(F.col("day"))).alias("weeks"))
    return observers(spark, d).select("city").distinct().join(weeks, "city", "left").select("city", (52 - F.coalesce("weeks", F.lit(0))).alias("missing"))


@query("SELECT count(*) AS rows, count(*) FILTER (red) AS excluded, count(DISTINCT CASE WHEN red THEN report_id END) AS lists, count(DISTINCT CASE WHEN red THEN taxon END) AS taxa FROM ob")
def excluded_rows(spark, d):
    red = F.col("red")
    return observations(spark, d).agg(F.count("*").alias("rows"), F.count_if(red).alias("excluded"), F.countDistinct(F.when(red, F.col("report_id"))).alias("lists"), F.countDistinct(F.when(red, F.col("taxon"))).alias("taxa"))


@query(f"""WITH {CELLS_SQL}, v AS (SELECT x, y FROM c WHERE substr(sha256(concat(CAST(x AS VARCHAR), ':', CAST(y AS VARCHAR))), 1, 1) IN ('0', '1', '2')),
h AS (SELECT observer, {CELL_SQL} FROM pp), t AS (SELECT observer FROM h WHERE NOT EXISTS (SELECT 1 FROM v WHERE abs(v.x - h.x) <= 1 AND abs(v.y - h.y) <= 1))
SELECT taxon, count(DISTINCT observer) AS observers FROM t JOIN cl USING (observer) JOIN ob USING (report_id) WHERE NOT red GROUP BY taxon HAVING count(DISTINCT observer) >= 3""")
def eligible_taxa(spark, d):
    """Taxa that at least three observers report from training cells."""
    chosen = F.substring(F.sha2(F.concat_ws(":", "x", "y"), 256), 1, 1).isin("0", "1", "2")
    training = split_by_cell(cells(spark, d), chosen).filter("role = 'training'").select("x", "y")
    here = observers(spark, d).select("observer", *cell()).join(training, ["x", "y"], "left_semi").select("observer")
    rows = checklists(spark, d).join(here, "observer").join(observations(spark, d).filter("NOT red"), "report_id")
    return rows.groupBy("taxon").agg(F.countDistinct("observer").alias("observers")).filter("observers >= 3")


@query("""WITH f AS (SELECT *, unnest([1998, 1999, 2000]) AS fold FROM cl JOIN pp USING (observer)), g AS (SELECT *, count(*) OVER (PARTITION BY fold, observer, year(day), month(day)) AS k FROM f WHERE year(day) <= fold)
SELECT fold, city, count(*) FILTER (year(day) < fold) AS train, round(sum(CASE WHEN year(day) < fold THEN pow(2.0, -date_diff('day', day, make_date(fold, 1, 1)) / 365.2425 / 3.0) / k ELSE 0 END), 6) AS train_weight, count(*) FILTER (year(day) = fold) AS held, round(sum(CASE WHEN year(day) = fold THEN 1.0::DOUBLE / k ELSE 0 END), 6) AS held_weight FROM g GROUP BY fold, city""")
def temporal_folds(spark, d):
    """Three rolling origins: lists before a year train, weighted by age; the year's own are held out."""
    rows = checklists(spark, d).join(observers(spark, d).select("observer", "city"), "observer").withColumn("fold", F.explode(F.array(*map(F.lit, (1998, 1999, 2000))))).filter(F.year("day") <= F.col("fold"))
    k, past = F.count("*").over(W.partitionBy("fold", "observer", F.year("day"), F.month("day"))), F.year("day") < F.col("fold")
    rows = rows.withColumns({"k": k, "past": past, "age": recency(F.col("day"), F.make_date("fold", F.lit(1), F.lit(1)))})
    return rows.groupBy("fold", "city").agg(F.count_if("past").alias("train"), F.round(F.sum(F.when(F.col("past"), F.col("age") / F.col("k")).otherwise(0)), 6).alias("train_weight"), F.count_if(~F.col("past")).alias("held"), F.round(F.sum(F.when(~F.col("past"), 1 / F.col("k")).otherwise(0)), 6).alias("held_weight"))


@query("""WITH o AS (SELECT report_id, observer, taxon, substr(sha256(CAST(observer AS VARCHAR)), 1, 1) AS c FROM cl JOIN ob USING (report_id)),
f AS (SELECT *, CASE WHEN c < '5' THEN 0 WHEN c < 'a' THEN 1 ELSE 2 END AS fold FROM o), n AS (SELECT taxon, min(fold) AS fold FROM f GROUP BY taxon HAVING min(fold) = max(fold))
SELECT fold, count(DISTINCT observer) AS observers, count(DISTINCT report_id) AS lists, (SELECT count(*) FROM n WHERE n.fold = f.fold) AS novel FROM f GROUP BY fold""")
def observer_folds(spark, d):
    """Three folds of observers by a hash: their size, and the taxa that no other fold has."""
    c = F.substring(F.sha2(F.col("observer").cast("string"), 256), 1, 1)
    rows = checklists(spark, d).join(observations(spark, d).select("report_id", "taxon"), "report_id").withColumn("fold", F.when(c < "5", 0).when(c < "a", 1).otherwise(2))
    novel = rows.groupBy("taxon").agg(F.min("fold").alias("fold"), F.max("fold").alias("most")).filter("fold = most").groupBy("fold").agg(F.count("*").alias("novel"))
    sizes = rows.groupBy("fold").agg(F.countDistinct("observer").alias("observers"), F.countDistinct("report_id").alias("lists"))
    return sizes.join(novel, "fold", "left").fillna(0, ["novel"])


@query(f"""WITH g AS (SELECT city, CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y, point, observer FROM pp), n AS (SELECT observer, count(*) AS lists FROM cl GROUP BY observer),
k AS (SELECT city, x, y, point, min(observer) AS canonical, count(*) AS members, CAST(sum(coalesce(lists, 0)) AS BIGINT) AS lists FROM g LEFT JOIN n USING (observer) GROUP BY city, x, y, point)
SELECT g.observer, canonical, members, lists FROM g JOIN k USING (city, x, y, point)""")
def place_aliases(spark, d):
    """Places of one city, square degree and name are one: each with the least id among them, their number and all their lists."""
    keys = ["city", "x", "y", "point"]
    lists = checklists(spark, d).groupBy("observer").agg(F.count("*").alias("lists"))
    rows = observers(spark, d).select("observer", "city", "point", *cell(1)).join(lists, "observer", "left").fillna(0, ["lists"])
    groups = rows.groupBy(*keys).agg(F.min("observer").alias("canonical"), F.count("*").alias("members"), F.sum("lists").alias("lists"))
    return rows.drop("lists").join(groups, keys).select("observer", "canonical", "members", "lists")


@query("""WITH g AS (SELECT city, point, CAST(floor(lon) AS BIGINT) AS x, CAST(floor(lat) AS BIGINT) AS y FROM pp)
SELECT 'many names' AS finding, concat(x, ':', y) AS key, count(DISTINCT point) AS n FROM g GROUP BY x, y HAVING count(DISTINCT point) >= 2
UNION ALL SELECT 'many cities', point, count(DISTINCT city) FROM g GROUP BY point HAVING count(DISTINCT city) >= 2""")
def name_audit(spark, d):
    """Squares with several place names, and names that several cities have."""
    rows = observers(spark, d).select("city", "point", *cell(1))
    found = lambda what, key, x: rows.groupBy(key.alias("key")).agg(F.countDistinct(x).alias("n")).filter("n >= 2").select(F.lit(what).alias("finding"), "key", "n")
    return found("many names", F.concat_ws(":", "x", "y"), "point").unionByName(found("many cities", F.col("point"), "city"))


@query(f"SELECT report_id, round(sin(2 * pi() * {SEASON} / 365), 6) AS s, round(cos(2 * pi() * {SEASON} / 365), 6) AS c, round((year(day) - 1995) / 6.0::DOUBLE, 6) AS age, round(lon, 6) AS lon, round(lat, 6) AS lat FROM cl JOIN pp USING (observer)")
def challenger_features(spark, d):
    """Inputs of the boosted model: place, scaled year and the season as a point on a circle."""
    rows = checklists(spark, d).join(observers(spark, d), "observer").withColumn("turn", 2 * F.pi() * season_day(F.col("day")) / 365)
    return rows.select("report_id", F.round(F.sin("turn"), 6).alias("s"), F.round(F.cos("turn"), 6).alias("c"), F.round((F.year("day") - 1995) / 6.0, 6).alias("age"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""WITH r AS (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) <= 8)
SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events JOIN r USING (user_id)""", bound=False)
def stream_first_notices(spark, d):
    return first_notices(spark, d)
