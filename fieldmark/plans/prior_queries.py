"""The registered query that tunes prior strengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators.priors import FACTORS, tuned
from fieldmark.plans.checklist_queries import query
from fieldmark.sources.shared import kept
from fieldmark.sources.tables import checklists, observations, observers, taxa

YEARS, START = (1999, 2000), {"province": 40.0, "city": 20.0, "point": 10.0}
#: Shares of lists below which a family is rare or common.
RARE, COMMON = 0.14, 0.16
LEVELS = ["all", *START]
FACTORS_SQL = ", ".join(f"{f}::DOUBLE" for f in FACTORS)


def posterior_sql(a: str, b: str, c: str) -> str:
    p = "((d0 + 1) / (e0 + 2)::DOUBLE)"
    for i, s in enumerate((a, b, c), 1):
        p = f"(CASE WHEN e{i} > 0 THEN ({p} * {s} + d{i}) / ({s} + e{i}) ELSE {p} END)"
    return p


def tried_sql(n: int, level: str, strengths: tuple[str, str, str], joins: str) -> str:
    p = posterior_sql(*strengths)
    return f"""l{n} AS (SELECT grp, {START[level]}::DOUBLE * f AS s, round(sum(k * pow(1 - {p}, 2) + (t - k) * pow({p}, 2)) / sum(t), 12) AS brier, CAST(sum(t) AS DOUBLE) AS weight FROM rw {joins}, (SELECT unnest([{FACTORS_SQL}]) AS f) GROUP BY ALL),
c{n} AS (SELECT grp, arg_min(s, (brier, s)) AS s FROM l{n} GROUP BY grp)"""


@query(f"""WITH ls AS (SELECT report_id, year(day) AS y, province, city, point, unnest([{", ".join(map(str, YEARS))}]) AS v FROM cl JOIN pp USING (observer)), fs AS (SELECT DISTINCT report_id, family FROM ob JOIN tx USING (taxon)),
ce AS (SELECT v, province, city, point, count(*) FILTER (y < v) AS e3, count(*) FILTER (y = v) AS t FROM ls WHERE y <= v GROUP BY ALL), cd AS (SELECT v, family, province, city, point, count(*) FILTER (y < v) AS d3, count(*) FILTER (y = v) AS k FROM ls JOIN fs USING (report_id) WHERE y <= v GROUP BY ALL),
be AS (SELECT v, city, sum(e3) AS e2 FROM ce GROUP BY ALL), bd AS (SELECT v, family, city, sum(d3) AS d2 FROM cd GROUP BY ALL), ae AS (SELECT v, province, sum(e3) AS e1 FROM ce GROUP BY ALL), ad AS (SELECT v, family, province, sum(d3) AS d1 FROM cd GROUP BY ALL), ze AS (SELECT v, sum(e3) AS e0 FROM ce GROUP BY ALL), zd AS (SELECT v, family, sum(d3) AS d0 FROM cd GROUP BY ALL),
rw AS (SELECT e0, d0, e1, d1, e2, d2, e3, coalesce(d3, 0) AS d3, t, coalesce(k, 0) AS k, CASE WHEN d0 / e0 < {RARE} THEN 'rare' WHEN d0 / e0 < {COMMON} THEN 'regular' ELSE 'common' END AS grp
  FROM ce JOIN bd USING (v, city) JOIN be USING (v, city) JOIN ae USING (v, province) JOIN ad USING (v, family, province) JOIN ze USING (v) JOIN zd USING (v, family) LEFT JOIN cd USING (v, family, province, city, point) WHERE t > 0 AND e0 > 0),
{tried_sql(1, "province", (f"({START['province']} * f)", str(START["city"]), str(START["point"])), "")},
{tried_sql(2, "city", ("c1.s", f"({START['city']} * f)", str(START["point"])), "JOIN c1 USING (grp)")},
{tried_sql(3, "point", ("c1.s", "c2.s", f"({START['point']} * f)"), "JOIN c1 USING (grp) JOIN c2 USING (grp)")}
SELECT * FROM (SELECT 'province' AS level, grp AS prevalence, l1.s AS strength, round(brier, 6) AS brier, weight, l1.s = c1.s AS selected FROM l1 JOIN c1 USING (grp) UNION ALL SELECT 'city', grp, l2.s, round(brier, 6), weight, l2.s = c2.s FROM l2 JOIN c2 USING (grp) UNION ALL SELECT 'point', grp, l3.s, round(brier, 6), weight, l3.s = c3.s FROM l3 JOIN c3 USING (grp))""")
def prior_strengths(spark, d):
    """Strengths tried for each level and prevalence of a family, their Brier score over two held-out years, and which is selected.
    Contexts are points with lists in the year, for each family seen in their city by then; sums of wider levels come from those of points."""
    lists = checklists(spark, d).join(observers(spark, d), "observer").select("report_id", F.year("day").alias("y"), "province", "city", "point")
    seen = observations(spark, d).join(taxa(spark, d), "taxon").select("report_id", "family").distinct()
    place = ["province", "city", "point"]

    def counted(rows, keys, train, held):
        """By year first, so that only sums are repeated for each held-out year."""
        n = rows.groupBy("y", *keys).agg(F.count("*").alias("n")).withColumn("v", F.explode(F.array(*map(F.lit, YEARS)))).filter("y <= v")
        of = lambda past: F.sum(F.when(past, F.col("n")).otherwise(0))
        return kept(n.groupBy("v", *keys).agg(of(F.col("y") < F.col("v")).alias(train), of(F.col("y") == F.col("v")).alias(held)), "prior-counts")

    e, s = counted(lists, place, "e_point", "total"), counted(lists.join(seen, "report_id"), ["family", *place], "d_point", "positive")
    rows = e.filter("total > 0").join(s.groupBy("v", "family", "city").agg(F.sum("d_point").alias("d_city")), ["v", "city"])
    rows = rows.join(s.select("v", "family", *place, "d_point", "positive"), ["v", "family", *place], "left").fillna(0, ["d_point", "positive"])
    for level, keys in (("city", ["v", "city"]), ("province", ["v", "province"]), ("all", ["v"])):
        rows = rows.join(e.groupBy(*keys).agg(F.sum("e_point").alias(f"e_{level}")), keys)
        if level != "city":
            own = [*keys, "family"]
            rows = rows.join(s.groupBy(*own).agg(F.sum("d_point").alias(f"d_{level}")), own)
    share = F.try_divide("d_all", "e_all")
    rows = kept(rows.withColumn("prevalence", F.when(share < RARE, "rare").when(share < COMMON, "regular").when(share.isNotNull(), "common")), "prior-rows")
    found = tuned(rows, LEVELS, "prevalence", "total", "positive", START)
    return spark.createDataFrame(found, "level string, prevalence string, strength double, brier double, weight double, selected boolean").withColumn("brier", F.round("brier", 6))
