"""Registered queries of nested spatial hold-outs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import nested
from fieldmark.operators.places import cell
from fieldmark.plans.checklist_queries import query
from fieldmark.plans.split_queries import PER_DEGREE
from fieldmark.sources.shared import kept
from fieldmark.sources.tables import checklists, observations, observers, taxa

FOLDS, STRENGTHS = 5, (5.0, 20.0, 80.0)
LEVELS = {"all": [], "province": ["province"], "city": ["province", "city"]}
PAIRS = [(o, i) for o in range(FOLDS) for i in (nested.NONE, *range(FOLDS)) if i != o]


def fold():
    """The fold of a cell by the first digit of a hash: some five in sixteen cells are held out in turn."""
    c = F.substring(F.sha2(F.concat_ws(":", "x", "y"), 256), 1, 1)
    return F.when(c < str(FOLDS), c.cast("int")).alias("fold")


def counts(spark, d):
    """Lists, and lists with each family, of each cell and city: x, y, province, city, family (null: all lists), n."""
    lists = checklists(spark, d).select("report_id", "observer").join(observers(spark, d).select("observer", "province", "city", *cell(PER_DEGREE)), "observer")
    seen = observations(spark, d).join(taxa(spark, d), "taxon").select("report_id", "family").distinct()
    place = ["x", "y", "province", "city"]
    every = lists.groupBy(*place).agg(F.count("*").alias("n")).withColumn("family", F.lit(None).cast("string"))
    return kept(every.unionByName(lists.join(seen, "report_id").groupBy(*place, "family").agg(F.count("*").alias("n"))), "cell-counts")


def validated(spark, d):
    n = counts(spark, d)
    held = kept(nested.withheld(n.select("x", "y").distinct().select("x", "y", fold()), FOLDS), "withheld")
    items = n.filter("family IS NOT NULL").select("family").distinct()
    return n, held, nested.validation(n, held, items, "family", LEVELS)


def posterior_sql(s) -> str:
    p = "((d0 + 1) / (e0 + 2)::DOUBLE)"
    for i in (1, 2):
        p = f"(CASE WHEN e{i} > 0 THEN ({p} * {s} + d{i}) / ({s} + e{i}) ELSE {p} END)"
    return p


LOSS_SQL = "k * pow(1 - {p}, 2) + (t - k) * pow({p}, 2)"
CELLS_SQL = f"""ll AS (SELECT report_id, province, city, CAST(floor(lon * {PER_DEGREE}) AS BIGINT) AS x, CAST(floor(lat * {PER_DEGREE}) AS BIGINT) AS y FROM cl JOIN pp USING (observer)),
ce AS (SELECT x, y, CASE WHEN c < '{FOLDS}' THEN CAST(c AS INT) END AS fold FROM (SELECT DISTINCT x, y, substr(sha256(concat(x, ':', y)), 1, 1) AS c FROM ll)),
nr AS (SELECT DISTINCT a.x, a.y, b.fold FROM ce a JOIN (SELECT x + dx AS x, y + dy AS y, fold FROM ce, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE fold IS NOT NULL) b USING (x, y)),
pa AS (SELECT * FROM (VALUES {", ".join(f"({o}, {i})" for o, i in PAIRS)}) v(o, i)),
ro AS (SELECT o, i, ce.x, ce.y, CASE WHEN ce.fold = o THEN 'outer' WHEN no.x IS NOT NULL THEN 'outer buffer' WHEN ce.fold = i THEN 'inner' WHEN ni.x IS NOT NULL THEN 'buffer' ELSE 'training' END AS role
  FROM ce CROSS JOIN pa LEFT JOIN nr no ON no.x = ce.x AND no.y = ce.y AND no.fold = o LEFT JOIN nr ni ON ni.x = ce.x AND ni.y = ce.y AND ni.fold = i)"""


@query(f"""WITH {CELLS_SQL} SELECT o AS "outer", i AS "inner", role, count(*) AS cells, CAST(sum(n) AS BIGINT) AS lists FROM ro JOIN (SELECT x, y, count(*) AS n FROM ll GROUP BY x, y) USING (x, y) GROUP BY ALL""")
def nested_roles(spark, d):
    """What each pair of an outer and an inner fold does with the cells: how many, and how many lists, train, are validated, or lie in a buffer."""
    n = counts(spark, d).filter("family IS NULL").groupBy("x", "y").agg(F.sum("n").alias("n"))
    held = nested.withheld(n.select("x", "y", fold()), FOLDS).join(n, ["x", "y"]).groupBy(*nested.PAIR, "role").agg(F.count("*").alias("cells"), F.sum("n").alias("lists"))
    held = kept(held, "nested-roles")
    every = n.agg(F.count("*").alias("cells"), F.sum("n").alias("lists"))
    pairs = every.select("*", F.inline(F.array(*[F.struct(F.lit(o).alias("outer"), F.lit(i).alias("inner")) for o, i in PAIRS])))
    taken = held.groupBy(*nested.PAIR).agg(F.sum("cells").alias("c"), F.sum("lists").alias("l"))
    rest = pairs.join(taken, nested.PAIR, "left").fillna(0, ["c", "l"]).select(*nested.PAIR, F.lit("training").alias("role"), (F.col("cells") - F.col("c")).alias("cells"), (F.col("lists") - F.col("l")).alias("lists"))
    return held.unionByName(rest.filter("cells > 0"))


@query(f"""WITH {CELLS_SQL}, fs AS (SELECT DISTINCT report_id, family FROM ob JOIN tx USING (taxon)), fa AS (SELECT DISTINCT family FROM fs),
tn AS (SELECT o, i, province, city, report_id FROM ll JOIN ro USING (x, y) WHERE role = 'training'), tk AS (SELECT o, i, province, city, family, count(*) AS d FROM tn JOIN fs USING (report_id) GROUP BY ALL),
e2 AS (SELECT o, i, province, city, count(*) AS e2 FROM tn GROUP BY ALL), e1 AS (SELECT o, i, province, sum(e2) AS e1 FROM e2 GROUP BY ALL), e0 AS (SELECT o, i, sum(e1) AS e0 FROM e1 GROUP BY ALL),
d1 AS (SELECT o, i, province, family, sum(d) AS d1 FROM tk GROUP BY ALL), d0 AS (SELECT o, i, family, sum(d1) AS d0 FROM d1 GROUP BY ALL),
va AS (SELECT o, i, x, y, province, city, report_id FROM ll JOIN ro USING (x, y) WHERE role = CASE WHEN i = {nested.NONE} THEN 'outer' ELSE 'inner' END),
vt AS (SELECT o, i, x, y, province, city, count(*) AS t FROM va GROUP BY ALL), vk AS (SELECT o, i, x, y, province, city, family, count(*) AS k FROM va JOIN fs USING (report_id) GROUP BY ALL),
rw AS (SELECT o, i, t, coalesce(k, 0) AS k, coalesce(e0, 0) AS e0, coalesce(e1, 0) AS e1, coalesce(e2, 0) AS e2, coalesce(d0, 0) AS d0, coalesce(d1, 0) AS d1, coalesce(d, 0) AS d2
  FROM vt CROSS JOIN fa LEFT JOIN vk USING (o, i, x, y, province, city, family) LEFT JOIN e0 USING (o, i) LEFT JOIN e1 USING (o, i, province) LEFT JOIN e2 USING (o, i, province, city) LEFT JOIN d0 USING (o, i, family) LEFT JOIN d1 USING (o, i, province, family) LEFT JOIN tk USING (o, i, province, city, family)),
ls AS (SELECT o, i, s, sum(t) AS t, sum({LOSS_SQL.format(p=posterior_sql("s"))}) AS loss FROM rw, (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in STRENGTHS)}]) AS s) GROUP BY ALL),
be AS (SELECT o, arg_min(s, (brier, s)) AS best FROM (SELECT o, s, round(sum(loss) / sum(t), 12) AS brier FROM ls WHERE i <> {nested.NONE} GROUP BY o, s) GROUP BY o)
SELECT o AS "outer", i AS "inner", s AS strength, CAST(t AS BIGINT) AS total, round(loss / t, 6) AS brier, s = best AS selected FROM ls JOIN be USING (o) WHERE i <> {nested.NONE} OR s = best""")
def nested_strengths(spark, d):
    """Prior strengths by inner fold of each outer fold, and the outer fold's score under the strength that its inner folds chose."""
    _, _, rows = validated(spark, d)
    return nested.chosen_inside(rows, list(LEVELS), STRENGTHS).withColumn("brier", F.round("brier", 6))


@query()
def nested_calibration(spark, d):
    """Each outer fold's score before and after the calibrator that its inner folds fit."""
    _, _, rows = validated(spark, d)
    found = kept(nested.chosen_inside(rows, list(LEVELS), STRENGTHS), "nested-choices")
    out = nested.calibrated_inside(rows, list(LEVELS), found).groupBy("outer", "strength", "a", "b", "c")
    return out.agg(F.sum("total").alias("total"), *[(nested.brier_loss(F.col(x)) / F.sum("total")).alias(n) for x, n in (("p", "raw"), ("q", "calibrated"))])
