"""The challenger's folds, support and champion against SQL on the smallest tables."""

import duckdb
from pyspark.sql import functions as F

from fieldmark.plans import challenger_queries
from fieldmark.plans.challenger_queries import TARGETS, contexts, folds, metrics
from fieldmark.sources.tables import BINDING

DATA = "/root/testdata/sf0.001"
HASHED = "substr(sha256({}), 1, 1) IN ('0', '1', '2')"
SQL = f"""WITH {BINDING}, li AS (SELECT report_id, observer, city, year(day) AS year, CAST(floor(lon * 5) AS BIGINT) AS x, CAST(floor(lat * 5) AS BIGINT) AS y FROM cl JOIN pp USING (observer)),
hc AS (SELECT DISTINCT x, y FROM li WHERE {HASHED.format("concat(x, ':', y)")}),
fo AS (SELECT concat('time_', v) AS fold, report_id, observer, city, year < v AS training FROM li, (SELECT unnest([1998, 1999, 2000]) AS v) WHERE year <= v
  UNION ALL SELECT 'cells', report_id, observer, city, false FROM li JOIN hc USING (x, y)
  UNION ALL SELECT 'cells', report_id, observer, city, true FROM li WHERE NOT EXISTS (SELECT 1 FROM hc WHERE abs(hc.x - li.x) <= 1 AND abs(hc.y - li.y) <= 1)
  UNION ALL SELECT 'observers', report_id, observer, city, NOT {HASHED.format("CAST(observer AS VARCHAR)")} FROM li),
se AS (SELECT DISTINCT report_id, substr(family, 1, 7) AS target FROM ob JOIN tx USING (taxon)),
gr AS (SELECT fo.*, t.target, se.target IS NOT NULL AS hit FROM fo CROSS JOIN (SELECT DISTINCT substr(family, 1, 7) AS target FROM tx) t LEFT JOIN se ON se.report_id = fo.report_id AND se.target = t.target),
al AS (SELECT fold, target, (count(*) FILTER (hit) + 1) / (count(*) + 2)::DOUBLE AS p FROM gr WHERE training GROUP BY ALL), ci AS (SELECT fold, target, city, count(*) AS e, count(*) FILTER (hit) AS d FROM gr WHERE training GROUP BY ALL),
sc AS (SELECT fold, target, observer, hit, (p * 20 + coalesce(d, 0)) / (20 + coalesce(e, 0)) AS p FROM gr JOIN al USING (fold, target) LEFT JOIN ci USING (fold, target, city) WHERE NOT training),
su AS (SELECT fold, target, count(DISTINCT observer) FILTER (training AND hit) AS tp, count(DISTINCT observer) FILTER (training AND NOT hit) AS tn, count(DISTINCT observer) FILTER (NOT training AND hit) AS hp, count(DISTINCT observer) FILTER (NOT training AND NOT hit) AS hn FROM gr GROUP BY ALL)
SELECT fold, target, tp, tn, hp, hn, round(avg(pow(p - CAST(hit AS INT), 2)), 9) FROM sc JOIN su USING (fold, target) GROUP BY ALL"""


def test_folds_support_and_champion_as_by_sql(spark):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = metrics(spark, DATA).collect()
    got = {(r["fold"], r["target"]): [r["train_positives"], r["train_negatives"], r["held_positives"], r["held_negatives"], round(r["champion_brier"], 6)] for r in rows}
    want = {r[:2]: [*r[2:6], round(r[6], 6)] for r in con.sql(SQL).fetchall() if r[1] in TARGETS}
    assert got == want and len(got) >= 20
    assert all(0 < r["challenger_brier"] < 1 and 0 <= r["challenger_ece"] <= 1 for r in rows)
    lists = folds(contexts(spark, DATA))
    assert lists.count() == lists.select("report_id", "fold").distinct().count()


def test_trees_grow_on_counts_without_cities(spark, monkeypatch):
    """trees saw a row for each city, which they have no feature for, so their rows grew with the cities."""
    seen = []

    def stub(cells, model):
        seen.append(cells.collect())
        return cells.withColumn("q", F.lit(0.5))

    monkeypatch.setattr(challenger_queries, "boosted", stub)
    rows = [("f", "time", c, [b], t, [TARGETS[c % 5]]) for c in range(20) for b in (0, 1) for t in (True, False)] + [("f", "time", 0, [7], False, [])]
    lists = spark.createDataFrame(rows, "fold string, kind string, city int, bins array<int>, training boolean, found array<string>")
    out = challenger_queries.scored(lists)
    assert len(seen[0]) == 3 * len(TARGETS) and out.count() == (20 * 2 * 2 + 1) * len(TARGETS)
    assert {(r["bins"][0], r["total"], r["positives"], r["training"]) for r in seen[0]} == {(0, 20, 4, True), (1, 20, 4, True), (7, 0, 0, False)}
