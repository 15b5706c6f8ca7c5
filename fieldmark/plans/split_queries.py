"""Registered queries over profiles and neighbours of cells, balanced folds and split panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import folds, profiles
from fieldmark.operators.neighbours import ENOUGH, NEAREST, chosen, nearest_rows, policies, pools
from fieldmark.operators.places import cell
from fieldmark.plans.checklist_queries import query
from fieldmark.plans.habitat_queries import BANDWIDTH, GROUPS, RADIUS, SHARES_SQL, habitat_shares
from fieldmark.sources.shared import kept
from fieldmark.sources.tables import checklists, observers, table

SEED, PROFILES, PER_DEGREE = "panels-1", 8, 20


@query()
def cell_profiles(spark, d):
    """The habitat profile of each cell and how far it is from its centre: at most eight, each with at least 32 cells."""
    rows, _ = profiles.fitted(habitat_shares(spark, d), "vec_id", [f"s{g}" for g in range(GROUPS)], PROFILES)
    return rows.select("vec_id", "profile", F.round("distance", 6).alias("distance"))


@query("""WITH RECURSIVE n AS (SELECT o_custkey AS observer, count(*) AS lists, row_number() OVER (ORDER BY count(*) DESC, sha256(CAST(o_custkey AS VARCHAR))) AS k FROM orders GROUP BY o_custkey),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS observer, CAST(0 AS BIGINT) AS lists, -1 AS fold, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c
UNION ALL SELECT k, observer, lists, fold, a + CASE WHEN fold = 0 THEN lists ELSE 0 END, b + CASE WHEN fold = 1 THEN lists ELSE 0 END, c + CASE WHEN fold = 2 THEN lists ELSE 0 END
  FROM (SELECT n.k, n.observer, n.lists, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS fold, a, b, c FROM g JOIN n ON n.k = g.k + 1))
SELECT observer, lists, fold FROM g WHERE k > 0""", bound=False)
def balanced_observer_folds(spark, d):
    """Observers by falling number of lists, each to the fold of three that has the fewest lists so far."""
    n = checklists(spark, d).groupBy("observer").agg(F.count("*").alias("lists")).withColumn("hash", F.sha2(F.col("observer").cast("string"), 256))
    return folds.least_loaded(n, "hash", "lists", 3).select("observer", "lists", "fold")


def units(spark, d):
    """Cells with lists: unit, city (that of most lists, the lower among equals), x, y, lists, observers."""
    o = observers(spark, d).select("observer", "city", *cell(PER_DEGREE))
    by_observer = checklists(spark, d).groupBy("observer").agg(F.count("*").alias("lists")).join(o, "observer")
    by_city = by_observer.groupBy("x", "y", "city").agg(F.sum("lists").alias("lists"), F.count("*").alias("observers"))
    rows = by_city.groupBy("x", "y").agg(F.max_by("city", F.struct("lists", -F.col("city"))).alias("city"), F.sum("lists").alias("lists"), F.sum("observers").alias("observers"))
    return rows.withColumn("unit", F.concat_ws(":", "x", "y"))


def anchors(spark, d):
    """The anchors of both panels in cities with two cells or more, with their folds."""
    rows = units(spark, d)
    enough = rows.groupBy("city").agg(F.count("*").alias("n")).filter("n > 1").select("city")
    return folds.balanced(folds.split_panels(rows.join(enough, "city"), SEED), SEED)


@query()
def split_panel_anchors(spark, d):
    """Two cells of each city, one for development and one sealed, at given shares of support and with buffers that don't touch; five balanced folds a panel."""
    return anchors(spark, d).select("city", "panel", "unit", "lists", "observers", F.round("quantile", 6).alias("quantile"), "target", "fold")


@query()
def split_panel_roles(spark, d):
    """What each fold of the panels withholds: cells and lists of its anchors and of their buffers, and those that train in any case."""
    rows = folds.roles(units(spark, d), anchors(spark, d))
    return rows.groupBy("panel", "fold", "role").agg(F.count("*").alias("cells"), F.sum("lists").alias("lists"))


#: Terrain is the first two numbers of a vector; its bandwidth and that of habitat.
TERRAIN, WIDTHS = 2, (0.5, BANDWIDTH)
HABITAT_SQL = " + ".join(f"pow(a.s{g} - b.s{g}, 2)" for g in range(GROUPS))
PAIRS_SQL = f"""{SHARES_SQL}, tr AS (SELECT sh.*, e.embedding[1]::DOUBLE AS t0, e.embedding[2]::DOUBLE AS t1 FROM sh JOIN embeddings e USING (vec_id)),
pr AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS local, sqrt({HABITAT_SQL}) / sqrt(2) AS habitat, sqrt((pow(a.t0 - b.t0, 2) + pow(a.t1 - b.t1, 2)) / 2) AS terrain FROM tr a JOIN tr b ON a.vec_id <> b.vec_id),
el AS (SELECT *, sqrt(pow(habitat / {BANDWIDTH}, 2) + pow(terrain / {WIDTHS[0]}, 2)) AS joint, count(*) FILTER (local) OVER (PARTITION BY a) AS locals FROM pr WHERE habitat <= {RADIUS})"""


def neighbour_pools(rows, dims, radius, bounded=None):
    of = lambda own: nearest_rows(rows, "vec_id", "label", dims, NEAREST, radius, own, bounded)
    return kept(pools(of(True), of(False)), "neighbour-pools")


@query(f"""WITH {PAIRS_SQL}, ra AS (SELECT *, row_number() OVER (PARTITION BY a, local ORDER BY round(habitat, 12), b) AS r FROM el),
po AS (SELECT 'exclusive' AS policy, 'all' AS channel, *, 0 AS turn FROM ra WHERE local OR locals < {ENOUGH} UNION ALL SELECT 'reserved', 'all', *, CASE WHEN local AND r <= {ENOUGH} THEN 0 WHEN NOT local THEN 1 ELSE 2 END FROM ra UNION ALL SELECT 'channels', CASE WHEN local THEN 'own' ELSE 'other' END, *, 0 FROM ra),
rk AS (SELECT *, row_number() OVER (PARTITION BY policy, channel, a ORDER BY turn, round(habitat, 12), b) AS k FROM po)
SELECT policy, channel, a, count(*) AS neighbours, count(*) FILTER (local) AS locals, round(sum(exp(-0.5 * pow(habitat / {BANDWIDTH}, 2))), 6) AS weight, CAST(sum(b * k) AS BIGINT) AS ids FROM rk WHERE k <= {NEAREST} GROUP BY ALL""", bound=False)
def neighbour_policies(spark, d):
    """Each cell's neighbours by habitat under three policies: how many, how many of its own label, their weight, and their ids by rank."""
    dims = [f"s{g}" for g in range(GROUPS)]
    rows = policies(neighbour_pools(habitat_shares(spark, d).withColumns({c: F.col(c) / 2**0.5 for c in dims}), dims, RADIUS))
    weight = F.exp(-0.5 * F.pow(F.col("dist") / BANDWIDTH, 2))
    return rows.groupBy("policy", "channel", "a").agg(F.count("*").alias("neighbours"), F.count_if("local").alias("locals"), F.round(F.sum(weight), 6).alias("weight"), F.sum(F.col("b") * F.col("rank")).alias("ids"))


@query(f"""WITH {PAIRS_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(joint, 12), b) AS k FROM el WHERE local OR locals < {ENOUGH})
SELECT a, max(CASE WHEN locals < {ENOUGH} THEN 'all' ELSE 'own' END) AS scope, count(*) AS neighbours, round(min(joint), 6) AS nearest, round(max(joint), 6) AS farthest, round(sum(exp(-0.5 * joint * joint)), 6) AS weight, CAST(sum(b * k) AS BIGINT) AS ids FROM rk WHERE k <= {NEAREST} GROUP BY a""", bound=False)
def terrain_neighbours(spark, d):
    """Each cell's neighbours by habitat and terrain together, among those alike enough in habitat. The weight is the product of both kernels, so its
    distance is that of the vectors put side by side, each by its bandwidth."""
    terrain = table(spark, d, "embeddings").select("vec_id", *[(F.get("embedding", F.lit(i)).cast("double") / (TERRAIN**0.5 * WIDTHS[0])).alias(f"t{i}") for i in range(TERRAIN)])
    dims = [f"s{g}" for g in range(GROUPS)]
    shares = habitat_shares(spark, d).withColumns({c: F.col(c) / (2**0.5 * BANDWIDTH) for c in dims})
    rows = chosen(neighbour_pools(shares.join(terrain, "vec_id"), [*dims, *[f"t{i}" for i in range(TERRAIN)]], RADIUS / BANDWIDTH, GROUPS))
    return rows.groupBy("a").agg(
        F.max(F.when(F.col("locals") < ENOUGH, "all").otherwise("own")).alias("scope"), F.count("*").alias("neighbours"), F.round(F.min("dist"), 6).alias("nearest"), F.round(F.max("dist"), 6).alias("farthest"),
        F.round(F.sum(F.exp(-0.5 * F.col("dist") * F.col("dist"))), 6).alias("weight"), F.sum(F.col("b") * F.col("rank")).alias("ids"),
    )
