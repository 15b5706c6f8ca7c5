"""Balanced folds and pairs of panels whose buffers don't touch."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.core import top_k
from fieldmark.operators.numbering import numbered
from fieldmark.operators.places import ring
from fieldmark.sources.shared import kept

# Shares of support that cities aim at in turn, folds of a panel, states that a search may visit.
TARGETS, FOLDS, STATES = (0.25, 0.5, 0.75), 5, 500_000
PANELS = ("development", "sealed-release")


def turns(loads: list[int], load: int, items: int) -> list[tuple[int, int, list[int]]]:
    """How `items` equal items go to the least loaded fold each, the lower number among equals: runs (first, length, folds),
    in which item i goes to folds[(i - first) % len(folds)]. Adds to loads. At most one run a fold, and a last one for the rest.

    Folds within one item of the least take turns in the order of their loads, until the next fold above is reached.
    """
    out, first = [], 0
    while first < items:
        order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
        low = order[0]
        active = [f for f in order if (loads[f], f) < (loads[low] + load, low)] if load else [low]
        last, above = active[-1], order[len(active)] if len(active) < len(order) and load else None
        rounds = items
        if above is not None:
            gap = loads[above] - loads[last]
            rounds = gap // load + (1 if gap % load or last < above else 0)
        length = min(items - first, rounds * len(active))
        out.append((first, length, active))
        for i, f in enumerate(active):
            loads[f] += load * ((length - i + len(active) - 1) // len(active))
        first += length
    return out


def least_loaded(df: DataFrame, id: str, load: str, folds: int) -> DataFrame:
    """df with fold (0 up): rows in falling order of load, then by id, go to the fold of the least load, the lower number among equals.

    The exact greedy over a summary: how many rows have each load. Its rows grow with the square root of the total load
    at most (different loads add up), and rows of one load go in turns, so only the summary passes the driver; rows find
    their turn by their number. load: whole numbers, null counts as 0. id must tell rows apart. Fewer rows than folds use as many folds as there are rows.
    """
    rows = df.withColumn("_load", F.coalesce(F.col(load).cast("bigint"), F.lit(0))).withColumn("_fall", -F.col("_load"))
    rows = numbered(rows, "_place", "_fall", id)
    counts = sorted(((r["_load"], r["n"]) for r in rows.groupBy("_load").agg(F.count("*").alias("n")).collect()), reverse=True)
    loads = [0] * min(folds, sum(n for _, n in counts))
    runs, before = [], 1
    for value, n in counts:
        runs.append((value, [(before + a, before + a + k, of) for a, k, of in turns(loads, value, n)]))
        before += n
    table = df.sparkSession.createDataFrame(runs, "_load bigint, _runs array<struct<a: bigint, b: bigint, of: array<int>>>")
    run = F.element_at(F.filter("_runs", lambda r: (F.col("_place") >= r["a"]) & (F.col("_place") < r["b"])), 1)
    fold = F.get(run["of"], F.pmod(F.col("_place") - run["a"], F.size(run["of"])))
    return rows.join(table, "_load").withColumn("fold", fold).drop("_load", "_fall", "_place", "_runs")


def hashed(*parts) -> str:
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


def ranked_by_support(candidates: DataFrame) -> DataFrame:
    """candidates (unit, city, lists, observers) with quantile: the place in its city by lists, observers and unit, from 0 to 1; 0.5 if alone.

    Places come from ranges of all candidates, so a city with very many has no task of its own.
    """
    rows = numbered(candidates, "_place", "city", "lists", "observers", "unit")
    of = rows.groupBy("city").agg(F.min("_place").alias("_least"), F.count("*").alias("_n"))
    share = F.when(F.col("_n") == 1, 0.5).otherwise((F.col("_place") - F.col("_least")) / (F.col("_n") - 1))
    return rows.join(of, "city").withColumn("quantile", share).drop("_place", "_least", "_n")


class Exhausted(Exception):
    """A search came to the end of a city's shortlist with candidates left beyond it."""


class Board:
    """The shortlists of all cities and panels, which candidates stand in each other's way, and what is taken.

    totals: candidates a city. shortlists: {(city, panel): [unit, ...]}, best first. blocks: {unit: {city: units within two
    cells of it}}, itself included, so that candidates left are counted exactly, also those on no shortlist.
    """

    def __init__(self, totals, shortlists, blocks):
        self.totals, self.shortlists, self.blocks = totals, shortlists, blocks
        self.taken, self.blocked = [], defaultdict(lambda: defaultdict(int))

    def take(self, unit):
        self.taken.append(unit)
        for city, units in self.blocks[unit].items():
            for u in units:
                self.blocked[city][u] += 1

    def release(self):
        for city, units in self.blocks[self.taken.pop()].items():
            for u in units:
                self.blocked[city][u] -= 1
                if not self.blocked[city][u]:
                    del self.blocked[city][u]

    def left(self, city):
        return self.totals[city] - len(self.blocked[city])

    def choices(self, city, panel):
        """Candidates that are free, best first; raises where the list ends before the city's candidates do."""
        seen = 0
        for unit in self.shortlists[city, panel]:
            if unit not in self.blocked[city]:
                seen += 1
                yield unit
        if seen < self.left(city):
            raise Exhausted


def searched(board: Board, cities: list, seed: str, states: int) -> dict:
    """{panel: {city: unit}} by depth-first search: development in the order of candidates, each leaving its city another for the
    sealed panel; then sealed, always the city with the fewest candidates left. None where there is no such choice."""
    first = sorted(cities, key=lambda c: (board.totals[c], hashed(seed, "development-order", c), c))
    order = {c: hashed(seed, "sealed-order", c) for c in cities}
    chosen, open_, visited = [], [], 0

    def step():
        n = len(chosen)
        if n < len(first):
            return first[n], PANELS[0]
        done = {c for c, panel, _ in chosen if panel == PANELS[1]}
        return min((c for c in cities if c not in done), key=lambda c: (board.left(c), order[c], c)), PANELS[1]

    open_.append((*step(), None))
    while open_:
        city, panel, options = open_.pop()
        if options is None:
            visited += 1
            if visited > states:
                raise ValueError(f"no panels found in {states} states")
            # Read one by one: whenever the search is back here, the board is as it was at the first of them.
            options = board.choices(city, panel)
        elif chosen and chosen[-1][:2] == (city, panel):
            chosen.pop()
            board.release()
        for unit in options:
            board.take(unit)
            if panel == PANELS[0] and not board.left(city):
                board.release()
                continue
            chosen.append((city, panel, unit))
            open_.append((city, panel, options))
            if len(chosen) == 2 * len(cities):
                return {p: {c: u for c, q, u in chosen if q == p} for p in PANELS}
            open_.append((*step(), None))
            break
    return None


def split_panels(candidates: DataFrame, seed: str, shortlist: int = 32, states: int = STATES) -> DataFrame:
    """Two anchors of each city, one a panel: unit, city, x, y, lists, observers, quantile, target, panel.

    candidates: unit, city, lists, observers, and their cell x, y; a unit has one city and cell. Cities aim at shares of
    support in turn, in an order by hash; an anchor's candidates go by their distance to that share. Anchors' buffers (the
    cells around) don't touch, so anchors are three cells apart. A city with fewer than two candidates: ValueError, likewise where there are no such panels.

    The driver gets the `shortlist` best of each city and panel and who is within two cells of them; where the search needs more, the list is
    doubled and the search begins again, so the answer is that over all candidates.
    """
    rows = kept(ranked_by_support(candidates.select("unit", "city", "x", "y", "lists", "observers")), "split-candidates")
    totals = {r["city"]: r["n"] for r in rows.groupBy("city").agg(F.count("*").alias("n")).collect()}
    if short := sorted(c for c, n in totals.items() if n < 2):
        raise ValueError(f"fewer than two candidates in {short}")
    cities = sorted(totals, key=lambda c: (hashed(seed, "city-target", c), c))
    aims = [(c, panel, TARGETS[(i + (panel == PANELS[0])) % len(TARGETS)]) for i, c in enumerate(cities) for panel in PANELS]
    spark, kind = candidates.sparkSession, rows.schema["city"].dataType.simpleString()
    aimed = rows.join(spark.createDataFrame(aims, f"city {kind}, panel string, target double"), "city")
    text = lambda c: F.col(c).cast("string")
    order = F.round(F.abs(F.col("quantile") - F.col("target")), 12), F.sha2(F.concat_ws("\0", F.lit(seed), "panel", text("city"), text("unit")), 256), F.col("unit")
    while True:
        best = kept(top_k(aimed, ["city", "panel"], shortlist, *order), "split-shortlists")
        lists = defaultdict(list)
        for r in best.select("city", "panel", "unit").orderBy("city", "panel", "rank").collect():
            lists[r["city"], r["panel"]].append(r["unit"])
        near = ring(best.select(F.col("unit").alias("of"), "x", "y").distinct(), 2)
        blocks = defaultdict(lambda: defaultdict(list))
        for r in near.join(rows.select("unit", "city", "x", "y"), ["x", "y"]).select("of", "unit", "city").collect():
            blocks[r["of"]][r["city"]].append(r["unit"])
        try:
            found = searched(Board(totals, lists, blocks), cities, seed, states) if cities else {p: {} for p in PANELS}
        except Exhausted:
            shortlist *= 2
            continue
        if found is None:
            raise ValueError("no panels whose buffers don't touch")
        picked = spark.createDataFrame([(panel, u) for panel, of in found.items() for u in of.values()], f"panel string, unit {rows.schema['unit'].dataType.simpleString()}")
        return best.join(picked, ["panel", "unit"]).drop("rank")


def balanced(anchors: DataFrame, seed: str, folds: int = FOLDS) -> DataFrame:
    """anchors (panel, unit, lists, observers) with fold (1 up) within their panel: by falling lists and observers, each to the fold with the fewest
    anchors, then lists, then observers, ties by hash. Anchors are two a city and go through the driver as such."""
    spark, out = anchors.sparkSession, []
    by_panel = defaultdict(list)
    for r in anchors.select("panel", "unit", "lists", "observers").collect():
        by_panel[r["panel"]].append(r)
    for panel, rows in by_panel.items():
        if not 2 <= folds <= len(rows):
            raise ValueError(f"{folds} folds for {len(rows)} anchors of {panel}")
        sums = [[0, 0, 0] for _ in range(folds)]  # anchors, lists, observers
        for r in sorted(rows, key=lambda r: (-r["lists"], -r["observers"], hashed(seed, panel, "fold-anchor", r["unit"]))):
            k = min(range(folds), key=lambda f: (*sums[f], hashed(seed, panel, "fold", f + 1, r["unit"])))
            sums[k] = [a + b for a, b in zip(sums[k], (1, r["lists"], r["observers"]))]
            out.append((panel, r["unit"], k + 1))
    return anchors.join(spark.createDataFrame(out, f"panel string, unit {anchors.schema['unit'].dataType.simpleString()}, fold int"), ["panel", "unit"])


def roles(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """cells (x, y) with panel, fold and role: anchor, buffer (in the ring of one) or training. Buffers don't touch, so a cell has one anchor at most."""
    near = ring(anchors.select("x", "y", F.col("x").alias("ax"), F.col("y").alias("ay"), "panel", "fold"))
    role = F.when(F.col("ax").isNull(), "training").when((F.col("ax") == F.col("x")) & (F.col("ay") == F.col("y")), "anchor").otherwise("buffer")
    return cells.join(near, ["x", "y"], "left").withColumn("role", role).drop("ax", "ay")
