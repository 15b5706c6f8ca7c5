"""Events and hotspots on small tables whose answers are known."""

import datetime

from pyspark.sql import functions as F

from fieldmark.operators import events, hotspots
from fieldmark.operators.places import ring
from fieldmark.sources.shared import kept

SHAPE = "taxon int, report_id int, observer int, day date, x long, y long, weight double"


def at(day, x=0, y=0, observer=1, taxon=1, year=2020, report=None, weight=0.5):
    when = datetime.date(year, 1, 1) + datetime.timedelta(day - 1)
    return (taxon, report if report is not None else day * 1000 + x * 10 + y, observer, when, x, y, weight)


def found(spark, rows, cap=1.0):
    detections = spark.createDataFrame(rows, SHAPE)
    evidence = events.clustered(events.independent(detections))
    taxa = events.taxon_events(evidence)
    return detections, evidence, taxa, events.numbered_events(evidence, taxa, cap)


CASES = [
    ([at(1), at(4)], [2]), ([at(1), at(5)], [1, 1]), ([at(1), at(4), at(7)], [3]),  # three days chain, four don't
    ([at(1), at(1, 1, 1)], [2]), ([at(1), at(1, 2, 0)], [1, 1]), ([at(1), at(2, 1), at(3, 2)], [3]),  # one ring chains, two don't
    ([at(1), at(4, 2)], [1, 1]), ([at(365), at(1, year=2021)], [2]),  # both at once; over the turn of the year
    ([at(1), at(1, report=9), at(1, observer=2)], [2]),  # one observer, day and cell is one signal
    ([at(1, observer=None, report=1), at(1, observer=None, report=2), at(1, observer=None, report=2)], [2]),  # without an observer a report stands for one
]


def test_what_chains(spark):
    """Each case is a taxon of its own, so taxa don't chain either."""
    rows = [(k, *r[1:]) for k, (case, _) in enumerate(CASES) for r in case]
    events_of = found(spark, rows)[3].orderBy("taxon", "number").collect()
    assert [[r["independent"] for r in events_of if r["taxon"] == k] for k in range(len(CASES))] == [want for _, want in CASES]
    assert found(spark, [])[3].count() == 0


def test_dominance_years_and_reasons(spark):
    def rows(taxon, near, far, years=(2020, 2021)):
        one = [at(10, observer=k, taxon=taxon, year=years[0]) for k in range(near)]
        return one + [at(40 + 9 * k, observer=50, taxon=taxon, year=years[-1]) for k in range(far)]

    _, _, taxa, _ = found(spark, rows(1, 8, 2) + rows(2, 7, 3) + rows(3, 7, 3, (2020,)) + rows(4, 8, 2, (2020,)))
    got = {r["taxon"]: (round(r["share"], 2), r["candidate"], r["reason"]) for r in taxa.collect()}
    assert got == {1: (0.8, True, "event_dominated"), 2: (0.7, False, None), 3: (0.7, True, "single_support_year"), 4: (0.8, True, "event_dominated_and_single_support_year")}


def test_caps_and_numbers_dont_depend_on_order(spark):
    rows = [at(1, observer=k) for k in range(4)] + [at(30), at(1, taxon=2), at(60, taxon=2, year=2021)] + [at(200, taxon=2, year=2022, observer=k, weight=3.0) for k in range(2)]
    out = []
    for order in (rows, rows[::-1]):
        detections, evidence, _, found_events = found(spark, order)
        out.append(sorted(map(str, events.weighed(detections, evidence, found_events).select("taxon", "report_id", "observer", "number", F.round("effective", 6)).collect())))
        total = {(r["taxon"], r["number"]): round(r["w"], 6) for r in events.weighed(detections, evidence, found_events).groupBy("taxon", "number").agg(F.sum("effective").alias("w")).collect()}
        # Taxon 1 has one year, so its event of weight 2 counts as 1; taxon 2 is no candidate and keeps its 6.
        assert total == {(1, 1): 1.0, (1, 2): 0.5, (2, 1): 0.5, (2, 2): 0.5, (2, 3): 6.0}
    assert out[0] == out[1]


def windows_of(spark, rows):
    shape = "taxon string, level string, unit string, start int, end int, peak_day int, score double"
    df = spark.createDataFrame([("t", *r) for r in rows], shape)
    part = lambda i: F.when(F.col("level") == "grid", F.split_part("unit", F.lit(":"), F.lit(i)).cast("bigint"))
    x, y = part(1), part(2)
    return df.withColumns({"x": x, "y": y}).withColumns({"west": F.coalesce("x", F.lit(50)).cast("double"), "south": F.coalesce("y", F.lit(5)).cast("double"), "east": F.coalesce("x", F.lit(50)) + 1.0, "north": F.coalesce("y", F.lit(5)) + 1.0})


def merged(spark, rows, **more):
    return [(r["unit"], r["start"], r["end"], r["score"], r["members"]) for r in hotspots.merged(windows_of(spark, rows), **more).orderBy("rank").collect()]


def test_windows_that_touch_are_one_hotspot(spark):
    # Each case is a taxon of its own.
    cases = [
        ([("city", "A", 10, 20, 15, 0.5), ("city", "A", 27, 40, 30, 0.4)], [("A", 10, 40, 0.5, ["A"])]),  # seven days apart
        ([("city", "A", 10, 20, 15, 0.5), ("city", "A", 28, 40, 30, 0.4)], [("A", 10, 20, 0.5, ["A"]), ("A", 28, 40, 0.4, ["A"])]),  # eight
        ([("city", "A", 350, 362, 355, 0.5), ("city", "A", 3, 9, 5, 0.6)], [("A", 350, 9, 0.6, ["A"])]),  # over the turn of the year
        ([("city", "A", 1, 365, 5, 0.5), ("city", "A", 100, 101, 100, 0.5)], [("A", 1, 365, 0.5, ["A"])]),
        ([("grid", "1:1", 10, 20, 15, 0.3), ("grid", "2:2", 15, 30, 20, 0.4), ("grid", "3:3", 30, 33, 31, 0.2)], [("2:2", 10, 33, 0.4, ["1:1", "2:2", "3:3"])]),  # corners
        ([("grid", "1:1", 10, 20, 15, 0.3), ("grid", "3:1", 10, 20, 15, 0.5), ("city", "1:1", 10, 20, 15, 0.4), ("city", "2:1", 10, 20, 15, 0.2)], [("3:1", 10, 20, 0.5, ["3:1"]), ("1:1", 10, 20, 0.4, ["1:1"]), ("1:1", 10, 20, 0.3, ["1:1"]), ("2:1", 10, 20, 0.2, ["2:1"])]),  # a cell between, cities, levels
    ]
    rows = None
    for k, (case, _) in enumerate(cases):
        one = windows_of(spark, case).withColumn("taxon", F.lit(f"t{k}"))
        rows = one if rows is None else rows.unionByName(one)
    got = hotspots.merged(rows).orderBy("taxon", "rank").collect()
    assert [[(r["unit"], r["start"], r["end"], r["score"], r["members"]) for r in got if r["taxon"] == f"t{k}"] for k in range(len(cases))] == [want for _, want in cases]


def test_the_box_the_rank_and_the_top(spark):
    rows = [("grid", f"{10 * k}:0", 10, 20, 15, 0.1 * (k % 3)) for k in range(6)] + [("grid", "1:1", 12, 30, 15, 0.9)]
    got = merged(spark, rows)
    assert [g[0] for g in got] == ["1:1", "20:0", "50:0", "10:0", "40:0", "30:0"]
    assert got[:2] == merged(spark, rows, top=2)
    best = hotspots.merged(windows_of(spark, rows)).filter("rank = 1").first()
    assert (best["west"], best["south"], best["east"], best["north"], best["members"]) == (0.0, 0.0, 2.0, 2.0, ["0:0", "1:1"])


def test_pairs_of_windows_against_days(spark):
    import itertools
    import random

    rng = random.Random(2)
    rows = list({("city", "A", rng.randint(1, 365), rng.randint(1, 365), 1, 0.1) for _ in range(60)})
    days = lambda s, e: {(s - 1 + i) % 365 for i in range((e - s) % 365 + 1)}
    want = sum(any((d + o) % 365 in days(*b[2:4]) for d in days(*a[2:4]) for o in range(-7, 8)) for a, b in itertools.combinations(rows, 2))
    ids = windows_of(spark, rows).withColumn("id", F.monotonically_increasing_id())
    assert hotspots.touching(kept(ids, "windows")).count() == want


def test_search_by_region_and_season(spark):
    spots = hotspots.merged(windows_of(spark, [("grid", "1:1", 350, 20, 3, 0.3), ("grid", "1:2", 1, 9, 3, 0.2), ("city", "A", 100, 120, 110, 0.4), ("city", "B", 59, 60, 60, 0.1)]))
    units = spark.createDataFrame([("grid", "1:1", "cell", "Anton", None), ("city", "A", "Anton", "Anton", "West"), ("city", "B", "Berta", None, "East")], "level string, unit string, name string, city_name string, district string")
    ask = lambda **k: {r["unit"] for r in hotspots.searched(spots, units, **k).collect()}
    assert ask() == {"1:1", "A", "B"} and ask(level="grid") == {"1:1"} and ask(code="1:2") == {"1:1"} and ask(name="Anton") == {"1:1", "A"} and ask(name="East") == {"B"}
    assert ask(season=(360, 5)) == {"1:1"} and ask(season=(20, 100)) == {"1:1", "A", "B"} and ask(season=(21, 58)) == set() and ask(looked_at=1) == {"A"}
    row = hotspots.searched(spots, units, code="1:2", year=2024).first()
    assert (str(row["first_date"]), str(row["last_date"]), str(row["peak_date"]), row["label"]) == ("2024-12-16", "2025-01-20", "2024-01-03", "12/16-1/20")
    leap = hotspots.searched(spots, units, code="B", year=2024).first()
    assert (str(leap["first_date"]), str(leap["last_date"])) == ("2024-02-28", "2024-03-01")


def test_ring_keeps_each_row_once_a_cell(spark):
    assert ring(spark.createDataFrame([(0, 0)], "x long, y long")).count() == 9


def test_only_spans_with_company_are_handed_around(spark, monkeypatch):
    """F1 to F3: lone detections go to no cell around, and many days of a cell go there as one span."""
    handed = []
    monkeypatch.setattr(events, "ring", lambda df, reach: handed.append(df.count()) or ring(df, reach))
    lone = [at(1 + 4 * k, x=k % 2, taxon=k % 5) for k in range(80)]
    crowd = [at(1 + d, taxon=9, x=x, observer=o) for d in range(40) for x in (0, 1) for o in (1, 2)]
    _, _, _, got = found(spark, lone + crowd)
    assert handed[:1] == [2] and got.filter("taxon = 9").count() == 1 and got.count() == 81


def test_chains_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [at(rng.randint(1, 300), rng.randint(0, 5), rng.randint(0, 5), observer=rng.randint(1, 3), taxon=rng.randint(1, 3), year=2019 + rng.randint(0, 1)) for _ in range(600)]
    nodes = sorted({(r[0], r[3].toordinal(), r[4], r[5]) for r in rows})
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and a[0] == b[0] and b[1] - a[1] <= 3 and abs(a[2] - b[2]) <= 1 and abs(a[3] - b[3]) <= 1:
                root[max(top(a), top(b))] = min(top(a), top(b))
    _, evidence, _, _ = found(spark, rows)
    by_event, want = {}, {}
    for r in evidence.collect():
        by_event.setdefault((r["taxon"], r["event"]), set()).add((r["taxon"], r["day"].toordinal(), r["x"], r["y"]))
    for n in nodes:
        want.setdefault(top(n), set()).add(n)
    assert sorted(map(sorted, by_event.values())) == sorted(map(sorted, want.values())) and max(map(len, want.values())) > 5
