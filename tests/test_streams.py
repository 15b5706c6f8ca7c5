"""The ingest streams: one batch, ten batches, a restart in between and a batch that runs twice must all end alike."""

import collections
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldmark.streaming import ingest

SHAPE = "source long, page long, seq long, report_id string, origin string, n double"


def made():
    rng = random.Random(4)
    rows = []
    for page in [p for p in range(1, 41) if p not in (17, 33)]:
        for source in (1, 2):
            for _ in range(rng.randint(1, 6)):
                rows.append([source, page, 0, rng.choice((None, "", " 5 ", str(rng.randint(1, 60)))), f"o{page}", rng.choice((None, 2.0, 3.0, 4.0, 5.0))])
    rows += [[2, 33, 0, "77", "late", 1.0], [3, 2, 0, "78", "o", 1.0]]
    # Pages come out of order, but not far from their place.
    rows.sort(key=lambda r: r[1] + rng.randint(-3, 3) if r[4] != "late" else 99)
    for seq, r in enumerate(rows):
        r[2] = seq
    return [tuple(r) for r in rows]


ROWS, SAVED = made(), {"5", "7", "9", "11"}


def written(spark, path, rows, batches):
    """The feed's rows as files in the order of their names and times."""
    os.makedirs(path, exist_ok=True)
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SHAPE).coalesce(1).write.mode("overwrite").parquet(f"{path}.{k}")
        file = glob.glob(f"{path}.{k}/*.parquet")[0]
        to = f"{path}/{len(os.listdir(path)):03d}.parquet"
        os.rename(file, to)
        os.utime(to, (1_700_000_000 + len(os.listdir(path)),) * 2)


def run(spark, feed, out):
    rows = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(feed)
    saved = spark.createDataFrame([(x,) for x in SAVED], "report_id string")
    events = rows.select("source", "seq", "page", F.col("seq").alias("rows"), (F.col("seq") * 2).alias("total"), "origin")
    for stream in (
        ingest.claims(rows, saved, out), ingest.arrivals(rows, out), ingest.watermarks(rows.select("source", "page"), out), ingest.progress(events, out),
        ingest.running_totals(rows, "source long, origin string", "n", out),
    ):
        stream.awaitTermination()


def results(spark, out):
    plain = lambda df: sorted(map(str, df.collect()))
    return {
        "claims": plain(ingest.claimed(spark, out).select("report_id", "reason")), "counts": plain(ingest.claim_counts(spark, out)), "current": plain(ingest.current(spark, out)),
        "progress": plain(ingest.progressed(spark, out)), "totals": plain(ingest.totals(spark, out, "source long, origin string")),
    }


def expected():
    seen, reasons = set(), collections.Counter()
    for r in ROWS:
        i = (r[3] or "").strip()
        reason = "missing" if not i else "duplicate" if i in seen else "existing" if i in SAVED else "claimed"
        seen.add(i)
        reasons[reason] += 1
    current, top, total = {}, {}, {}
    done = collections.defaultdict(set)
    for source, page, seq, _, origin, _ in ROWS:
        done[source].add(page)
        now = current.setdefault(source, 0)
        while now + 1 in done[source]:
            now += 1
        current[source] = now
        if page > top.get(source, (0,))[0]:
            top[source] = (page, seq, origin)
        total[source] = seq * 2
    return reasons, current, {s: (*top[s], total[s]) for s in top}


@pytest.fixture(scope="module")
def once(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("once"))
    written(spark, f"{where}/feed", ROWS, 1)
    run(spark, f"{where}/feed", f"{where}/out")
    return results(spark, f"{where}/out")


def test_one_batch_is_right(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("right"))
    written(spark, f"{where}/feed", ROWS, 1)
    run(spark, f"{where}/feed", f"{where}/out")
    reasons, current, top = expected()
    out = f"{where}/out"
    assert {r["reason"]: r["n"] for r in ingest.claim_counts(spark, out).collect()} == dict(reasons)
    assert {r["source"]: r["current"] for r in ingest.current(spark, out).collect()} == current and current[1] == 16 and current[2] == 16 and current[3] == 0
    assert {r["source"]: (r["page"], r["rows"], r["origin"], r["total"]) for r in ingest.progressed(spark, out).collect()} == top
    want = collections.defaultdict(list)
    for r in ROWS:
        want[r[0], r[4]].append(r[5])
    got = {(r["source"], r["origin"]): (r["rows"], r["total"]) for r in ingest.totals(spark, out, "source long, origin string").collect()}
    assert got == {k: (len(v), None if None in v else sum(v)) for k, v in want.items()}


def test_ten_batches_a_restart_and_a_batch_run_twice(spark, once, tmp_path):
    feed, out = f"{tmp_path}/feed", f"{tmp_path}/out"
    half = len(ROWS) // 2
    written(spark, feed, ROWS[:half], 5)
    run(spark, feed, out)
    marks = {r["source"]: r["current"] for r in ingest.current(spark, out).collect()}
    # The last batch of each stream isn't known to have ended, as after a failure.
    for stream in ("first", "rows", "pages", "events", "shares"):
        commits = sorted((p for p in glob.glob(f"{out}/{stream}/checkpoint/commits/*") if p.rsplit("/", 1)[1].isdigit()), key=lambda p: int(p.rsplit("/", 1)[1]))
        os.remove(commits[-1])
        os.remove("/.".join(commits[-1].rsplit("/", 1)) + ".crc")
    written(spark, feed, ROWS[half:], 5)
    run(spark, feed, out)
    assert results(spark, out) == once
    later = {r["source"]: r["current"] for r in ingest.current(spark, out).collect()}
    assert all(later[s] >= marks[s] for s in marks)


def test_pages_read_again_change_nothing_but_the_duplicates(spark, once, tmp_path):
    feed, out = f"{tmp_path}/feed", f"{tmp_path}/out"
    written(spark, feed, ROWS, 1)
    run(spark, feed, out)
    pages = {r["source"]: r["resume"] for r in ingest.progressed(spark, out).withColumn("resume", ingest.resume_page(F.col("page"))).collect()}
    assert pages == {1: 36, 2: 36, 3: 1}
    again = [r for r in ROWS if r[1] >= pages[r[0]]]
    written(spark, feed, [(*r[:2], r[2] + 1000, *r[3:]) for r in again], 1)
    run(spark, feed, out)
    now = results(spark, out)
    assert [now[k] for k in ("claims", "current")] == [once[k] for k in ("claims", "current")]
    counts = {r["reason"]: r["n"] for r in ingest.claim_counts(spark, out).collect()}
    reasons = expected()[0]
    named = sum(bool((r[3] or "").strip()) for r in again)
    assert counts == {**reasons, "duplicate": reasons["duplicate"] + named, "missing": reasons["missing"] + len(again) - named}


def test_a_watermark_starts_where_it_was_told_and_never_falls(spark):
    now = spark.createDataFrame([(1, 2)], "source long, current long")
    step = lambda pages: ingest.advanced(now, spark.createDataFrame(pages, "source long, page long"))
    for pages, want, left in (([(1, 4), (1, 5)], 2, {4, 5}), ([(1, 3), (1, 4), (1, 5), (1, 5)], 5, set()), ([(1, 1), (1, 2)], 2, set()), ([], 2, set())):
        moved, waiting = step(pages)
        assert [r["current"] for r in moved.collect()] == [want] and {r["page"] for r in waiting.collect()} == left


def test_no_feed(spark, tmp_path):
    os.makedirs(f"{tmp_path}/feed")
    run(spark, f"{tmp_path}/feed", f"{tmp_path}/out")
    assert all(not v for v in results(spark, f"{tmp_path}/out").values())
    assert spark.range(1).select(ingest.resume_page(F.lit(20)).alias("p"), ingest.resume_page(F.lit(3)).alias("q"), ingest.resume_page(F.lit(None)).alias("r")).first() == (16, 1, 1)
