"""Registered queries of the ingest: raw JSON as feeds send it (made from the tables), typed, merged and written."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.plans.checklist_queries import day, query
from fieldmark.sources.imports import imported
from fieldmark.sources.ingest import checklists_of, coordinates, merged, observations_of, replaced, unwrapped
from fieldmark.sources.shared import kept, shared_dir
from fieldmark.sources.tables import checklists, observations, observers, taxa


def raw_checklists(spark, d):
    """report_id, raw, kind: checklists as three feeds send them, each with its own names and way to give coordinates, with their taxa
    as a JSON array (missing for lists without rows)."""
    feed = F.col("report_id") % 3
    o = observations(spark, d)
    taxon = F.when(F.col("idx") % 2 == 0, F.to_json(F.struct(F.col("taxon").cast("string").alias("taxon_id"), F.col("n").alias("count"), F.col("red").cast("int").alias("outside_type"))))
    taxon = taxon.otherwise(F.to_json(F.struct(F.lit(" ").alias("taxon_id"), F.concat(F.lit(" T"), "taxon").alias("taxonname"), F.col("n").cast("string").alias("taxonCount"), F.when(F.col("red"), "1").otherwise("x").alias("outside_type"))))
    lists = o.groupBy("report_id").agg(F.count("*").alias("rows"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "taxon", "n", taxon.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("taxa"))
    c = checklists(spark, d).join(observers(spark, d), "observer").join(lists, "report_id", "left")
    key, when = F.col("report_id").cast("string"), F.concat(F.lit(" "), day("day"), F.lit(" 08:00 "))
    first = F.to_json(F.struct(key.alias("reportId"), when.alias("start_time"), F.col("city").cast("string").alias("city_name"), F.col("rows").alias("taxoncount"), F.array("lon", "lat").alias("location"), "taxa"))
    second = F.to_json(F.struct(F.lit("").alias("reportId"), key.alias("request_id"), when.alias("startTime"), F.col("city").cast("string").alias("cityName"), F.col("rows").cast("string").alias("taxon_count"), F.struct(F.col("lon").alias("lng"), "lat").alias("location"), "taxa"))
    third = F.to_json(F.struct(F.lit("").alias("request_id"), key.alias("id"), when.alias("startTime"), F.col("city").alias("city"), F.lit("many").alias("taxonCount"), F.concat_ws(",", "lon", "lat").alias("location"), "taxa"))
    return c.select("report_id", F.when(feed == 0, first).when(feed == 1, second).otherwise(third).alias("raw"), F.when(F.col("state") == "F", "flagged").otherwise("normal").alias("kind"))


def typed(spark, d):
    """The raw rows, landed in the shared folder, as typed rows."""
    return checklists_of(kept(raw_checklists(spark, d).drop("report_id"), "raw"), "raw", F.col("kind"))


TAXA_SQL = "SELECT report_id, taxon, n, red, row_number() OVER (PARTITION BY report_id ORDER BY idx, taxon, n) - 1 AS place, idx % 2 = 0 AS by_id, state = 'F' AS flagged FROM ob JOIN cl USING (report_id) JOIN pp USING (observer)"


@query("""SELECT CAST(c.report_id AS VARCHAR) AS report_id, concat(strftime(day, '%Y-%m-%d'), ' 08:00') AS start_time, CAST(city AS VARCHAR) AS city_name, CASE WHEN state = 'F' THEN 'flagged' ELSE 'normal' END AS report_kind,
CAST(CASE WHEN c.report_id % 3 = 2 THEN 0 ELSE coalesce(rows, 0) END AS BIGINT) AS taxon_count_reported, round(lon, 6) AS longitude, round(lat, 6) AS latitude
FROM cl c JOIN pp USING (observer) LEFT JOIN (SELECT report_id, count(*) AS rows FROM ob GROUP BY report_id) r ON r.report_id = c.report_id""")
def ingest_checklists(spark, d):
    """Raw checklists of three feeds with their own field names, blanks, numbers as text and three ways to give coordinates, as typed rows."""
    return typed(spark, d).select("report_id", "start_time", "city_name", "report_kind", "taxon_count_reported", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


@query(f"""WITH t AS ({TAXA_SQL}) SELECT CAST(report_id AS VARCHAR) AS report_id, CAST(place AS BIGINT) AS raw_index, CASE WHEN by_id THEN CAST(taxon AS VARCHAR) ELSE concat('T', taxon) END AS taxon_key, CAST(n AS BIGINT) AS taxon_count, CASE WHEN red THEN 1 ELSE 0 END AS is_red
FROM t WHERE NOT (flagged AND red)""")
def ingest_observations(spark, d):
    """The taxa of raw checklists: one row an element, keyed by id, else by name; excluded ones of flagged lists go."""
    rows = observations_of(typed(spark, d), "taxa", F.col("report_kind") == "flagged", ["report_id"])
    return rows.select("report_id", F.col("raw_index").cast("bigint").alias("raw_index"), "taxon_key", "taxon_count", "is_red")


@query(f"""WITH t AS ({TAXA_SQL}), g AS (SELECT report_id, count(*) AS rows, count(*) FILTER (flagged AND red) AS dropped FROM t GROUP BY report_id)
SELECT CAST(c.report_id AS VARCHAR) AS report_id, coalesce(rows, 0) - coalesce(dropped, 0) AS saved, coalesce(dropped, 0) AS dropped FROM cl c JOIN pp USING (observer) LEFT JOIN g USING (report_id)""")
def ingest_dropped(spark, d):
    """How many rows of each raw checklist are saved and how many go, counted inside the row, without exploding it."""
    raw = typed(spark, d).withColumn("types", F.transform(F.from_json("taxa", "array<struct<outside_type:string>>"), lambda x: x["outside_type"].try_cast("double")))
    gone = F.when(F.col("report_kind") == "flagged", F.size(F.filter("types", lambda x: F.coalesce(x == 1, F.lit(False))))).otherwise(0)
    dropped = F.when(F.col("types").isNull(), 0).otherwise(gone)
    return raw.select("report_id", (F.coalesce(F.size("types"), F.lit(0)) - dropped).cast("bigint").alias("saved"), dropped.cast("bigint").alias("dropped")).withColumn("saved", F.greatest("saved", F.lit(0).cast("bigint")))


@query("""SELECT report_id, CASE WHEN report_id % 2 = 0 THEN concat('P', observer) ELSE '' END AS point_id, CASE WHEN report_id % 2 = 0 AND observer % 5 > 0 THEN round(lon, 6) END AS longitude, CASE WHEN report_id % 2 = 0 AND observer % 5 > 0 THEN round(lat, 6) END AS latitude, CASE WHEN report_id % 2 = 0 THEN 1 ELSE 0 END AS fetched FROM cl JOIN pp USING (observer)""")
def detail_merge(spark, d):
    """Checklists with the point and coordinates of their fetched detail, where one has been fetched; broken coordinates are null."""
    c = checklists(spark, d).join(observers(spark, d), "observer")
    where = F.when(F.col("observer") % 5 == 0, "hidden").otherwise(F.concat_ws(",", "lon", "lat"))
    detail = c.filter("report_id % 2 = 0").select("report_id", F.concat(F.lit("P"), "observer").alias("point_id"), where.alias("location"))
    lon, lat = coordinates(F.col("location"))
    detail = detail.select("report_id", "point_id", lon.alias("longitude"), lat.alias("latitude"), F.lit(1).alias("fetched"))
    return c.select("report_id").join(detail, "report_id", "left").select("report_id", F.coalesce("point_id", F.lit("")).alias("point_id"), F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"), F.coalesce("fetched", F.lit(0)).alias("fetched"))


@query("""WITH s AS (SELECT report_id, day, state FROM cl WHERE report_id % 3 <> 0), n AS (SELECT report_id, day + 1 AS day, 'new' AS state FROM cl WHERE report_id % 2 = 0 UNION ALL SELECT report_id, day + 2, 'newer' FROM cl WHERE report_id % 4 = 0),
l AS (SELECT report_id, arg_max({'day': day, 'state': state}, day) AS r FROM n GROUP BY report_id)
SELECT report_id, strftime(day, '%Y-%m-%d') AS day, state FROM (SELECT * FROM s WHERE report_id NOT IN (SELECT report_id FROM l) UNION ALL SELECT report_id, r.day, r.state FROM l)""")
def checklist_merge(spark, d):
    """A stored table after an upsert of new and repeated checklists: the last write of a key counts, others stay."""
    c = checklists(spark, d).select("report_id", "day", "state")
    again = lambda k, days, state: c.filter(f"report_id % {k} = 0").select("report_id", F.date_add("day", days).alias("day"), F.lit(state).alias("state"))
    return merged(c.filter("report_id % 3 <> 0"), again(2, 1, "new").unionByName(again(4, 2, "newer")), "report_id", "day").select("report_id", day("day").alias("day"), "state")


@query("""SELECT report_id, taxon, n FROM ob WHERE report_id % 5 <> 0 UNION ALL SELECT report_id, taxon, n + 1 FROM ob WHERE report_id % 10 = 0""")
def child_rows_replaced(spark, d):
    """Observations after some checklists were saved again: their old rows go, also where nothing new came."""
    o = observations(spark, d).select("report_id", "taxon", "n")
    new = o.filter("report_id % 10 = 0").withColumn("n", F.col("n") + 1)
    return replaced(o, new, "report_id", checklists(spark, d).filter("report_id % 5 = 0"))


@query("""SELECT report_id, 'saved' AS event, coalesce(n, 0) AS rows FROM cl LEFT JOIN (SELECT report_id, count(*) AS n FROM ob GROUP BY report_id) USING (report_id)""")
def change_log(spark, d):
    """One line of JSON for each saved checklist, appended to a log in the shared folder and read back."""
    counts = observations(spark, d).groupBy("report_id").agg(F.count("*").alias("rows"))
    events = checklists(spark, d).select("report_id").join(counts, "report_id", "left").fillna(0, ["rows"]).withColumn("event", F.lit("saved"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events.write.mode("append").json(path)
    return spark.read.schema("report_id long, event string, rows long").json(path)


@query("""SELECT user_id, event_id % 7 AS page, CAST(count(*) AS BIGINT) AS items, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2""", bound=False)
def paged_feed(spark, d):
    """Pages whose items lie in arrays of several names and depths: unwrapped, typed, and rows without a key left out."""
    item = F.to_json(F.struct(F.col("event_id").cast("string").alias("id")))
    pages = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id", (F.col("event_id") % 7).alias("page")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    names = {0: "[%s]", 1: '{"data": [%s]}', 2: '{"list": [%s, {"id": " "}]}', 3: '{"data": {"rows": [%s]}}', 4: '{"code": 1, "result": {"records": [%s]}}', 5: '{"items": [%s, {}]}'}
    shape = F.lit('{"data": {"list": [%s]}}')
    for k, s in names.items():
        shape = F.when(F.col("page") == k, s).otherwise(shape)
    pages = pages.select("user_id", "page", F.replace(shape, F.lit("%s"), F.col("items")).alias("payload"))
    rows = unwrapped(pages, "payload", ["user_id", "page"]).withColumn("id", F.nullif(F.trim(F.get_json_object("item", "$.id")), F.lit("")))
    return rows.filter("id IS NOT NULL").groupBy("user_id", "page").agg(F.count("*").alias("items"), F.sum(F.col("id").cast("bigint")).alias("ids"))


@query("""SELECT report_id, strftime(day, '%Y-%m-%d') AS date, name AS species, CASE WHEN point = 'P7' THEN NULL WHEN report_id % 4 = 3 THEN concat('at ', point) ELSE concat('at "', point, '", x') END AS location,
CASE WHEN report_id % 4 < 3 THEN n END AS n, CASE WHEN point = 'P7' THEN 'location' ELSE '' END AS missing FROM cl JOIN ob USING (report_id) JOIN tx USING (taxon) JOIN pp USING (observer)""")
def personal_import(spark, d):
    """Records imported from CSV, tab-separated text and JSON, with quotes and separators inside fields, and from plain lines without counts: formats are
    told by the first line, headers matched without case and marks; rows that lack a required field are told apart."""
    rows = checklists(spark, d).join(observations(spark, d), "report_id").join(taxa(spark, d), "taxon").join(observers(spark, d), "observer")
    rows = kept(rows.select("report_id", day("day").alias("date"), "name", "point", "n"), "import-rows")
    place = lambda *x: F.when(F.col("point") != "P7", F.concat(*x))
    named = rows.select("report_id", F.col("report_id").alias("Report-ID"), F.col("date").alias("Observation Date"), F.col("name").alias("SPECIES_NAME"), place(F.lit('at "'), "point", F.lit('", x')).alias(" Place."), F.col("n").alias("Number"))
    base, out = f"{shared_dir(spark)}/import-{uuid.uuid4().hex}", lambda i: named.filter(F.col("report_id") % 4 == i).drop("report_id").write
    for i, sep in enumerate((",", "\t")):
        out(i).option("header", True).option("escape", '"').option("sep", sep).csv(f"{base}-{i}")
    out(2).json(f"{base}-2")
    line = F.concat_ws(" , ", "date", "name", F.coalesce(place(F.lit("at "), "point"), F.lit("")), F.lit("30.5"), F.lit("120.5"), "report_id")
    rows.filter("report_id % 4 = 3").select(line).write.text(f"{base}-3")
    read = reduce(DataFrame.unionByName, [imported(spark, f"{base}-{i}") for i in range(4)])
    return read.select(F.col("notes").cast("bigint").alias("report_id"), "date", "species", "location", F.col("count").cast("double").alias("n"), "missing")


@query("""WITH c AS (SELECT taxon, count(*) AS records FROM ob GROUP BY taxon), k AS (SELECT CAST(taxon AS VARCHAR) AS key, name, coalesce(records, 0) AS recordcount, CASE WHEN taxon % 11 = 0 THEN taxon % 2 = 0 END AS told FROM tx LEFT JOIN c USING (taxon))
SELECT key, name, recordcount, coalesce(told, recordcount <= 25) AS rare FROM k""")
def rare_catalogue(spark, d):
    """A catalogue document per family loaded from JSON: its species, each rare if told so, else by its number of records."""
    c = observations(spark, d).groupBy("taxon").agg(F.count("*").alias("recordcount"))
    rows = taxa(spark, d).join(c, "taxon", "left").fillna(0, ["recordcount"]).select("family", F.struct(F.col("taxon").cast("string").alias("id"), F.col("name").alias("taxonname"), "recordcount", F.when(F.col("taxon") % 11 == 0, F.col("taxon") % 2 == 0).alias("isRare")).alias("s"))
    path = f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    rows.groupBy("family").agg(F.collect_list("s").alias("species")).write.json(path)
    read = spark.read.schema("family string, species array<struct<id:string,taxonname:string,recordcount:bigint,isRare:boolean>>").json(path)
    return read.select(F.inline("species")).select(F.col("id").alias("key"), F.col("taxonname").alias("name"), "recordcount", F.coalesce("isRare", F.col("recordcount") <= 25).alias("rare"))


@query("""WITH f AS (SELECT taxon, name, false AS manual FROM tx WHERE taxon % 4 <> 0), m AS (SELECT taxon, concat(name, ' *') AS name, true AS manual FROM tx WHERE taxon % 6 = 0)
SELECT *, count(*) OVER () AS total FROM (SELECT * FROM f UNION ALL SELECT * FROM m WHERE taxon NOT IN (SELECT taxon FROM f))""")
def catalogue_rebuild(spark, d):
    """The fetched catalogue and those entries added by hand that it lacks, with the total."""
    t = taxa(spark, d).select("taxon", "name")
    fetched, manual = t.filter("taxon % 4 <> 0").withColumn("manual", F.lit(False)), t.filter("taxon % 6 = 0").select("taxon", F.concat("name", F.lit(" *")).alias("name"), F.lit(True).alias("manual"))
    rows = fetched.unionByName(manual.join(fetched.select("taxon"), "taxon", "left_anti"))
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("""WITH c AS (SELECT taxon, count(DISTINCT report_id) AS reports FROM ob GROUP BY taxon), k AS (SELECT taxon, coalesce(reports, 0) AS reports FROM tx LEFT JOIN c USING (taxon)) SELECT taxon, reports, CAST(sum(reports) OVER () AS BIGINT) AS total FROM k""")
def report_counts(spark, d):
    """Catalogue taxa with the number of reports that have them, and the sum of all."""
    c = observations(spark, d).select("taxon", "report_id").distinct().groupBy("taxon").agg(F.count("*").alias("reports"))
    rows = taxa(spark, d).select("taxon").join(c, "taxon", "left").fillna(0, ["reports"])
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("reports").alias("total"))))


@query("""SELECT taxon, name, records FROM (SELECT taxon, count(*) AS records FROM ob GROUP BY taxon) JOIN tx USING (taxon)""")
def csv_export(spark, d):
    """Taxa by number of records, as CSV with quotes only where needed, written sorted and read back."""
    c = observations(spark, d).groupBy("taxon").agg(F.count("*").alias("records"))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    c.join(taxa(spark, d).select("taxon", "name"), "taxon").select("taxon", "name", "records").orderBy(F.col("records").desc(), "taxon").write.option("header", True).option("escape", '"').csv(path)
    return spark.read.schema("taxon long, name string, records long").option("header", True).option("escape", '"').csv(path)


@query("""SELECT (SELECT count(*) FROM cl) AS reports, (SELECT count(*) FROM ob) AS observations, (SELECT count(DISTINCT taxon) FROM ob) AS taxa, (SELECT strftime(min(day), '%Y-%m-%d') FROM cl) AS first_day, (SELECT strftime(max(day), '%Y-%m-%d') FROM cl) AS last_day""")
def snapshot_manifest(spark, d):
    """A training snapshot copied to the shared folder, and the manifest counted from the copy."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    checklists(spark, d).write.parquet(f"{path}/reports")
    observations(spark, d).write.parquet(f"{path}/observations")
    r = spark.read.parquet(f"{path}/reports").agg(F.count("*").alias("reports"), day(F.min("day")).alias("first_day"), day(F.max("day")).alias("last_day"))
    o = spark.read.parquet(f"{path}/observations").agg(F.count("*").alias("observations"), F.countDistinct("taxon").alias("taxa"))
    return r.crossJoin(F.broadcast(o)).select("reports", "observations", "taxa", "first_day", "last_day")


@query("""WITH e AS (SELECT user_id, event_id, value FROM events WHERE event_id % 3 <> 0), n AS (SELECT user_id, event_id, value + 1 AS value FROM events WHERE event_id % 2 = 0)
SELECT (SELECT count(*) FROM e) + (SELECT count(*) FROM n WHERE event_id NOT IN (SELECT event_id FROM e)) AS rows, (SELECT count(*) FROM n WHERE event_id NOT IN (SELECT event_id FROM e)) AS added, (SELECT count(*) FROM n WHERE event_id IN (SELECT event_id FROM e)) AS repeated,
(SELECT round(sum(value), 2) FROM (SELECT value FROM e UNION ALL SELECT value FROM n WHERE event_id NOT IN (SELECT event_id FROM e))) AS total""", bound=False)
def keyed_union(spark, d):
    """Records and an import that overlaps them: the existing row of a key wins; how many were added and how many repeated. One aggregate, no join."""
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value")
    both = rows.filter("event_id % 3 <> 0").withColumn("new", F.lit(0)).unionByName(rows.filter("event_id % 2 = 0").select("event_id", (F.col("value") + 1).alias("value"), F.lit(1).alias("new")))
    each = both.groupBy("event_id").agg(F.min("new").alias("new"), F.max("new").alias("also"), F.min_by("value", "new").alias("value"))
    return each.agg(F.count("*").alias("rows"), F.sum("new").alias("added"), F.count_if((F.col("new") == 0) & (F.col("also") == 1)).alias("repeated"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH mine AS (SELECT DISTINCT observer, taxon FROM cl JOIN ob USING (report_id)), s AS (SELECT DISTINCT observer, name FROM mine JOIN tx USING (taxon)),
r AS (SELECT observer, count(*) AS removed FROM (SELECT observer, taxon FROM s JOIN tx USING (name) UNION SELECT observer, taxon FROM mine SEMI JOIN tx USING (taxon)) GROUP BY observer)
SELECT observer, (SELECT count(*) FROM tx) - coalesce(removed, 0) AS kept, coalesce(removed, 0) AS removed FROM pp LEFT JOIN r USING (observer)""")
def seen_removed(spark, d):
    """How many catalogue taxa each observer has still to see, by key and name, and how many are left out as seen.
    A name that an observer has seen removes all taxa that bear it, so names are counted and no observer meets the catalogue."""
    catalogue = taxa(spark, d).select("taxon", "name")
    mine = checklists(spark, d).join(observations(spark, d), "report_id").select("observer", "taxon").distinct().join(catalogue, "taxon")
    bearers = catalogue.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("bearers"))
    named = mine.select("observer", "name").distinct().join(bearers, "name").groupBy("observer").agg(F.sum("bearers").alias("named"))
    nameless = mine.filter("name IS NULL").groupBy("observer").agg(F.count("*").alias("nameless"))
    rows = observers(spark, d).select("observer").join(named, "observer", "left").join(nameless, "observer", "left").fillna(0, ["named", "nameless"])
    total = catalogue.agg(F.count("*").alias("total"))
    removed = F.col("named") + F.col("nameless")
    return rows.crossJoin(F.broadcast(total)).select("observer", (F.col("total") - removed).alias("kept"), removed.alias("removed"))
