"""Registered queries over records: predicates, searches, orders, lookups, texts and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions.coordinates import bd09_to_gcj02, gcj02_to_wgs84, inside, ordered
from fieldmark.operators.core import first_by, top_k
from fieldmark.operators.names import containing
from fieldmark.operators.numbering import numbered
from fieldmark.plans.checklist_queries import QUERIES, SQL, day, query
from fieldmark.sources.tables import checklists, observations, observers, table, taxa

# Cities that are their own province's district level.
MUNICIPALITIES = (3, 7, 12)


@query("""WITH r AS (SELECT report_id, state, observer, province, city, CASE WHEN observer % 3 = 0 THEN '' ELSE point END AS district, CASE WHEN observer % 4 = 0 THEN concat(point, '*') ELSE point END AS place FROM cl JOIN pp USING (observer)),
l AS (SELECT *, district = '' AND city IN (3, 7, 12) AS moved FROM r)
SELECT report_id, CASE WHEN moved THEN '' ELSE CAST(city AS VARCHAR) END AS city, CASE WHEN moved THEN CAST(city AS VARCHAR) ELSE district END AS district, state = 'F' OR NOT contains(place, '*') AS public,
CASE WHEN state = 'F' OR NOT contains(place, '*') THEN place ELSE 'hidden' END AS location, CASE WHEN state = 'F' OR NOT contains(place, '*') THEN CAST(observer AS VARCHAR) ELSE '******' END AS who, (state = 'F' OR NOT contains(place, '*')) AND NOT contains(place, '*') AS shown FROM l""")
def record_privacy(spark, d):
    """Records with municipalities moved to the district level, and location and observer masked where neither state nor place is public."""
    r = checklists(spark, d).join(observers(spark, d), "observer").withColumns({"district": F.when(F.col("observer") % 3 == 0, "").otherwise(F.col("point")), "place": F.when(F.col("observer") % 4 == 0, F.concat("point", F.lit("*"))).otherwise(F.col("point"))})
    moved, starred, city = (F.col("district") == "") & F.col("city").isin(*MUNICIPALITIES), F.contains("place", F.lit("*")), F.col("city").cast("string")
    public = (F.col("state") == "F") | ~starred
    return r.select("report_id", F.when(moved, "").otherwise(city).alias("city"), F.when(moved, city).otherwise(F.col("district")).alias("district"), public.alias("public"), F.when(public, F.col("place")).otherwise("hidden").alias("location"), F.when(public, F.col("observer").cast("string")).otherwise("******").alias("who"), (public & ~starred).alias("shown"))


@query("""WITH n AS (SELECT taxon, replace(name, ' ', '_') AS code, family, order_name FROM tx), h AS (SELECT * FROM n WHERE code LIKE '%d\\_w%' ESCAPE '\\' OR family LIKE '%d\\_w%' ESCAPE '\\' OR order_name LIKE '%d\\_w%' ESCAPE '\\')
SELECT taxon, code, CAST(row_number() OVER (ORDER BY CASE WHEN code = 'd_w' THEN 0 WHEN starts_with(code, 'd_w') THEN 1 ELSE 2 END, code, taxon) AS BIGINT) AS rank FROM h""")
def escaped_search(spark, d, asked: str = "d_w"):
    """Contains-search over three columns in which % and _ stand for themselves; exact and leading matches first."""
    n = taxa(spark, d).select("taxon", F.replace("name", F.lit(" "), F.lit("_")).alias("code"), "family", "order_name")
    h = n.filter(F.contains("code", F.lit(asked)) | F.contains("family", F.lit(asked)) | F.contains("order_name", F.lit(asked)))
    h = h.withColumn("grade", F.when(F.col("code") == asked, 0).when(F.startswith("code", F.lit(asked)), 1).otherwise(2))
    return numbered(h, "rank", "grade", "code", "taxon").select("taxon", "code", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT taxon, name FROM tx WHERE contains(lower(concat_ws(' ', name, family, order_name, CAST(taxon AS VARCHAR))), 'bolt brand#1')""")
def picker_search(spark, d):
    """Taxa whose joined fields contain the term."""
    return taxa(spark, d).filter(F.contains(F.lower(F.concat_ws(" ", "name", "family", "order_name", F.col("taxon").cast("string"))), F.lit("bolt brand#1"))).select("taxon", "name")


@query("""WITH r AS (SELECT report_id, idx, day, n FROM cl JOIN ob USING (report_id) JOIN tx USING (taxon) WHERE name = 'red widget')
SELECT report_id, idx, strftime(day, '%Y-%m-%d') AS day, CAST(row_number() OVER (ORDER BY day DESC, report_id, idx, n) AS BIGINT) AS place FROM r""")
def species_records(spark, d):
    """One species' records, latest first; places come from ranges, not from one sorting task."""
    rows = observations(spark, d).join(taxa(spark, d).filter("name = 'red widget'").select("taxon"), "taxon").join(checklists(spark, d), "report_id").withColumn("back", -F.datediff("day", F.lit("1970-01-01")))
    return numbered(rows, "place", "back", "report_id", "idx", "n").select("report_id", "idx", day("day").alias("day"), F.col("place").cast("bigint").alias("place"))


@query("""WITH r AS (SELECT report_id, day, lower(concat('Region', province, '/City', city, '/', point)) AS region FROM cl JOIN pp USING (observer)), b AS (SELECT max(day) - 400 AS lo, max(day) AS hi FROM r)
SELECT report_id, strftime(day, '%Y-%m-%d') AS day FROM r, b WHERE contains(region, 'city1') AND day BETWEEN lo AND hi""")
def region_period(spark, d, region: str = "CITY1", days: int = 400):
    """Records whose region contains a text, of the last `days` days up to the last record, both ends included."""
    r = checklists(spark, d).join(observers(spark, d), "observer").withColumn("region", F.lower(F.concat(F.lit("Region"), "province", F.lit("/City"), "city", F.lit("/"), "point")))
    last = checklists(spark, d).agg(F.max("day").alias("hi"))
    r = r.filter(F.contains("region", F.lit(region.lower()))).join(F.broadcast(last), F.col("day").between(F.date_sub("hi", days), F.col("hi")))
    return r.select("report_id", day("day").alias("day"))


@query(f"""WITH s AS ({SQL["circular_season"].split("WITH ", 1)[1].join(["SELECT * FROM (WITH ", ")"])})
SELECT taxon, begin_day, end_day, begin_day <= end_day AND (end_day >= 340 OR begin_day <= 20) OR begin_day > end_day AS meets FROM s""", bound=False)
def season_overlap(spark, d, asked: tuple[int, int] = (340, 20)):
    """Whether each taxon's season meets the asked days, both around the turn of the year: overlap of their one or two pieces."""
    pieces = lambda a, b: F.when(a <= b, F.array(F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array(F.struct(a.alias("a"), F.lit(365).alias("b")), F.struct(F.lit(1).alias("a"), b.alias("b"))))
    mine, other = pieces(F.col("begin_day"), F.col("end_day")), pieces(F.lit(asked[0]), F.lit(asked[1]))
    meets = F.exists(mine, lambda x: F.exists(other, lambda y: F.greatest(x["a"], y["a"]) <= F.least(x["b"], y["b"])))
    return QUERIES["circular_season"](spark, d).select("taxon", "begin_day", "end_day", meets.alias("meets"))


@query("""WITH t AS (SELECT report_id, concat(year(day), CASE WHEN report_id % 7 = 0 THEN '/' ELSE '-' END, lpad(CAST(month(day) + report_id % 3 AS VARCHAR), 2, '0'), '-', lpad(CAST(day(day) + report_id % 5 AS VARCHAR), 2, '0')) AS s FROM cl)
SELECT report_id, s, regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(s AS DATE) IS NOT NULL AS valid FROM t""")
def valid_dates(spark, d):
    """Which dates are written as year, month and day and exist."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = F.concat(F.year("day"), F.when(F.col("report_id") % 7 == 0, "/").otherwise("-"), two(F.month("day") + F.col("report_id") % 3), F.lit("-"), two(F.dayofmonth("day") + F.col("report_id") % 5))
    return checklists(spark, d).select("report_id", s.alias("s")).withColumn("valid", F.col("s").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date("s", "yyyy-MM-dd").isNotNull())


@query("""WITH c AS (SELECT taxon, name, count(*) AS n FROM ob JOIN tx USING (taxon) GROUP BY taxon, name)
SELECT taxon, n, CAST(row_number() OVER (ORDER BY n, name, taxon) AS BIGINT) AS upward, CAST(row_number() OVER (ORDER BY n DESC, name, taxon) AS BIGINT) AS downward FROM c""")
def taxa_by_count(spark, d):
    """Places of taxa by number of records, rising and falling, names in the Chinese collation."""
    c = observations(spark, d).groupBy("taxon").agg(F.count("*").alias("n")).join(taxa(spark, d).select("taxon", "name"), "taxon").select("taxon", "n", F.collate("name", "zh").alias("name"), (-F.col("n")).alias("back"))
    both = numbered(numbered(c, "upward", "n", "name", "taxon"), "downward", "back", "name", "taxon")
    return both.select("taxon", "n", F.col("upward").cast("bigint").alias("upward"), F.col("downward").cast("bigint").alias("downward"))


@query("""WITH s AS (SELECT report_id, concat(CASE WHEN report_id % 2 = 0 THEN 'R-00' ELSE 'X' END, report_id, 'z') AS serial, day, CASE WHEN report_id % 9 = 0 THEN 0 ELSE epoch(day::TIMESTAMP) END AS moment FROM cl), k AS (SELECT *, ltrim(regexp_replace(serial, '[^0-9]', '', 'g'), '0') AS digits FROM s)
SELECT report_id, serial, CAST(row_number() OVER (ORDER BY length(digits) DESC, digits DESC) AS BIGINT) AS by_serial, CAST(row_number() OVER (ORDER BY moment DESC, length(digits) DESC, digits DESC) AS BIGINT) AS by_time FROM k""")
def records_in_order(spark, d):
    """Places of records by serial number (its digits, longer ones first) and by time, where a broken time counts as the oldest."""
    serial = F.concat(F.when(F.col("report_id") % 2 == 0, "R-00").otherwise("X"), "report_id", F.lit("z"))
    r = checklists(spark, d).select("report_id", serial.alias("serial"), F.when(F.col("report_id") % 9 == 0, "unknown").otherwise(F.concat(day("day"), F.lit(" 00:00"))).alias("when"))
    digits = F.ltrim(F.regexp_replace("serial", "[^0-9]", ""), F.lit("0"))
    # Complements turn the falling order of equally long digits into a rising one.
    r = r.withColumns({"short": -F.length(digits), "turned": F.translate(digits, "0123456789", "9876543210"), "old": -F.coalesce(F.unix_timestamp(F.try_to_timestamp("when", F.lit("yyyy-MM-dd HH:mm"))), F.lit(0))})
    both = numbered(numbered(r, "by_serial", "short", "turned"), "by_time", "old", "short", "turned")
    return both.select("report_id", "serial", F.col("by_serial").cast("bigint").alias("by_serial"), F.col("by_time").cast("bigint").alias("by_time"))


@query("""WITH i AS (SELECT observer, CASE WHEN observer % 5 = 0 THEN concat('A', observer) ELSE CAST(observer % 100 AS VARCHAR) END AS id FROM pp) SELECT observer, id, CAST(row_number() OVER (ORDER BY try_cast(id AS BIGINT) NULLS LAST, id, observer) AS BIGINT) AS place FROM i""")
def ids_in_order(spark, d):
    """Ids in the order of their numbers, those that aren't numbers last, as text."""
    i = observers(spark, d).select("observer", F.when(F.col("observer") % 5 == 0, F.concat(F.lit("A"), "observer")).otherwise((F.col("observer") % 100).cast("string")).alias("id"))
    i = i.withColumns({"no_number": F.col("id").try_cast("decimal(38,0)").isNull(), "number": F.coalesce(F.col("id").try_cast("decimal(38,0)"), F.lit(0))})
    return numbered(i, "place", "no_number", "number", "id", "observer").select("observer", "id", F.col("place").cast("bigint").alias("place"))


@query("""WITH v AS (SELECT point, observer, lon, lat FROM pp WHERE lon BETWEEN 119 AND 121 AND lat BETWEEN 28 AND 30), k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY observer) AS k, count(*) OVER (PARTITION BY point) AS n FROM v)
SELECT point, observer, n > 3 AS truncated FROM k WHERE k <= 3""")
def viewport_pages(spark, d, limit: int = 3):
    """At most `limit` places of each point in a map's view, and whether there are more: one row beyond the limit tells."""
    v = observers(spark, d).filter(F.col("lon").between(119, 121) & F.col("lat").between(28, 30)).select("point", "observer")
    page = top_k(v, ["point"], limit + 1, F.col("observer"))
    more = page.filter(F.col("rank") > limit).select("point", F.lit(True).alias("truncated"))
    return page.filter(F.col("rank") <= limit).join(more, "point", "left").select("point", "observer", F.coalesce("truncated", F.lit(False)).alias("truncated"))


@query(f"""WITH s AS ({SQL["seasonal_score"].split("WITH ", 1)[1].join(["SELECT * FROM (WITH ", ")"])}), t AS (SELECT p_partkey AS taxon, p_name AS name, p_type AS order_name FROM part)
SELECT taxon, CAST(row_number() OVER (ORDER BY score DESC, years DESC, order_name, name, taxon) AS BIGINT) AS place FROM s JOIN t USING (taxon)""", bound=False)
def seasonal_order(spark, d):
    """Seasonal results by score, years, order and name."""
    rows = QUERIES["seasonal_score"](spark, d).join(taxa(spark, d), "taxon").withColumns({"a": -F.col("score"), "b": -F.col("years")})
    return numbered(rows, "place", "a", "b", "order_name", "name", "taxon").select("taxon", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH q AS ({SQL["support_quantile"].split("WITH ", 1)[1].join(["SELECT * FROM (WITH ", ")"])}), r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY round(abs(quantile - 0.6), 6), sha256(CAST(observer AS VARCHAR))) AS k FROM q)
SELECT city, observer, CAST(k AS INT) AS rank FROM r WHERE k <= 3""", bound=False)
def anchor_candidates(spark, d):
    """The three observers of each city whose support is next to the 0.6 quantile, ties by a hash."""
    return top_k(QUERIES["support_quantile"](spark, d), ["city"], 3, F.round(F.abs(F.col("quantile") - 0.6), 6), F.sha2(F.col("observer").cast("string"), 256)).select("city", "observer", "rank")


@query("""WITH a AS (SELECT observer, observer % 500 + 1 AS t, observer % 4 AS how FROM pp), w AS (SELECT observer, CASE how WHEN 0 THEN name WHEN 1 THEN concat(family, ' ', taxon) WHEN 2 THEN CAST(taxon AS VARCHAR) ELSE 'unknown' END AS asked FROM a JOIN tx ON taxon = t),
n AS (SELECT name AS k, min(taxon) AS taxon FROM tx GROUP BY name), s AS (SELECT concat(family, ' ', taxon) AS k, taxon FROM tx), c AS (SELECT CAST(taxon AS VARCHAR) AS k, taxon FROM tx)
SELECT observer, asked, coalesce(n.taxon, s.taxon, c.taxon) AS taxon, CASE WHEN n.taxon IS NOT NULL THEN 'name' WHEN s.taxon IS NOT NULL THEN 'scientific' WHEN c.taxon IS NOT NULL THEN 'code' ELSE 'none' END AS found_by FROM w LEFT JOIN n ON n.k = asked LEFT JOIN s ON s.k = asked LEFT JOIN c ON c.k = asked""")
def fallback_lookup(spark, d):
    """A taxon looked up by name, else by scientific name, else by code. The three indexes are one table with a rank, joined once."""
    t = taxa(spark, d)
    scientific, code = F.concat_ws(" ", "family", "taxon"), F.col("taxon").cast("string")
    how = F.col("observer") % 4
    asked = observers(spark, d).select("observer", (F.col("observer") % 500 + 1).alias("taxon")).join(t, "taxon").select("observer", F.when(how == 0, F.col("name")).when(how == 1, scientific).when(how == 2, code).otherwise("unknown").alias("asked"))
    keyed = t.select("taxon", F.inline(F.array(*[F.struct(F.lit(k).alias("rank"), x.alias("key")) for k, x in enumerate((F.col("name"), scientific, code))])))
    index = keyed.groupBy("key").agg(F.min(F.struct("rank", "taxon")).alias("hit"))
    names = F.array(F.lit("name"), F.lit("scientific"), F.lit("code"))
    return asked.join(index, F.col("asked") == F.col("key"), "left").select("observer", "asked", F.col("hit.taxon").alias("taxon"), F.coalesce(F.get(names, F.col("hit.rank")), F.lit("none")).alias("found_by"))


@query("""WITH h AS (SELECT taxon, concat('old ', name) AS old FROM tx WHERE taxon % 3 = 0), r AS (SELECT DISTINCT taxon FROM ob WHERE n > 49)
SELECT taxon, coalesce(CASE WHEN taxon % 2 = 0 THEN name END, old, CASE WHEN r.taxon IS NOT NULL THEN 'recent' END, CAST(taxon AS VARCHAR)) AS shown FROM tx LEFT JOIN h USING (taxon) LEFT JOIN r USING (taxon)""")
def taxonomy_names(spark, d):
    """What a taxon is called: the taxonomy's name, else an older one, else that of a recent record, else its code."""
    t = taxa(spark, d)
    old, recent = t.filter("taxon % 3 = 0").select("taxon", F.concat(F.lit("old "), "name").alias("old")), observations(spark, d).filter("n > 49").select("taxon", F.lit("recent").alias("recent")).distinct()
    rows = t.join(old, "taxon", "left").join(recent, "taxon", "left")
    return rows.select("taxon", F.coalesce(F.when(F.col("taxon") % 2 == 0, F.col("name")), "old", "recent", F.col("taxon").cast("string")).alias("shown"))


def match_key(x):
    """A name without blanks and marks."""
    return F.regexp_replace(x, "[\\s\u3000,\uff0c.\u3002:\uff1a;\uff1b\u3001]", "")


@query("""WITH q AS (SELECT DISTINCT regexp_replace(concat(split_part(name, ' ', 1), CASE WHEN taxon % 3 = 0 THEN ', ' ELSE '' END, CASE WHEN taxon % 2 = 0 THEN split_part(name, ' ', 2) ELSE '' END, CASE WHEN taxon % 7 = 0 THEN ' .x' ELSE '' END), '[\\s,.:;]', '', 'g') AS asked FROM tx),
n AS (SELECT DISTINCT replace(name, ' ', '') AS k FROM tx), e AS (SELECT asked, k FROM q JOIN n ON k = asked), c AS (SELECT asked, k FROM q JOIN n ON contains(k, asked) OR contains(asked, k) WHERE asked NOT IN (SELECT asked FROM e)),
b AS (SELECT * FROM e UNION ALL SELECT * FROM c)
SELECT q.asked, CASE count(k) WHEN 0 THEN 'none' WHEN 1 THEN 'matched' ELSE 'multiple' END AS status, count(k) AS candidates FROM q LEFT JOIN b ON b.asked = q.asked GROUP BY q.asked""")
def fuzzy_names(spark, d):
    """Asked names against the catalogue: equal without blanks and marks, else one holding the other. Only names without an equal one are compared, with those that share their rarest part."""
    t = taxa(spark, d)
    parts = F.split("name", " ")
    asked = F.concat(parts[0], F.when(F.col("taxon") % 3 == 0, ", ").otherwise(""), F.when(F.col("taxon") % 2 == 0, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).otherwise(""), F.when(F.col("taxon") % 7 == 0, " .x").otherwise(""))
    q, n = t.select(match_key(asked).alias("asked")).distinct(), t.select(match_key(F.col("name")).alias("k")).distinct()
    equal = q.join(n, F.col("asked") == F.col("k"))
    open_ = q.join(equal.select("asked"), "asked", "left_anti")
    near = containing(open_, "asked", n, "k").unionByName(containing(n, "k", open_, "asked")).distinct()
    c = equal.unionByName(near).groupBy("asked").agg(F.count("*").alias("candidates"))
    return q.join(c, "asked", "left").fillna(0, ["candidates"]).select("asked", F.when(F.col("candidates") == 0, "none").when(F.col("candidates") == 1, "matched").otherwise("multiple").alias("status"), "candidates")


@query("""WITH u AS (SELECT DISTINCT province, city, point FROM pp) SELECT concat('point:', city, ':', point) AS unit, concat('all/province:', province, '/city:', city, '/point:', city, ':', point) AS path, 3 AS depth FROM u
UNION ALL SELECT DISTINCT concat('city:', city), concat('all/province:', province, '/city:', city), 2 FROM u UNION ALL SELECT DISTINCT concat('province:', province), concat('all/province:', province), 1 FROM u UNION ALL SELECT 'all', 'all', 0""")
def ancestor_paths(spark, d, deepest: int = 7):
    """Each unit's path from the root, by following parents for at most `deepest` levels; units on a circle or without a way to the root have none."""
    p = observers(spark, d)
    city, province = F.concat(F.lit("city:"), "city"), F.concat(F.lit("province:"), "province")
    pair = lambda a, b: p.select(a.alias("unit"), b.alias("parent"))
    tree = pair(F.concat(F.lit("point:"), "city", F.lit(":"), "point"), city).unionByName(pair(city, province)).unionByName(pair(province, F.lit("all"))).distinct()
    level = spark.range(1).select(F.lit("all").alias("unit"), F.lit("all").alias("path"), F.lit(0).alias("depth"))
    out = level
    for k in range(1, deepest):
        level = tree.join(level.select(F.col("unit").alias("parent"), "path"), "parent").select("unit", F.concat_ws("/", "path", "unit").alias("path"), F.lit(k).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


@query("""WITH v AS (SELECT point, city, count(*) AS votes FROM cl JOIN pp USING (observer) WHERE report_id % 2 = 0 GROUP BY point, city), m AS (SELECT point, city AS unit FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY votes DESC, city) AS k FROM v) WHERE k = 1)
SELECT report_id, coalesce(unit, city) AS unit FROM cl JOIN pp USING (observer) LEFT JOIN m ON m.point = CASE WHEN observer % 9 = 0 THEN 'new' ELSE pp.point END""")
def point_units(spark, d):
    """The unit of each checklist's point, by the majority of the point's older lists, else its own city."""
    c = checklists(spark, d).join(observers(spark, d), "observer")
    v = c.filter("report_id % 2 = 0").groupBy("point", "city").agg(F.count("*").alias("votes"))
    m = first_by(v, ["point"], F.col("votes").desc(), F.col("city")).select(F.col("point").alias("known"), F.col("city").alias("unit"))
    rows = c.withColumn("asked", F.when(F.col("observer") % 9 == 0, "new").otherwise(F.col("point")))
    return rows.join(m, F.col("asked") == F.col("known"), "left").select("report_id", F.coalesce("unit", "city").alias("unit"))


@query("""WITH r AS (SELECT taxon, day, report_id, CASE WHEN report_id % 3 = 0 THEN '' ELSE concat(name, '/', report_id % 4) END AS said FROM cl JOIN ob USING (report_id) JOIN tx USING (taxon))
SELECT taxon, coalesce(arg_max(said, {'day': day, 'r': report_id}) FILTER (said <> ''), '') AS name FROM r GROUP BY taxon""")
def last_names(spark, d):
    """The last name that isn't empty of each taxon, in the order of day and report."""
    r = checklists(spark, d).join(observations(spark, d), "report_id").join(taxa(spark, d), "taxon")
    said = F.when(F.col("report_id") % 3 != 0, F.concat("name", F.lit("/"), F.col("report_id") % 4))
    return r.groupBy("taxon").agg(F.coalesce(F.max_by(said, F.when(said.isNotNull(), F.struct("day", "report_id"))), F.lit("")).alias("name"))


@query("""WITH g AS (SELECT point, round(lon, 1) AS lon, round(lat, 1) AS lat, count(*) AS records, count(DISTINCT taxon) AS taxa, max(day) AS latest FROM cl JOIN ob USING (report_id) JOIN pp USING (observer) GROUP BY 1, 2, 3)
SELECT point, lon, lat, records, taxa, strftime(latest, '%Y-%m-%d') AS latest FROM g""")
def personal_points(spark, d):
    """The map points of all observers' records: number, taxa and last day by place and coordinate."""
    r = checklists(spark, d).join(observations(spark, d), "report_id").join(observers(spark, d), "observer")
    return r.groupBy("point", F.round("lon", 1).alias("lon"), F.round("lat", 1).alias("lat")).agg(F.count("*").alias("records"), F.countDistinct("taxon").alias("taxa"), day(F.max("day")).alias("latest"))


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN text ELSE concat('@bot ', CASE WHEN conv_id % 7 = 0 THEN '2024-13-40' ELSE strftime(DATE '2024-01-01' + CAST(turn AS INT), '%Y-%m-%d') END, CASE WHEN turn % 2 = 0 THEN concat('\uff0c ', split_part(text, ' ', 1), ' ') ELSE '' END) END AS s FROM conversations),
p AS (SELECT *, regexp_extract(s, '\\b(\\d{4}-\\d{2}-\\d{2})\\b', 1) AS date FROM m WHERE contains(s, '@')), v AS (SELECT *, trim(regexp_replace(substr(s, strpos(s, date) + 10), '^[\\s,\uff0c:\uff1a;\uff1b\u3002]+', '')) AS species FROM p WHERE try_cast(date AS DATE) IS NOT NULL)
SELECT conv_id, turn, date, species, CASE WHEN species = '' THEN 'date' ELSE 'location' END AS kind FROM v""", bound=False)
def chat_commands(spark, d):
    """Commands in messages: a mention, a date that exists, and maybe a species; other messages are none."""
    c, days = table(spark, d, "conversations"), F.date_format(F.date_add(F.lit("2024-01-01"), F.col("turn").cast("int")), "yyyy-MM-dd")
    species = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\uff0c "), F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" "))).otherwise("")
    s = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("@bot "), F.when(F.col("conv_id") % 7 == 0, "2024-13-40").otherwise(days), species))
    m = c.select("conv_id", "turn", s.alias("s")).filter(F.contains("s", F.lit("@"))).withColumn("date", F.regexp_extract("s", r"\b(\d{4}-\d{2}-\d{2})\b", 1))
    rest = F.trim(F.regexp_replace(F.expr("substring(s, locate(date, s) + 10)"), "^[\\s,\uff0c:\uff1a;\uff1b\u3002]+", ""))
    m = m.filter(F.try_to_date("date", "yyyy-MM-dd").isNotNull()).withColumn("species", rest)
    return m.select("conv_id", "turn", "date", "species", F.when(F.col("species") == "", "date").otherwise("location").alias("kind"))


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS s FROM conversations) SELECT conv_id, turn, CASE WHEN length(s) > 60 THEN concat(rtrim(left(s, 59)), '\u2026') ELSE s END AS short FROM t""", bound=False)
def compact_texts(spark, d, most: int = 60):
    """Texts with runs of blanks as one, cut to `most` characters with a mark where something is missing."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).alias("s"))
    return t.select("conv_id", "turn", F.when(F.length("s") > most, F.concat(F.rtrim(F.left("s", F.lit(most - 1))), F.lit("\u2026"))).otherwise(F.col("s")).alias("short"))


POLYGON = [(118.2, 27.5), (121.9, 27.9), (122.4, 30.2), (120.3, 30.9), (119.4, 29.1)]
CROSSED_SQL = " + ".join(f"CASE WHEN (lat < {y1}) <> (lat < {y2}) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[-1:] + POLYGON[:-1]))
SHIFT_SQL = """SELECT observer, lon0, lat0, swapped, lon0 - degrees((300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * sqrt(abs(x)) + (20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3 + (20 * sin(x * pi()) + 40 * sin(x / 3 * pi())) * 2 / 3 + (150 * sin(x / 12 * pi()) + 300 * sin(x / 30 * pi())) * 2 / 3) * sqrt(m) / 6378245.0 / cos(radians(lat))) AS lon,
lat0 - degrees((-100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * sqrt(abs(x)) + (20 * sin(6 * x * pi()) + 20 * sin(2 * x * pi())) * 2 / 3 + (20 * sin(y * pi()) + 40 * sin(y / 3 * pi())) * 2 / 3 + (160 * sin(y / 12 * pi()) + 320 * sin(y * pi() / 30)) * 2 / 3) * m * sqrt(m) / (6378245.0 * (1 - 0.006693421622965943))) AS lat
FROM (SELECT *, lon - 105 AS x, lat - 35 AS y, 1 - 0.006693421622965943 * pow(sin(radians(lat)), 2) AS m FROM s{k})"""
BACK_SQL = ", ".join(f"s{k + 1} AS ({SHIFT_SQL.format(k=k)})" for k in range(8))


@query(f"""WITH g AS (SELECT observer, observer % 3 = 0 AS swapped, lon - 0.0065 AS x, lat - 0.006 AS y FROM pp), z AS (SELECT *, sqrt(x * x + y * y) - 0.00002 * sin(y * pi() * 3000 / 180) AS z, atan2(y, x) - 0.000003 * cos(x * pi() * 3000 / 180) AS t FROM g),
s0 AS (SELECT observer, swapped, z * cos(t) AS lon0, z * sin(t) AS lat0, z * cos(t) AS lon, z * sin(t) AS lat FROM z), {BACK_SQL}
SELECT observer, swapped, round(lon, 6) AS lon, round(lat, 6) AS lat, ({CROSSED_SQL}) % 2 = 1 AS inside FROM s8""")
def wgs84_places(spark, d):
    """Places given in BD-09, some with their coordinates swapped, in WGS-84, and whether they lie in a polygon."""
    p = observers(spark, d).select("observer", F.when(F.col("observer") % 3 == 0, F.col("lat")).otherwise(F.col("lon")).alias("a"), F.when(F.col("observer") % 3 == 0, F.col("lon")).otherwise(F.col("lat")).alias("b"))
    lon, lat, swapped = ordered(F.col("a"), F.col("b"))
    p = p.select("observer", lon.alias("lon"), lat.alias("lat"), swapped.alias("swapped"))
    east, north = bd09_to_gcj02(F.col("lon"), F.col("lat"))
    p = gcj02_to_wgs84(p.withColumns({"lon": east, "lat": north}), "lon", "lat")
    return p.select("observer", "swapped", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), inside(F.col("lon"), F.col("lat"), POLYGON).alias("inside"))


@query("""WITH u AS (SELECT DISTINCT c_nationkey AS city, c_mktsegment AS district FROM customer) SELECT concat('district:', url_encode(concat('City ', city)), ':', url_encode(concat(district, '/ü'))) AS unit FROM u""", bound=False)
def unit_ids(spark, d):
    """Ids of districts with their names escaped."""
    escaped = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    u = table(spark, d, "customer").select(F.concat(F.lit("City "), "c_nationkey").alias("city"), F.concat("c_mktsegment", F.lit("/ü")).alias("district")).distinct()
    return u.select(F.concat(F.lit("district:"), escaped(F.col("city")), F.lit(":"), escaped(F.col("district"))).alias("unit"))
