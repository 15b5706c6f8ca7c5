"""Raw JSON and text records made into typed rows: alias fields, coordinates, nested payloads, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names that a field goes by, in the order in which they are tried.
CHECKLIST = {
    "report_id": ("reportId", "request_id", "id", "activity_id"),
    "serial_id": ("serial_id", "serialId"),
    "start_time": ("start_time", "startTime"),
    "end_time": ("end_time", "endTime"),
    "province_name": ("province_name", "provinceName", "province"),
    "city_name": ("city_name", "cityName", "city"),
    "district_name": ("district_name", "districtName", "district"),
    "point_name": ("point_name", "pointName", "pointname"),
}
CHECKLIST_NUMBERS = {"state": ("state",), "taxon_count_reported": ("taxoncount", "taxon_count", "taxonCount"), "outside_count": ("outside_count", "outsideCount")}
OBSERVATION = {
    "taxon_id": ("taxon_id", "taxonid", "id"),
    "taxon_name": ("taxon_name", "taxonname", "name"),
    "latinname": ("latinname", "scientificName", "sciName"),
    "order_name": ("taxonordername", "taxon_order_name", "orderName"),
    "family_name": ("taxonfamilyname", "taxon_family_name", "familyName"),
}
OBSERVATION_NUMBERS = {"taxon_count": ("taxon_count", "taxonCount", "count", "number"), "outside_type": ("outside_type",)}
BLANKS = " \t\n\r\v\f\u00a0\u3000\ufeff"
ARRAYS = ("data", "list", "rows", "records", "items", "result", "species")


def fields(raw: Column) -> Column:
    """A JSON object's fields as a map of texts, nested values as their JSON: parsed once, whatever is asked of it."""
    return F.from_json(raw, "map<string,string>")


def text(fields: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that isn't empty, then without blanks at its ends, so one of blanks alone hides those after it; "" if none is there."""
    return F.trim(F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names], F.lit("")), F.lit(BLANKS))


def whole(fields: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that is there, as a whole number; 0 where it is none."""
    return F.coalesce(F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names]).try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def coordinates(location: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a JSON array, of an object, or of text "lng,lat"; null where they aren't numbers."""
    pick = lambda i, names: F.coalesce(F.get_json_object(location, f"$[{i}]"), *[F.get_json_object(location, f"$.{n}") for n in names], F.try_element_at(F.split(location, ","), F.lit(i + 1))).try_cast("double")
    return pick(0, ("longitude", "lng", "lon")), pick(1, ("latitude", "lat"))


def checklists_of(df: DataFrame, raw: str, kind: Column) -> DataFrame:
    """df with the typed columns of the raw checklists; `kind` is normal or flagged."""
    df, r = df.withColumn("_fields", fields(F.col(raw))), F.col("_fields")
    named = {c: text(r, names) for c, names in CHECKLIST.items()} | {c: whole(r, names) for c, names in CHECKLIST_NUMBERS.items()}
    lon, lat = coordinates(F.try_element_at(r, F.lit("location")))
    return df.withColumns(named | {"report_kind": kind, "longitude": lon, "latitude": lat, "taxa": F.try_element_at(r, F.lit("taxa"))}).drop("_fields")


def observations_of(df: DataFrame, taxa: str, flagged: Column, keep: list[str]) -> DataFrame:
    """One row for each element of the JSON array `taxa` of each row, with keep, raw_index and the typed columns; elements of
    outside type 1 go where the row is flagged. A missing or broken array has no rows. A taxon's key is its id, else its name, else its place."""
    each = df.select(*keep, flagged.alias("_flagged"), F.posexplode(F.from_json(taxa, "array<map<string,string>>")).alias("raw_index", "_raw"))
    named = {c: text(F.col("_raw"), names) for c, names in OBSERVATION.items()} | {c: whole(F.col("_raw"), names) for c, names in OBSERVATION_NUMBERS.items()}
    rows = each.withColumns(named).filter(~(F.col("_flagged") & (F.col("outside_type") == 1)))
    key = F.coalesce(F.nullif("taxon_id", F.lit("")), F.nullif("taxon_name", F.lit("")), F.col("raw_index").cast("string"))
    return rows.withColumns({"taxon_key": key, "is_red": (F.col("outside_type") == 1).cast("int")}).drop("_flagged", "_raw")


def unwrapped(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """One row for each item of the first array found among ARRAYS, at the top or one or two levels below; others have no rows."""
    paths = [""] + [f".{a}" for a in ARRAYS] + [f".{a}.{b}" for a in ARRAYS for b in ARRAYS]
    found = [F.get_json_object(payload, f"${p}") for p in paths]
    items = F.coalesce(*[F.when(F.ltrim(f).startswith("["), f) for f in found])
    return df.select(*keep, F.posexplode(F.from_json(items, "array<string>")).alias("place", "item"))


def merged(stored: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """The stored table after an upsert: of each key the last of the new rows in the given order, else the stored one."""
    rest = [c for c in stored.columns if c != key]
    last = new.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")
    return stored.join(last.select(key), key, "left_anti").unionByName(last.select(*stored.columns))


def replaced(stored: DataFrame, new: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Child rows after a save: those of the saved keys are all replaced (a key without new rows loses its old ones)."""
    return stored.join(keys.select(key).distinct(), key, "left_anti").unionByName(new.select(*stored.columns))
