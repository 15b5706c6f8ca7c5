"""Imports of people's own records, in whatever of four formats they come."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How headers are spelt once case and marks are gone, the order of fields in plain lines, and what a first line of headers has.
HEADERS = {
    "date": ("date", "observationdate", "day"), "species": ("species", "speciesname", "commonname"), "location": ("location", "place", "site"),
    "count": ("count", "number", "n"), "lat": ("lat", "latitude"), "lng": ("lng", "lon", "longitude"), "notes": ("notes", "comment", "remarks", "reportid"),
}
REQUIRED = ("date", "species", "location")
FIELDS = ("date", "species", "location", "lat", "lng")
#: A header's spelling fills a cell, and no cell of headers begins with a digit: "hot plate" has "lat" in it and is none.
HEADINGS = {a for aliases in HEADERS.values() for a in aliases if len(a) > 1}


def sniffed(head: str) -> str:
    """json, array (JSON over several lines), tsv, csv or lines, by the first line that isn't blank."""
    head = head.strip()
    if head[:1] in ("[", "{"):
        try:
            return "json" if isinstance(json.loads(head), dict) else "array"
        except ValueError:
            return "array"
    sep = "\t" if "\t" in head else ","
    cells = [c.strip(' "\ufeff') for c in head.split(sep)]
    if len(cells) > 1 and any(plain(c) in HEADINGS for c in cells) and not any(c[:1].isdigit() for c in cells):
        return "tsv" if sep == "\t" else "csv"
    return "lines"


def plain(header: str) -> str:
    return "".join(ch for ch in header.lower() if ch.isalnum())


def imported(spark: SparkSession, path: str) -> DataFrame:
    """date, species, location, count, lat, lng, notes (trimmed texts, null where blank), and missing: the required ones without a value.

    path holds one format, told by its first line; the driver sees that line alone. Of several headers for a field the first with a value in
    a row counts; other columns are left out. Plain lines are parted at tabs and commas of either width and hold no count; what
    follows the fifth part is notes. All but JSON over several lines is read in splits. Nothing but blank lines gives no rows.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    head = lines.first()
    kind = sniffed(head["value"]) if head else "lines"
    if kind == "lines":
        parts = F.transform(F.split("value", "[\t,，]"), lambda x: F.trim(x))
        rest = F.array_join(F.slice(parts, len(FIELDS) + 1, 1 << 20), " ")
        read = lines.select(*[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(FIELDS)], rest.alias("notes"))
    elif kind in ("json", "array"):
        read = spark.read.option("primitivesAsString", True).option("multiLine", kind == "array").json(path)
    else:
        read = spark.read.option("header", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    names = {}
    for c in read.columns:
        names.setdefault(plain(c), c)
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    fields = read.select(*[F.coalesce(*[text(names[a]) for a in aliases if a in names], F.lit(None).cast("string")).alias(f) for f, aliases in HEADERS.items()])
    return fields.withColumn("missing", F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in REQUIRED]))
