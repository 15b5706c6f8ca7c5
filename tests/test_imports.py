"""Imports in four formats that hold the same rows, and texts that barely are any."""

import json

import pytest

from fieldmark.sources.imports import imported, sniffed

ROWS = [("2024-05-01", "Grey Heron", "Lake A", "3"), ("2024-05-02", "Coot", None, "1"), ("", " ", "Lake B", None)]
WANT = [("2024-05-01", "Grey Heron", "Lake A", ""), ("2024-05-02", "Coot", None, "location"), (None, None, "Lake B", "date,species")]


def text(kind):
    records = [{"Observation Date": d, "COMMON_NAME": s, "Site": p, "Number": n, "extra": "x"} for d, s, p, n in ROWS]
    if kind == "json":
        return "\n".join(json.dumps(r) for r in records)
    if kind == "array":
        return "\n" + json.dumps(records, indent=1)
    if kind == "lines":
        return "\n\n".join(("\t" if i else "，").join(x or "" for x in r[:3]) for i, r in enumerate(ROWS))
    sep = "\t" if kind == "tsv" else ","
    return "\n".join(sep.join(f'"{x or ""}"' for x in r) for r in [("Observation Date", "common name", "site", "number"), *ROWS])


@pytest.mark.parametrize("kind", ["json", "array", "csv", "tsv", "lines"])
def test_one_table_in_each_format(spark, tmp_path, kind):
    (tmp_path / "in.txt").write_text(text(kind))
    got = imported(spark, str(tmp_path)).collect()
    assert sorted((r["date"] or "", r["species"] or "", r["location"] or "", r["missing"]) for r in got) == sorted(tuple(x or "" for x in w) for w in WANT)
    assert sorted(r["count"] or "" for r in got) == (["", "", ""] if kind == "lines" else ["", "1", "3"])


def test_first_value_of_a_field_counts_and_nothing_gives_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,species,place,location,DATE \n2024-01-01,"Coot, ""big""",P,  ,x\n')
    (row,) = imported(spark, str(tmp_path / "a.csv")).collect()
    assert (row["date"], row["species"], row["location"], row["lat"], row["missing"]) == ("2024-01-01", 'Coot, "big"', "P", None, "")
    (tmp_path / "b.txt").write_text("\n  \n")
    assert imported(spark, str(tmp_path / "b.txt")).count() == 0
    (tmp_path / "c.txt").write_text("2024-01-01, Coot, Lake, 30.1, 120.2, two, seen well\n")
    (row,) = imported(spark, str(tmp_path / "c.txt")).collect()
    assert (row["lat"], row["lng"], row["notes"], row["count"]) == ("30.1", "120.2", "two seen well", None)
    assert [sniffed(x) for x in ('{"a": 1}', "{", "[1]", "date\tspecies", "date,species", "2024,Coot", "")] == ["json", "array", "array", "tsv", "csv", "lines", "lines"]


def test_a_value_that_holds_a_header_is_no_header(spark, tmp_path):
    """a first line of "hot plate" was taken for headers, as it has "lat" in it, and its file for CSV."""
    (tmp_path / "a.txt").write_text("2024-01-01 , hot plate , at P1 , 30.5 , 120.5 , 7\n2024-01-02 , Coot , at P2\n")
    got = sorted((r["date"], r["species"], r["location"], r["notes"]) for r in imported(spark, str(tmp_path / "a.txt")).collect())
    assert got == [("2024-01-01", "hot plate", "at P1", "7"), ("2024-01-02", "Coot", "at P2", None)]
    assert [sniffed(x) for x in ("2024-01-01,species,location", '"Observation Date","common name"', "\ufeffdate\tx", "heated,platelets")] == ["lines", "csv", "tsv", "lines"]
