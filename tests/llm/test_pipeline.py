"""The pipeline's stages on a small table with nulls, empty texts, repeats and clashing columns, and on an empty one."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
LINE = "This line is long enough to count as a passage, surely it is."
WORDS = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, f"{LINE}\nown one", "en", "a", 73), (2, f"  {LINE.upper()}\nown two", "en", "a", 75), (3, LINE, "de", "b", 61), (4, f"{LINE}\n{LINE}", None, None, 123), (5, f"x\n{LINE}\t", "en", "b", None),
    (6, None, "en", "b", None), (7, "", None, None, 0), (8, WORDS, "en", "a", 229), (9, WORDS + " tail", "en", "a", 234), (10, WORDS, "fr", "c", 229), (10, WORDS, "fr", "c", 229), (None, "no id here at all", "fr", "c", 17), (11, "ünïcödé " * 5000, "fr", "d", 40000),
]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit("x") for c in ("n", "k", "d", "size", "kept", "taken", "tie", "copies", "label")})


def rows_of(spark, docs, name):
    out = STAGES[name](spark, docs, SF)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
    return [r.asDict() for r in out.collect()]


def test_the_stages_are_those_asked_for():
    assert list(STAGES) == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "best-fit packing"]


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables_stay_empty(spark, docs, name):
    assert rows_of(spark, docs.filter("false"), name) == []


def test_toxicity_keeps_rows_as_they_are(spark, docs):
    given = collections.Counter((r[0], r[1], r[3]) for r in ROWS)
    got = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in rows_of(spark, docs, "toxicity"))
    assert not got - given  # nothing new, nothing changed, nothing repeated


def test_line_dedup_changes_texts_and_keeps_documents_that_were_empty(spark, docs):
    got = {r["doc_id"]: (r["text"] or "", r["n_chars"]) for r in rows_of(spark, docs, "line dedup")}
    assert got[1] == ("own one", 7) and got[2] == ("own two", 7) and got[5][0] == f"x\n{LINE}\t"
    assert 3 not in got and 4 not in got and {6, 7, 8, 9, 10, 11, None} <= set(got)


def test_one_of_each_group_of_near_copies_stays(spark, docs):
    got = collections.Counter(r["doc_id"] for r in rows_of(spark, docs, "n-gram Jaccard join"))
    assert got[8] == 1 and 9 not in got and 10 not in got
    assert all(got[i] == 1 for i in (6, 7, 11, None))


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(8, WORDS), (8, WORDS), (9, WORDS), (12, WORDS.upper()), (20, "a b c"), (20, "a b c"), (20, "d e f"), (None, "x"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r["doc_id"], r["text"]) for r in rows_of(spark, docs, "n-gram Jaccard join"))
    assert got == {(8, WORDS): 1, (20, "a b c"): 1, (20, "d e f"): 1, (None, "x"): 2}


def test_the_whole_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert got and {r["doc_id"] for r in got} < ids  # some documents are rejected or near copies


def test_mixing_takes_at_most_three_copies_and_agrees_with_itself(spark, docs):
    one, two = (rows_of(spark, d, "mixing") for d in (docs, docs.repartition(5)))
    assert sorted(map(str, one)) == sorted(map(str, two))
    given = collections.Counter(r[0] for r in ROWS)
    assert all(n <= 3 * given[i] for i, n in collections.Counter(r["doc_id"] for r in one).items())
    assert {r["doc_id"] for r in one} >= {6, 7}  # without words: no share of the mix to settle


def test_packing_has_every_piece_in_its_place(spark, docs):
    bins = collections.defaultdict(list)
    got = rows_of(spark, docs, "best-fit packing")
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS}
