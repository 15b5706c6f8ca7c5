"""The Merkle manifest against a plain tree in Python: nulls, ties, repeated rows, lone leaves, several tiers, an empty table."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, at):
    """(before, after) of each level."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % 3
        run = nodes[first : first + 3]
        out.append((run[: at - first], run[at - first + 1 :]))
        at //= 3
    return out


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    levels = {s: tree([leaf(r) for r in rs]) for s, rs in trees.items()}
    top = tree([levels[s][-1][0] for s in sources])
    root, out = top[-1][0], []
    for k, s in enumerate(sources):
        for at, r in enumerate(trees[s]):
            path = way(levels[s], at) + way(top, k)
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            d = leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)
            for before, after in path:
                d = h(*before, d, *after)
            out.append((r[0], leaf(r), levels[s][-1][0], root, h(*[x for b, a in path for x in b + a]), d, d == root))
    return sorted(map(str, out))


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SHAPE = "doc_id long, source string, lang string, n_chars int, text string"


def made(n):
    rng = random.Random(n)
    rows = [(i, rng.choice(("a", "a", "a", "b", "é", "", None)), rng.choice(("en", None)), rng.choice((1, -2, None)), rng.choice(("x\ny", "one line", "", None, "ü\n😀" * 50))) for i in range(n)]
    return rows + [(7, "a", "en", 1, "tie\n"), (7, "a", "en", 1, "tie"), (7, "a", "en", 1, "tie"), (None, "a", None, None, "no\nid"), (None, None, None, None, None), (n, "zz alone", "de", 4, "\n" * 9)]


@pytest.mark.parametrize(("n", "height"), [(0, 6), (5, 1), (140, 1), (140, 2), (140, 6)])
def test_against_plain_trees(spark, n, height):
    rows = made(n)
    docs = spark.createDataFrame(rows, SHAPE).repartition(3).withColumns({c: F.lit("x") for c in ("tree", "pos", "digest", "block", "leaves", "path", "of", "_at")})
    got = merkle.audited(docs, height=height).select(*COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)


def test_one_row_and_no_row(spark):
    docs = spark.createDataFrame([(1, "a", "en", 1, "t")], SHAPE)
    got = merkle.audited(docs).first()
    assert got["root"] == got["subroot"] == got["leaf"] == got["folded_root"] and got["proof_sha256"] == h() and got["verified"]
    assert merkle.audited(docs.filter("false")).count() == 0


def test_a_source_of_many_equal_rows(spark):
    docs = spark.range(900).select(F.lit(3).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.lit("same").alias("text"))
    rows = [(3, "a", None, 1, "same")] * 900
    assert sorted(str(tuple(r)) for r in merkle.audited(docs, height=2).select(*COLUMNS).collect()) == plain(rows)


def test_van_emde_boas_order():
    # Four levels split at half height: the top two levels first, then nine subtrees of two levels.
    four = merkle.Layout(4)
    assert [list(x) for x in four.level[:2]] == [[0], [1, 2, 3]]
    assert list(four.level[2][:3]) == [4, 8, 12] and list(four.level[3][:4]) == [5, 6, 7, 9]
    for levels in range(1, 8):
        flat = [a for level in merkle.Layout(levels).level for a in level.tolist()]
        assert sorted(flat) == list(range((3**levels - 1) // 2))


def test_any_change_shows(spark):
    rows = made(60)
    docs = spark.createDataFrame(rows, SHAPE)
    roots = {merkle.audited(docs).first()["root"]}
    for column, value in (("text", "other"), ("lang", "xx"), ("n_chars", 99), ("source", "b")):
        changed = docs.withColumn(column, F.when(F.col("doc_id") == 30, F.lit(value)).otherwise(F.col(column)))
        roots.add(merkle.audited(changed).first()["root"])
    assert len(roots) == 5
