"""Spelling variants against plain Python: every pair one edit apart, slips, ties, chains of forms, nulls, an empty table."""

import collections
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from fieldmark.llm import variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_against_plain(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abÀéÿ×z", k=rng.randint(4, 11))) for _ in range(25)]
    words = [s[:i] + rng.choice(("", "a", "bz", "é", "÷")) + s[i + rng.randint(0, 1) :] for s in stems for i in range(len(s)) for _ in range(2)] + stems * 6
    rows = [(i, rng.choice((" ", "-", "1", "\n", "日", "Ÿ")).join(x.upper() if x.isascii() and rng.random() < 0.2 else x for x in rng.choices(words, k=60))) for i in range(150)]
    rows += [(3, None), (4, ""), (None, "chain chain chains"), (None, " ".join(["chain"] * 4 + ["chains"] * 3 + ["chainst"] * 20 + ["chainstx"] * 60)), (5, "repeat repeat"), (5, "repeat repeat"), (6, "É" * 3000 + " " + "tiedq tiedw tiedx " * 3 + "tiede tieda " * 9), (7, "é1é2" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("x") for c in ("word", "n", "key", "form", "len")})
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.variants(docs).collect()}
    want = plain(rows)
    assert got == want and len(want) > 150
    assert any(v[0] and v[1] != v[0] for v in want.values()) and any(len(w) == 5 for w in want)
    assert variants.variants(docs.filter("false")).count() == 0


def test_all_pairs_one_edit_apart_meet(spark):
    rng = random.Random(6)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(700)}
    pairs = variants.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).select("a", "b").collect()
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p)}
    assert {frozenset(p) for p in pairs} == want and len(pairs) == len(want)


def test_long_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w36"), ("y", "z")], "word string, form string")
    got = {r["word"]: r["root"] for r in variants.followed(forms).collect()}
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "x": "w37", "y": "z"}
