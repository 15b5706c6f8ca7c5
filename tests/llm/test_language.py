"""Language identification against a plain computation, and held-out accuracy; nulls, texts without letters, long words, an empty table."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import language

BITS = {"aa": ["the", "then", "thistle", "ö"], "bb": ["der", "dern", "Distel", "übel"], "cc": ["quel", "quando", "Être", "日本語"]}


def made(n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        lang = rng.choice(list(BITS))
        words = [rng.choice(BITS[lang]) + rng.choice(("", "", BITS[lang][1], "x" * rng.randint(0, 3))) for _ in range(rng.randint(1, 30))]
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None))
    return rows + [(9001, None, "aa"), (9002, "", "bb"), (9003, "12 34 _ ½ ²", "cc"), (9004, "½the²", None), (9005, "žžž", None), (None, "der dern", "aa"), (9006, "the", ""), (3, rows[3][1], rows[3][2]), (9007, "dern" * 40_000, None), (9008, "thez " * 60_000 + "der", None)]


def held(doc_id, n=5):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == 0


def words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain_counts(rows):
    found = collections.defaultdict(collections.Counter)
    for doc, text, lang in rows:
        if lang is not None and doc is not None and not held(doc):
            for w in words(text):
                found[0, w][lang] += 1
                for n in (6, 5, 4, 3, 2, 1):
                    for i in range(len(w) + 3 - n):
                        found[n, f" {w} "[i : i + n]][lang] += 1
    return {(*k, lang): n for k, c in found.items() for lang, n in c.items() if n >= 2}


def plain_prediction(counts, langs, text):
    if not any(c.isalpha() for c in text or "") or not langs:
        return "und", 0.0
    totals = {k: {lang: sum(n for (kind, _, x), n in counts.items() if kind == k and x == lang) or 1 for lang in langs} for k in range(7)}
    score = dict.fromkeys(langs, 0.0)

    def value(kind, feature, lang):
        n = counts.get((kind, feature, lang))
        return math.log10(n / totals[kind][lang]) if n else -math.log10(max(1, *totals[kind].values())) - language.LACKING

    known = {k[:2] for k in counts}
    for w, times in collections.Counter(words(text)).items():
        if not any(c.isalpha() for c in w):
            continue
        features = [(0, w)] if (0, w) in known else []
        for n in (6, 5, 4, 3, 2, 1):
            if not features:
                p = f" {w} " if n > 1 else w
                features = [(n, p[i : i + n]) for i in range(len(p) - n + 1) if (n, p[i : i + n]) in known]
        for lang in langs if features else ():
            score[lang] += times * sum(value(*f, lang) for f in features) / len(features)
    best = max(sorted(langs), key=score.get)
    return best, 1 / sum(10 ** max(-300, score[x] - score[best]) for x in langs)


@pytest.fixture(scope="module")
def rows():
    return made(300)


def test_against_plain(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).withColumns({c: F.lit("x") for c in ("of", "share", "word", "n", "kind", "score", "source")})
    counts = plain_counts(rows)
    got = {(r["kind"], r["feature"], r["lang"]): r["n"] for r in language.feature_counts(docs.filter(F.col("lang").isNotNull() & (language.fold(F.col("doc_id")) != 0)), 2).collect()}
    assert got == counts
    langs = sorted({k[2] for k in counts})
    out = collections.defaultdict(list)
    for r in language.identified(docs).collect():
        out[r["doc_id"]].append((r["held_out"], r["lang_pred"], r["score"]))
    assert sum(map(len, out.values())) == len(rows)
    for doc, text, _ in rows:
        want = plain_prediction(counts, langs, text)
        for h, lang, score in out[doc]:
            assert h == held(doc) and lang == want[0] and score == pytest.approx(want[1], abs=1e-6), (doc, (text or "")[:50])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert rows.filter("lang_pred = lang").count() >= 0.97 * rows.count() > 100


def test_no_labels_and_no_rows(spark, rows):
    docs = spark.createDataFrame(rows[:20], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert language.identified(docs.filter("false")).count() == 0


def test_a_full_memory_starts_again(monkeypatch, rows):
    import pandas as pd

    model = language.Model.of(pd.DataFrame([(lang, kind, f, n) for (kind, f, lang), n in plain_counts(rows).items()], columns=["lang", "kind", "feature", "n"]))
    texts = [t for _, t, _ in rows if t]
    want = [language.Reader(model).predict(t) for t in texts]
    monkeypatch.setattr(language, "REMEMBERED", 5)
    monkeypatch.setattr(language, "PART", 20)
    small = language.Reader(model)
    got = [small.predict(t) for t in texts]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
