"""Language identification, word first.

A text's words are scored by their log frequency in each language. A word that no language knows backs
off to its character n-grams, the longest ones first: of the greatest length at which some of them are
known, the known ones' mean log frequency counts. Of a language that lacks a known word or
n-gram a fixed log frequency, below all seen ones, counts. A text's language has the largest mean over its words.

Fitted on a bounded sample of labelled texts: at most `sample` bytes of text in all (as expected; documents are
taken whole, by a hash of doc_id), in equal shares for each language. Spark counts words and n-grams; what it
found at least LEAST times is broadcast: fewer than len(LENGTHS) + 1 entries for each byte of the sample. Scoring is one pass
over all documents, no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import handed_back, stored, table, whole_text

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 16 << 20
LENGTHS = (6, 5, 4, 3, 2, 1)  # of n-grams, in order of trial
LEAST = 2  # times that a word or n-gram must be found in a language's sample to be known there
LACKING = 1.5  # by how many powers of ten a lacking word is rarer than the rarest that a known one can be
REMEMBERED, WIDE = 200_000, 40  # words whose back-off a task remembers, and how long they may be
PART = 50_000  # words of a text that are worked on at once
UNKNOWN = "und"


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5: 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. Signs of numbers that aren't digits, as fractions, count with the letters beside them."""
    return WORD.findall(text.lower())


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """lang, text: labelled texts of about `sample` bytes, as many of each language if it has them."""
    known = docs.filter(F.col("lang").isNotNull() & F.coalesce(fold(F.col("doc_id")) != 0, F.lit(False)))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    # One row a language, which are few.
    share = sizes.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("langs")))).select(F.col("lang").alias("of"), (F.lit(float(sample)) / F.col("langs") / F.col("bytes")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1 << 30)) / float(1 << 30)
    return known.join(F.broadcast(share), F.col("lang") == F.col("of")).filter(chance < F.col("share")).select("lang", "text")


def feature_counts(sample: DataFrame, least: int) -> DataFrame:
    """lang, kind (0: word, else the n-gram's length), feature, n: those found at least `least` times."""

    def words(batches):
        for batch in batches:
            seen: dict = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                seen.setdefault(lang, Counter()).update(words_of(text.as_py() or ""))
            rows = [(lang, w, n) for lang, found in seen.items() for w, n in found.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])
        handed_back()

    counts = stored(sample.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def grams_at(n: int) -> Column:
        last = F.length(padded) - n + 1
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(n).alias("kind"), F.substring(padded, i, F.lit(n)).alias("feature")))

    gram = F.flatten(F.array(*map(grams_at, LENGTHS)))
    grams = counts.select("lang", "n", F.inline(gram)).groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n"))
    return counts.select("lang", F.lit(0).alias("kind"), F.col("word").alias("feature"), "n").unionByName(grams).filter(F.col("n") >= least)


class Model:
    """Log frequencies (base 10) of features: a list of words, then one of n-grams for each of LENGTHS, and for each list a table
    with a row a feature and a column for each of `langs`."""

    def __init__(self, langs: list[str], features: dict[int, list[str]], tables: dict[int, np.ndarray]):
        self.langs, self.features, self.tables = langs, features, tables

    @classmethod
    def of(cls, found: pd.DataFrame) -> Model:
        """From rows lang, kind, feature, n."""
        langs = sorted(found["lang"].unique())
        column = found["lang"].map({lang: i for i, lang in enumerate(langs)})
        features, tables = {}, {}
        for kind in (0, *LENGTHS):
            own = found["kind"] == kind
            place, names = pd.factorize(found["feature"][own])
            t = np.zeros((len(names), len(langs)))
            t[place, column[own].to_numpy(dtype=int)] = found["n"][own]
            total = np.maximum(t.sum(axis=0), 1.0)
            lacking = -np.log10(total.max(initial=1.0)) - LACKING
            with np.errstate(divide="ignore"):
                features[kind], tables[kind] = list(names), np.where(t > 0, np.log10(t / total), lacking)
        return cls(langs, features, tables)


class Reader:
    """Predicts by a model; remembers the back-off of up to REMEMBERED words."""

    def __init__(self, model: Model):
        self.langs, self.tables = model.langs, model.tables
        self.grams = {n: {g: i for i, g in enumerate(model.features[n])} for n in LENGTHS}
        self.known = len(model.features[0])
        # A row for each word; after the model's, one for what has no letter, one for letters that tell nothing, and the remembered ones.
        self.rows = np.zeros((self.known + 2 + REMEMBERED + PART, len(self.langs)))
        self.rows[: self.known] = self.tables[0]
        self.place = {w: i for i, w in enumerate(model.features[0])}
        self.none, self.blank, self.end = self.known, self.known + 1, self.known + 2

    def learn(self, words: list[str]) -> None:
        """Gives words that have none a row: of the longest n-grams of which some are known, the mean."""
        left = [w for w in words if w.isalpha() or any(map(str.isalpha, w))]
        self.place.update(dict.fromkeys(words, self.none))
        for n in LENGTHS:
            known, missing, done, at, counts = self.grams[n].get, [], [], [], []
            for w in left:
                # Blanks alone tell nothing.
                padded = f" {w} " if n > 1 else w
                found = [i for k in range(len(padded) - n + 1) if (i := known(padded[k : k + n])) is not None]
                if found:
                    at += found
                    counts.append(len(found))
                    done.append(w)
                else:
                    missing.append(w)
            if done:
                starts = np.cumsum([0, *counts[:-1]])
                end = self.end + len(done)
                self.rows[self.end : end] = np.add.reduceat(self.tables[n][at], starts) / np.array(counts)[:, None]
                self.place.update(zip(done, range(self.end, end)))
                self.end = end
            left = missing
        self.place.update(dict.fromkeys(left, self.blank))

    def predict(self, text: str) -> tuple[str, float]:
        """The language, and its share of the likelihoods by all words."""
        words = words_of(text) if text else []
        total, letters = np.zeros(len(self.langs)), False
        for first in range(0, len(words), PART):
            part = words[first : first + PART]
            if self.end > self.blank + REMEMBERED:
                for old in [w for w, i in self.place.items() if i >= self.none]:
                    del self.place[old]
                self.end = self.blank + 1
            at = list(map(self.place.get, part))
            if None in at:
                new = list({w: 0 for w, i in zip(part, at) if i is None})
                self.learn(new)
                at = list(map(self.place.get, part))
                for w in new:
                    if len(w) > WIDE:
                        del self.place[w]
            rows = np.array(at)
            letters = letters or bool((rows != self.none).any())
            total += self.rows[rows].sum(axis=0)
        if not letters or not self.langs:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        odds = np.exp(np.clip((total - total[best]) * math.log(10), -700, 0))
        return self.langs[best], float(1 / odds.sum())


def fit(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> Model:
    return Model.of(feature_counts(stored(sampled(docs, sample), "language-sample"), least).toArrow().to_pandas())


def identified(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """doc_id, held_out, lang_pred, score, of the columns doc_id, text, lang.

    Learns from text and lang of the rows whose fold is not 0 and whose lang is not null; predicts from the text alone. Null and
    empty texts and texts without a letter are `und` with score 0, as all texts are where nothing was learned; a text whose letters
    are all unknown gets the first language and an even score. Ties go to the first language. A null doc_id teaches nothing and isn't
    held out. Repeated rows are predicted each by itself; an empty table gives an empty result. Other columns aren't read.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    model = fit(rows, sample, least)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.features, model.tables))
    opened: list[Reader] = []

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        if not opened:
            opened.append(Reader(Model(*shared.value)))
        found = [opened[0].predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), predicted(whole_text()).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.round("p.score", 9).alias("score"))


def op12_language(spark, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))
