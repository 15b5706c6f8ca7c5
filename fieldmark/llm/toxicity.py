"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on toxic and one on ordinary text. A
text is cut into overlapping windows; a window's distance is its compressed length with the ordinary
dictionary less its length with both. A logistic curve over a text's largest distances, fitted on
labelled texts that the dictionaries haven't seen, is its score.

The toxic dictionary is trained on the toxic documents of the sample, each cut down to what sets it
apart: its words that, over all of the sample, follow far more different words in toxic than in ordinary
texts (copies of one text always bring the same word before). The rest of a toxic text is as ordinary as
any other text and would fill the dictionary. How often such a word must be seen grows with the number of
toxic documents in the sample (SHARE), so that chance finds stay out at any sample size.

Fitted on a bounded sample of labelled rows: at most `sample` documents of each label for the
dictionaries and as many for the curve, those with the lowest hash of doc_id; at most WORDS words and
WINDOWS windows reach the driver. The curve's rows weigh as many labels as they stand for, so that it
keeps the labels' own shares at any size. Scoring is one pass over all documents, no shuffle.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import zstandard as z
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from fieldmark.llm.common import WORD, ascii_lower, stored, table, whole_text

WIDTH, STRIDE = 96, 84
SAMPLE, WORDS, WINDOWS = 3000, 2048, 8000
TOXIC_BYTES, ORDINARY_BYTES = 8192, 16384
MIN_BEFORE, SHARE, LIFT = 4, 0.008, 30.0
CUT, KEEP = 0.3, 0.95


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4: 2 is held out, 1 calibrates, 0 and 3 train."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


class Compressors:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.both, self.ordinary = self._open(toxic + ordinary), self._open(ordinary)

    @staticmethod
    def _open(content: bytes):
        how = z.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, strategy=z.STRATEGY_BTLAZY2, min_match=6, window_log=18, hash_log=16, chain_log=16, search_log=6, target_length=64)
        if not content:
            return z.ZstdCompressor(compression_params=how)
        book = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(compression_params=how)
        return z.ZstdCompressor(dict_data=book, compression_params=how)

    def distances(self, text: str) -> tuple[float, float]:
        """The largest distance of a window, and the mean of the three largest."""
        b = b" " + b" ".join(text.encode().lower().split()) + b" "
        a, o, found = self.both.compress, self.ordinary.compress, []
        for i in range(0, max(1, len(b) - WIDTH + STRIDE), STRIDE):
            w = b[i : i + WIDTH]
            found.append(len(o(w)) - len(a(w)))
        found.sort()
        top = found[-3:]
        return float(top[-1]), sum(top) / len(top)


class Model:
    """Dictionaries, the curve, and the score from which a filter rejects (see `best_cut`)."""

    def __init__(self, toxic: bytes, ordinary: bytes, curve: tuple[float, float, float], cut: float = CUT):
        self.toxic, self.ordinary, self.curve, self.cut = toxic, ordinary, curve, cut

    def score(self, most: float, mean: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * most + c * mean))))


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, label, part (train or curve) of the labels that the model may learn from."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return marks.withColumn("part", F.when(fold(F.col("doc_id")) == 1, "curve").when(fold(F.col("doc_id")) != 2, "train")).filter("part IS NOT NULL")


def sampled(docs: DataFrame, marks: DataFrame, sample: int) -> DataFrame:
    """text, label, part of the documents in the sample.

    The sample's ids are at most 4 * sample; Spark joins them with the documents.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = None
    for label in (0, 1):
        for part in ("train", "curve"):
            one = marks.filter((F.col("label") == label) & (F.col("part") == part)).orderBy(*order).limit(sample)
            some = one if some is None else some.unionByName(one)
    ids = some.select(F.col("doc_id").alias("id"), "label", "part")
    texts = docs.select("doc_id", whole_text().alias("text"))
    # At most 4 * sample rows of two numbers and a word: broadcast, so that documents aren't shuffled.
    return stored(texts.join(F.broadcast(ids), texts["doc_id"] == ids["id"]).select("text", "label", "part"), "toxicity-sample")


def word_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, pos, word, before: the words of each text without marks at their ends, and the word before each."""
    bare = F.transform(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), lambda w: F.btrim(w, F.lit(".,;:!?")))
    pairs = F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("before"))
    rows = docs.select(*keep, bare.alias("w")).filter(F.size("w") > 0)
    return rows.select(*keep, F.posexplode(pairs).alias("pos", "x")).select(*keep, "pos", "x.word", "x.before")


def telling_words(train: DataFrame) -> DataFrame:
    """word: at most WORDS words that set toxic text apart from ordinary text."""
    pairs = word_rows(train, "label").select("label", "word", "before").distinct()
    side = lambda y: F.count_if(F.col("label") == y)
    counts = pairs.groupBy("word").agg(side(1).alias("toxic"), side(0).alias("ordinary"))
    total = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    least = max(MIN_BEFORE, math.ceil(SHARE * train.filter("label = 1").count()))
    lift = (F.col("toxic") * float(total[1] or 0)) / ((F.col("ordinary") + 0.3) * float(total[0] or 1))
    found = counts.filter((F.col("toxic") >= least) & (F.length("word") > 3) & (lift >= LIFT))
    return stored(found.orderBy(F.col("toxic").desc(), "word").limit(WORDS).select("word"), "toxicity-words")


def toxic_samples(train: DataFrame) -> list[bytes]:
    """The toxic training texts, each cut down to its telling words in their order; at most `sample` rows reach the driver."""
    rows = word_rows(train.filter("label = 1").withColumn("doc", F.monotonically_increasing_id()), "doc")
    # At most WORDS rows.
    rows = rows.join(F.broadcast(telling_words(train)), "word").groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("t"))
    found = sorted(f" {r['t']} ".encode() for r in rows.select("t").collect())
    random.Random(3).shuffle(found)  # the trainer takes parts of the dictionary from stretches of the samples
    return found


def dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's bytes; where there is too little to train on, the samples themselves."""
    try:
        return z.train_dictionary(size, samples).as_bytes()
    except (z.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Ridge Newton fit of label on the two distances; row i counts n[i] times."""
    a = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, 3))
    w = np.array([-3.0, 0.5, 0.5])

    def loss(w: np.ndarray) -> float:
        line = a @ w
        return float((n * (np.logaddexp(0, line) - y * line)).sum() + 0.05 * w @ w)

    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (n * p * (1 - p))[:, None]) + 0.1 * np.eye(3), a.T @ (n * (y - p)) - 0.1 * w)
        # A whole step may lead far away where the start is bad.
        while loss(w + step) > loss(w) and np.abs(step).max() >= 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The score from which a filter rejects: of those that leave KEEP of the ordinary rows alone, the one that adds up to
    the largest shares of toxic rows caught and ordinary rows left alone. CUT where nothing is better than chance."""
    if not (y == 1).any() or not (y == 0).any():
        return CUT
    known = np.unique(scores)
    cuts = (known[1:] + known[:-1]) / 2  # between scores, so that rounding doesn't decide
    caught, hit = np.sort(scores[y == 1]), np.sort(scores[y == 0])
    kept = np.searchsorted(hit, cuts) / len(hit)
    gain = (len(caught) - np.searchsorted(caught, cuts)) / len(caught) + kept - 1
    gain[kept < KEEP] = 0
    return float(cuts[np.argmax(gain)]) if len(cuts) and gain.max() > 0 else CUT


def distances(docs: DataFrame, toxic: bytes, ordinary: bytes, *keep: str) -> DataFrame:
    """keep, most, mean: of each text's windows."""

    @F.arrow_udf("struct<most:double,mean:double>")
    def measured(texts: pa.Array) -> pa.Array:
        c = Compressors(toxic, ordinary)
        found = [c.distances(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)], ["most", "mean"])

    return docs.select(*keep, measured(whole_text()).alias("d")).select(*keep, "d.most", "d.mean")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    marks = marked(labels)
    rows = sampled(docs, marks, sample)
    train = rows.filter("part = 'train'")
    cuts = train.filter("label = 0").select(F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"(?s).{1,256}"), F.lit(0))).alias("w")).distinct()
    plain = [r["w"].encode() for r in cuts.orderBy(F.xxhash64("w"), "w").limit(WINDOWS).collect()]
    toxic, ordinary = dictionary(TOXIC_BYTES, toxic_samples(train)), dictionary(ORDINARY_BYTES, plain)
    seen = distances(rows.filter("part = 'curve'"), toxic, ordinary, "label").collect()
    # Of a label with more than `sample` curve rows each sampled row stands for several.
    count = {r["label"]: r["count"] for r in marks.filter("part = 'curve'").groupBy("label").count().collect()}
    stands = [max(1.0, count[r["label"]] / max(sample, 1)) for r in seen]
    x, y = np.array([[r["most"], r["mean"]] for r in seen]), np.array([r["label"] for r in seen], float)
    model = Model(toxic, ordinary, logistic(x, y, np.array(stands)))
    model.cut = best_cut(np.array([model.score(*v) for v in x]), y)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from CUT on), rejected (from the cut calibrated on the curve's rows on),
    then the columns named in `keep`.

    Null text counts as empty and gets the score of no distance; without labels the curve stays at
    its start and CUT is the cut; repeated rows are scored each by itself; a null doc_id is kept. Labels of
    null ids or other values than 0 and 1 teach nothing; of several labels of an id the largest counts.
    """
    model = fit(docs, labels, sample)
    rows = distances(docs.select("doc_id", "text", *[F.col(c).alias(f"_{c}") for c in keep]), model.toxic, model.ordinary, "doc_id", *[f"_{c}" for c in keep])
    a, b, c = model.curve
    line = F.greatest(F.least(F.lit(a) + F.lit(b) * F.col("most") + F.lit(c) * F.col("mean"), F.lit(30.0)), F.lit(-30.0))
    rows = rows.withColumn("score", F.round(1 / (1 + F.exp(-line)), 9))
    return rows.select("doc_id", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= model.cut).alias("rejected"), *[F.col(f"_{c}").alias(c) for c in keep])


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    rows = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
