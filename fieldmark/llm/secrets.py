"""Secret scans: patterns, and a likelihood ratio of two character Markov models.

The models are first-order chains over bytes with a begin and an end state: one of random strings,
learned from the values that the base patterns label as secrets, and one of ordinary identifiers, learned
from the other words of at least LEAST identifier characters. Both are counted over all documents but
every fourth (numpy counts a batch, Spark sums the batches; the counts are a table of fixed size,
2 x STATES x STATES, whatever the input). The labelled words of the fourth set the threshold, a ratio a
character: midway between the least that at most FALSE of its ordinary words reach and the greatest that
RECALL of its random strings reach (the former, if they cross). A word of at least CANDIDATE characters
that reaches it is a span of kind `random`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import stored, table, whole_text
from fieldmark.llm.spans import ONE, matches, spans

# The base patterns.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a maximal run of 32 or more
#: A word that the models judge.
WORDLIKE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
BASE = ("assign", "access", "hex")
LEAST, CANDIDATE = 5, 20
IDENTIFIER = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
#: The threshold where there are fewer than FEW labelled words of a kind to set it, and the histogram's step.
THRESHOLD, FALSE, RECALL, FEW, STEP = 0.8, 0.0005, 0.99, 40, 0.02
BINS = 512

#: States: 0 begin or end, 1 any other byte, then the characters of a candidate word.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATE = np.ones(256, np.int64)
STATE[list(b" \t\n\x0b\x0c\r")] = 0
for _i, _c in enumerate(ALPHABET):
    STATE[_c] = _i + 2
STATES = len(ALPHABET) + 2


def pair_counts(data: bytes) -> np.ndarray:
    """Transitions between states in words that white space separates."""
    s = STATE[np.frombuffer(b" " + data + b" ", np.uint8)]
    return np.bincount(s[:-1] * STATES + s[1:], minlength=STATES * STATES)


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds assign, access, hex: array<struct<start,end,value>>, as the contract has them."""
    text = F.col("text")
    lower = F.lower(text)
    word = F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("api"))
    kinds = {"assign": (ASSIGN, word), "access": (ACCESS, F.contains(text, F.lit("AKIA"))), "hex": (HEX, F.lit(True))}
    rows = rows.select("*", *[matches(text, *v).alias(k) for k, v in kinds.items()])
    rows = rows.withColumns({k: spans(text, v[0], F.col(k)) for k, v in kinds.items()})
    return rows.withColumns({
        "assign": F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 8),
        "access": F.filter("access", lambda s: F.length(s["value"]) >= 16),
    })


def labelled(rows: DataFrame) -> DataFrame:
    """fold (0 sets the threshold, 1 to 3 train), random, ordinary: each document's labelled words, joined by blanks."""
    values = F.concat(F.transform("assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 1)), F.transform("access", lambda s: s["value"]), F.transform("hex", lambda s: s["value"]))
    # Taken out of the text before ordinary words are read from it.
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))
    return rows.select(F.pmod(F.xxhash64("text"), F.lit(4)).alias("fold"), F.array_join(values, " ").alias("random"), F.array_join(words, " ").alias("ordinary"))


def models(words: DataFrame) -> np.ndarray:
    """Log-probability ratios [state, next state] of random strings against ordinary identifiers. Only the table of counts reaches the driver."""

    def count(batches):
        total = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            for label, column in enumerate(("ordinary", "random")):
                for first in range(0, batch.num_rows, 256):
                    found = " ".join(t for t in batch.column(column).slice(first, 256).to_pylist() if t)
                    if found:
                        total[label] += pair_counts(found.encode())
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(total[label, pair])], names=["label", "pair", "n"])

    counted = words.filter("fold <> 0").mapInArrow(count, "label long, pair long, n long")
    total = np.ones((2, STATES * STATES))
    for r in counted.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        total[r["label"], r["pair"]] += r["n"]
    total = total.reshape(2, STATES, STATES)
    p = np.log(total / total.sum(axis=2, keepdims=True))
    return p[1] - p[0]


def ratios(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood ratio a character, random against ordinary, and the length of each word of data (parted by one blank)."""
    s = STATE[np.frombuffer(b" " + data + b" ", np.uint8)]
    ends = np.flatnonzero(s == 0)
    total = np.add.reduceat(np.r_[table[s[:-1], s[1:]]], ends[:-1])
    size = np.diff(ends)
    return total / size, size - 1


def calibrate(words: DataFrame, table: np.ndarray) -> tuple[float, dict[str, float]]:
    """The threshold, and its measured recall and false alarms on words that the models didn't see."""

    def bins(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for label, column in enumerate(("ordinary", "random")):
                for text in batch.column(column).to_pylist():
                    if text:
                        ratio, size = ratios(text.encode(), table)
                        at = np.clip(ratio[size >= LEAST] / STEP + BINS // 2, 0, BINS - 1).astype(np.int64)
                        total[label] += np.bincount(at, minlength=BINS)
        label, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(at), pa.array(total[label, at])], names=["label", "bin", "n"])

    seen = np.zeros((2, BINS))
    for r in words.filter("fold = 0").mapInArrow(bins, "label long, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect():
        seen[r["label"], r["bin"]] += r["n"]
    from_here = seen[:, ::-1].cumsum(axis=1)[:, ::-1]
    if seen[0].sum() < FEW or seen[1].sum() < FEW:
        cut = THRESHOLD
    else:
        low = int(np.argmax(from_here[0] <= FALSE * seen[0].sum()))
        high = int(np.flatnonzero(from_here[1] >= RECALL * seen[1].sum())[-1])
        cut = (max(low, (low + high) // 2) - BINS // 2) * STEP
    at = min(BINS - 1, max(0, round(cut / STEP) + BINS // 2))
    share = lambda k: float(from_here[k, at] / seen[k].sum()) if seen[k].sum() else float("nan")
    return cut, {"recall": share(1), "false_alarms": share(0), "random": float(seen[1].sum()), "ordinary": float(seen[0].sum())}


def secrets(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, assign, access, hex, random: array<struct<start,end,value,..>> each, and scores: the random spans' ratios.

    Without a threshold it is calibrated (THRESHOLD where fewer than FEW words of either label are there for that).
    Null text counts as empty and has no spans; empty tables give empty results; repeated rows are
    judged each by itself and a null doc_id is kept. Random spans that overlap a base span aren't
    repeated. Only doc_id and text are read of the input.
    """
    rows = base_spans(docs.select("doc_id", whole_text().alias("text")))
    words = stored(labelled(rows), "secret-words")
    llr = models(words)
    if threshold is None:
        threshold, _ = calibrate(words, llr)

    @F.arrow_udf("array<double>")
    def score(words: pa.Array) -> pa.Array:
        flat = words.flatten()
        found = ratios(" ".join(flat.to_pylist()).encode(), llr)[0] if len(flat) else []
        offsets = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, pa.float64()))

    text = F.col("text")
    rows = rows.withColumn("random", matches(text, WORDLIKE, text.rlike("[A-Za-z0-9+/_=-]{20}")))
    rows = rows.withColumn("random", spans(text, WORDLIKE, F.col("random")))
    # Called non-deterministic, so that Spark moves no condition on its result below the call.
    rows = rows.withColumn("scores", score.asNondeterministic()(F.transform("random", lambda s: s["value"])))
    base = F.concat(*map(F.col, BASE))
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    both = F.filter(F.arrays_zip(F.col("random"), F.col("scores")), lambda x: (x["scores"] >= threshold) & apart(x["random"]))
    rows = rows.withColumn("both", both)
    return rows.select("doc_id", *BASE, F.transform("both", lambda x: x["random"]).cast(ONE).alias("random"), F.transform("both", lambda x: x["scores"]).alias("scores"))


def _by_start(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start, then kind as listed."""

    def keyed(n: int, k: str) -> Column:
        return F.transform(k, lambda s: F.struct(s["start"].alias("at"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")).alias("says")))

    each = [keyed(n, k) for n, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda x: x["says"]), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    rows = secrets(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_by_start(BASE).cast("binary"), 256).alias("base_sha256"),
        _by_start((*BASE, "random")).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
