"""URL filter: rules, and where none fits, naive Bayes over segmented host and path tokens.

Runs of letters in host labels and paths are split into words by a unigram Viterbi search. Spark counts
the words of all pages' text exactly, joins the counts with the parts of the distinct runs, splits each
run once with the counts of its own parts, and joins the words with the pages' runs again; no task holds
more counts than one run has parts.
A multinomial naive Bayes model learns from the urls that a rule judges: each token's counts by verdict are summed
exactly and joined with the pages' tokens again. Both verdicts are taken to be as likely beforehand (how many
pages the rules happen to name says nothing about the others), and a class's shares are smoothed towards
those of both classes, so that tokens that neither knows count for neither.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import ascii_lower, stored, table

# The rules, as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
SMOOTH = 50.0
LONGEST = 24
#: Starts of runs that are handed on at a time.
BLOCK = 256
OPEN, CLOSE = re.compile(r"<(script|style)?", re.I), {n: re.compile(f"</{n}>", re.I) for n in ("script", "style")}
LETTERS = re.compile(r"[^\W\d_]+")
SPLIT = re.compile(r"[^0-9a-z\x80-\U0010ffff]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null urls and urls without ://."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host+path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def untagged(html: str) -> str:
    """html with a blank for each tag, and for each script or style with what it holds. One that never closes is a plain tag, and a < without a >
    stays. Each place is looked at once: what isn't found from one place on isn't looked for again."""
    out, at, absent = [], 0, set()
    while found := OPEN.search(html, at):
        name, end = (found[1] or "").lower(), -1
        if name and name not in absent:
            close = CLOSE[name].search(html, found.end())
            if close:
                end = close.end()
            else:
                absent.add(name)
        if end < 0:
            end = html.find(">", found.start()) + 1
            if not end:
                break
        out += [html[at : found.start()], " "]
        at = end
    return "".join(out) + html[at:]


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: the words of all pages' text that are at most LONGEST long; the word "" counts all longer ones."""

    def count(batches):
        for batch in batches:
            seen = Counter()
            for html in batch.column("html"):
                seen.update(w if len(w) <= LONGEST else "" for w in LETTERS.findall(untagged(html.as_py() or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return pages.select("html").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def split(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The words whose unigram probabilities have the greatest product."""
    known = {w: math.log(total) - math.log(n) for w, n in counts.items()}
    new = math.log(total)
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):
        cost, start = min((best[s] + known.get(run[s:end], new + 2.5 * (end - s)), s) for s in range(max(0, end - LONGEST), end))
        best.append(cost)
        back.append(start)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def marked_runs(host: str, path: str) -> list[str]:
    """Runs of letters as H:run and P:run, still to be split, and the digits' tokens as they are."""
    out = [f"{'h' if run[0].isdigit() else 'H'}:{run}" for label in SPLIT.split(host) if label for run in re.findall(r"\d+|[^\d]+", label)]
    for part in SPLIT.split(path.lower()):
        for run in re.findall(r"\d+|[^\d]+", part):
            out += [f"p:#{len(run)}", f"p:#{run[0]}"] if run[0].isdigit() else [f"P:{run}"]
    return out


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run, words: each distinct run split by the exact counts of its parts. Parts travel with their run's number, and those of a long
    run a block of starts at a time, so a run of any length needs memory for itself and its known parts only."""
    runs = stored(runs.withColumn("id", F.monotonically_increasing_id()), "url-distinct")

    def parts(batches):
        ids, found = [], []
        for batch in batches:
            for id, run in zip(batch.column("id").to_pylist(), batch.column("run").to_pylist()):
                for first in range(0, len(run), BLOCK):
                    new = {run[s:e] for s in range(first, min(first + BLOCK, len(run))) for e in range(s + 1, min(s + LONGEST, len(run)) + 1)}
                    ids += [id] * len(new)
                    found += new
                    if len(ids) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "part"])
                        ids, found = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "part"])

    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    known = runs.select("id", "run").mapInArrow(parts, "id long, part string").join(counts, F.col("part") == F.col("word")).select("id", F.struct("word", "n").alias("one"))
    each = runs.join(known.groupBy("id").agg(F.collect_set("one").alias("known")), "id", "left")

    @F.arrow_udf("array<string>")
    def words(run: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array([split(r, {x["word"]: x["n"] for x in k or ()}, total) for r, k in zip(run.to_pylist(), known.to_pylist())], pa.list_(pa.string()))

    return each.select("run", words("run", "known").alias("words"))


def tokenized(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows, a number for each (row), and their tokens, h:word of the host and p:word of the path in their order."""

    @F.arrow_udf("array<string>")
    def runs_of(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([marked_runs(h.as_py(), p.as_py()) for h, p in zip(hosts, paths)], pa.list_(pa.string()))

    # Stored, as the row numbers have to be the same each time they are read.
    rows = stored(rows.withColumns({"row": F.monotonically_increasing_id(), "runs": runs_of("host", "path")}), "url-runs")
    each = rows.select("row", F.posexplode("runs").alias("at", "mark"))
    letters, marks = F.substring("mark", 1, 2).isin("H:", "P:"), F.substring("mark", 3, 1 << 30)
    open_ = each.filter(letters).select("row", "at", F.lower(F.substring("mark", 1, 2)).alias("kind"), marks.alias("run"))
    words = stored(segmented(open_.select("run").distinct(), counts), "url-words")
    done = open_.join(words, "run").select("row", "at", F.transform("words", lambda w: F.concat("kind", w)).alias("tokens"))
    all_ = done.unionByName(each.filter(~letters).select("row", "at", F.array("mark").alias("tokens")))
    all_ = all_.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    return rows.drop("runs").join(all_, "row", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def token_odds(known: DataFrame) -> DataFrame:
    """token, odds: the log odds of block of each token of the rows (said, tokens); none where one verdict has no tokens."""
    blocked, n = F.col("said") == "block", F.count("*")
    counts = stored(known.select("said", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if(blocked).alias("block"), (n - F.count_if(blocked)).alias("allow")), "token-counts")
    block, allow = counts.agg(F.sum("block"), F.sum("allow")).first()
    if not block or not allow:
        return counts.filter("false").select("token", F.lit(0.0).alias("odds"))
    share = lambda c, all_: (F.col(c) + SMOOTH * (F.col("block") + F.col("allow")) / (block + allow)) / (all_ + SMOOTH)
    return counts.select("token", (F.log(share("block", block)) - F.log(share("allow", allow))).alias("odds"))


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words (the host's), score (log odds of block).

    Null urls and urls without :// have empty host and path and no tokens: their score is 0. A score of 0, and
    every page where rules judge no page or all pages alike, is allowed. Repeated rows are judged each by
    itself; empty tables give empty results. Only page_id, url and html are read.
    """
    host, path = host_and_path(F.col("url"))

    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = tokenized(rows.select("*", rule.alias("rule"), verdict.alias("said")), stored(word_counts(pages), "word-counts"))
    rows = stored(rows, "url-tokens")
    odds = token_odds(rows.filter("said IS NOT NULL"))
    # Copies of a token in one row are counted first; sums are decimals, so scores don't depend on their order.
    each = rows.select("row", F.explode("tokens").alias("token")).groupBy("row", "token").agg(F.count("*").alias("n"))
    scores = each.join(odds, "token").groupBy("row").agg(F.sum((F.col("n") * F.col("odds")).cast("decimal(28,12)")).cast("double").alias("score"))
    rows = rows.join(scores, "row", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    words = F.transform(F.filter("tokens", lambda t: t.startswith("h:")), lambda t: F.substring(t, 3, 1 << 20))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), words.alias("words"), "score")


def op8_urls(spark, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict", F.array_join("words", " ").alias("words"), "score")
