"""Spelling variants: words one edit apart, grouped under their most frequent neighbour.

1. Tasks count the words of their documents, Spark adds the counts up.
2. Asymmetric q-chunks: of two words one edit apart the shorter (of equal length: the lesser) gives two
   disjoint chunks, its halves; the other gives its grams of these lengths with their places. The edit
   leaves one half whole, at the same place or shifted by the difference in length, at most one.
   The other half holds the edit, so the same is done with it again: one of its own two halves is whole
   as well. A key is a whole half with a whole quarter, that is 3/4 of a word, which keeps the groups
   of words with one key small even where words share their stems.
3. Words that meet are verified by their edit distance. Pairs aren't capped.
4. Forms are followed to the last by pointer jumping; a form has at least twice the count, so chains are short.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import handed_back, stored, table, whole_text

#: Of Latin-1: letters stay, A-Z as a-z, all else becomes a blank.
LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
LETTERS, COUNT, LIFT = 5, 3, 2
SLIP = 97  # one run in so many loses a letter
HELD = 200_000  # words that a task adds up before it hands them on


def runs_of(text: str) -> list[bytes]:
    """The maximal runs of [A-Za-z\\u00C0-\\u00FF], A-Z lower-cased, as Latin-1 (a byte a code point)."""
    return text.encode("latin-1", "replace").translate(LETTER).split()


def crc_after(head: int, run: bytes) -> int:
    """crc32 that goes on with the run's UTF-8."""
    return zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)


def word_counts(docs: DataFrame, letters: int = LETTERS, count: int = COUNT) -> DataFrame:
    """word, n: of rows (doc_id, text)."""

    def work(batches):
        total: Counter = Counter()

        def out():
            found = {w.decode("latin-1"): n for w, n in total.items() if len(w) >= letters and n}
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                # A slip only shortens a run, so shorter ones never count.
                runs = [run for run in runs_of(text.as_py()) if len(run) >= letters]
                total.update(runs)
                head = zlib.crc32(f"{doc.as_py()}:".encode())
                slips = [(run, h) for run in set(runs) if (h := crc_after(head, run)) % SLIP == 0]
                if slips:
                    here = Counter(runs)
                    for run, h in slips:
                        at = h % len(run)
                        total[run] -= here[run]
                        total[run[:at] + run[at + 1 :]] += here[run]
                if len(total) >= HELD:
                    yield out()
        if total:
            yield out()
        handed_back()

    # A null id is written as nothing.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _part(word: Column, start: Column, length: Column) -> Column:
    return F.substring(word, start + 1, length)


def _keys(word: Column, m: Column, shift: Column) -> Column:
    """The keys of a word as the longer of a pair with a word of m letters (shift: how many it has more; 0 for the shorter one)."""
    first = F.floor(m / 2).cast("int")  # length of the shorter word's first half
    quarter, eighth = F.floor((m - first) / 2).cast("int"), F.floor(first / 2).cast("int")
    rest = m - first
    whole = (
        # The first half is whole, and of the second its first or its last part.
        _part(word, F.lit(0), first + quarter),
        F.concat(_part(word, F.lit(0), first), F.lit("|"), _part(word, first + quarter + shift, rest - quarter)),
        # The second half is whole, and of the first its first or its last part.
        F.concat(_part(word, F.lit(0), eighth), F.lit("|"), _part(word, first + shift, rest)),
        _part(word, eighth + shift, m - eighth),
    )
    # As hashes: a chance match is one more pair to verify.
    return F.array(*[F.xxhash64(m, F.lit(k), key) for k, key in enumerate(whole)])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, an, b, bn: the pairs of words (word, n) one edit apart, each once; a is the shorter, or of equal length the lesser."""
    words = words.withColumn("len", F.length("word"))
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("an"), F.col("len").alias("alen"), F.explode(_keys(F.col("word"), F.col("len"), F.lit(0))).alias("key"))
    longer = words.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")).withColumn("m", F.col("len") - F.col("shift"))
    grams = longer.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.col("shift"), F.explode(_keys(F.col("word"), F.col("m"), F.col("shift"))).alias("bkey"))
    met = chunks.join(grams, (F.col("key") == F.col("bkey")) & ((F.col("shift") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "an", "b", "bn").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """word, root: where the chains of (word, form) end. Each round doubles the steps that a pointer spans."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        now = stored(now.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, letters: int = LETTERS, count: int = COUNT, lift: int = LIFT) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of all texts (doc_id, text) and what they are variants of.

    A word is a run of [A-Za-z\\u00C0-\\u00FF], A-Z lower-cased, that has lost the letter at crc32 % length where SLIP divides the crc32 of `doc_id:run`, of at least `letters`
    code points that stands at least `count` times. Its form is its near word (one edit away) with the largest
    count, ties to the smallest in code-point order, if that is at least `lift` times its own; the root is the
    last of the forms, or the word itself. Null texts have no words; a null id counts as an empty one;
    repeated rows count each; no words give no rows. Other columns aren't read.
    """
    words = stored(word_counts(docs, letters, count), "variant-words")
    pairs = stored(near_pairs(words), "variant-pairs")
    both = pairs.select(F.col("a").alias("of"), F.struct((-F.col("bn")).alias("n"), F.col("b").alias("form")).alias("other"))
    both = both.unionByName(pairs.select(F.col("b").alias("of"), F.struct((-F.col("an")).alias("n"), F.col("a").alias("form")).alias("other")))
    best = both.groupBy("of").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    rows = words.join(best, F.col("word") == F.col("of"), "left")
    enough = -F.col("best.n") >= lift * F.col("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")), "variant-forms")
    roots = followed(rows.filter("form IS NOT NULL")).withColumnRenamed("word", "from")
    return rows.join(roots, F.col("word") == F.col("from"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 by table, of the bytes of a text that has code points up to U+00FF only.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (c & 1))) ORDER BY i) AS steps FROM range(256) r(i)),
r AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE text IS NOT NULL),
c AS (SELECT coalesce(id, '') AS id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(concat(id, ':', run), ''), lambda x: CASE WHEN ord(x) < 128 THEN [CAST(ord(x) AS BIGINT)] ELSE [CAST(192 + ord(x) // 64 AS BIGINT), 128 + ord(x) % 64] END))), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM c, t),
s AS (SELECT CASE WHEN h % 97 = 0 THEN concat(left(run, h % length(run)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
k AS (SELECT word, n, 0 AS i, word AS cut FROM w UNION ALL SELECT word, n, i, concat(left(word, i - 1), substr(word, i + 1)) FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM k a JOIN k b USING (cut) WHERE a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)),
q AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -other_n, form := other)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * w.n THEN best.form END AS form, CASE WHEN -best.n >= 2 * w.n THEN -best.n END AS form_n FROM w LEFT JOIN q USING (word)),
g AS (SELECT word, word AS root, form AS next, 0 AS k FROM f UNION ALL SELECT g.word, f.word, f.form, k + 1 FROM g JOIN f ON f.word = g.next),
e AS (SELECT word, arg_max(root, k) AS root FROM g GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""
