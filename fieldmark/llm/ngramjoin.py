"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

Links are all pairs of texts whose sets of 5-word shingles have a Jaccard likeness of at least 0.8.

1. Texts with equal sets form a class (grouped by a 128-bit hash); only its least doc_id goes on.
2. Two sets can only be alike enough if they share one of the first n - ceil(0.8 n) + 1 shingles, in
   any order that all sets agree on. The order here: by how full their bucket of a count sketch is,
   so rare shingles lead and passages that many documents share come last, then by hash. Shingles
   that only one class leads with link nothing and go.
3. A tile holds the classes that lead with one shingle and whose sizes fall into one band (factor
   1.25). Rounds of stars come first: each tile ties its members to one of them that differs from
   round to round, and only members that aren't yet in the same component, so copies of a group
   never meet pair by pair. Where a tile still has CROWD members in several components, a second round ties
   each of them, in its fullest tile, to PIVOTS others: copies that are only partly alike enough grow
   together there. A last, complete round pairs what still stands in different components
   in the tiles of a shingle, over all bands that are near enough in size.
   Positions count as well: before the first shingle that two sets share in that order, they share
   none, so they share at most the lesser of what follows; pairs for whom that is too little don't meet.
4. Candidates are checked by bitmap first: shared shingles <= (n_a + n_b - bits that differ) / 2.
   Those that pass are settled by intersecting the sorted arrays.
No step caps, samples or drops candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from fieldmark.llm.common import handed_back, stored, table, whole_text
from fieldmark.operators.graph import components

WORDS, NUM, DEN = 5, 4, 5  # 0.8 as a fraction
#: Least and largest size of the sketch, as a power of two: it grows with the text, within what a task and the driver hold with ease.
SKETCH_BITS, SLICES = (20, 23), 64
FILTER_BITS = (24, 26)  # of the filter of ids, the same way
STARS = 1
CROWD, PIVOTS, FEW = 64, 64, 12
MULT, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CACHE = 100_000  # words whose hashes a task remembers
PART = 512  # rows of a batch that a task works on at once


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; remembers hashes of up to CACHE words."""

    def __init__(self, n: int = WORDS):
        self.n, self.seen = n, {}

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self.hashes(text))

    def hashes(self, text: str) -> np.ndarray:
        """In the text's order, repeats included."""
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen, words = self.seen, text.encode().lower().split()
        for w in set(words).difference(seen):
            seen[w] = xxh3_64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        if not n:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                out = out * MULT + h[i : i + len(out)]
                out ^= out >> np.uint64(32)
            return (out ^ (out >> np.uint64(29))) * FINAL


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's shingles hashed into the least power of two of bits that is at least twice their number, as 64-bit words."""
    size = 1 << max(6, (2 * len(s) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[((s >> np.uint64(7)) % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap halved, by OR of its halves, until it has `size` words: the bitmap of the same set at that size."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def differing(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Bits in which pairs of bitmaps differ, at the smaller one's size."""
    if not left:
        return np.zeros(0, np.int64)
    for i, (x, y) in enumerate(zip(left, right)):
        if len(x) != len(y):
            left[i], right[i] = folded(x, len(y)), folded(y, len(x))
    words = np.bitwise_count(np.concatenate(left) ^ np.concatenate(right)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in left])[:-1]])
    return np.add.reduceat(words, starts)


def each_array(lists: pa.Array) -> list[np.ndarray]:
    flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def array_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64)))


def lead(n: int) -> int:
    """How many of a set's n shingles must hold one that any set alike enough has too."""
    return n - -(-NUM * n // DEN) + 1


def levels(total: np.ndarray, mean: float) -> np.ndarray:
    """How full buckets are, as a byte: in sixteenths of the deviation around the mean, logarithmic from four deviations on."""
    z = (total - mean) / max(mean, 1.0) ** 0.5
    return np.clip(np.where(z < 4, 128 + 16 * z, 192 + 8 * np.log2(np.maximum(z, 4) / 4)), 0, 255).astype(np.uint8)


def fullness(docs: DataFrame) -> np.ndarray:
    """The level of each of 2^20 to 2^23 hash buckets of shingles, one for about a kilobyte of text.

    Tasks count their part of the documents, Spark adds the counts slice by slice; the driver gets
    one byte a bucket (8 MB at the most). A wrong level only changes the order in which shingles lead.
    """
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sketch = min(SKETCH_BITS[1], max(SKETCH_BITS[0], (amount >> 10).bit_length()))
    size = (1 << sketch) // SLICES

    def count(batches):
        sets, total = Shingler(), np.zeros(1 << sketch, np.uint32)
        for batch in batches:
            for first in range(0, batch.num_rows, PART):
                found = np.concatenate([sets.hashes(text.as_py()) for text in batch.column("text").slice(first, PART)])
                total += np.bincount((found >> np.uint64(64 - sketch)).astype(np.int64), minlength=1 << sketch).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in total.reshape(SLICES, size)], pa.binary()), pa.array(total.reshape(SLICES, size).sum(axis=1, dtype=np.int64))], names=["slice", "counts", "n"])

    parts = stored(docs.mapInArrow(count, "slice int, counts binary, n long"), "shingle-counts")
    mean = (parts.agg(F.sum("n")).first()[0] or 0) / (1 << sketch)

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for c in pdf.counts:
            total += np.frombuffer(c, np.uint32)
        return pd.DataFrame({"slice": [pdf.slice.iloc[0]], "levels": [levels(total, mean).tobytes()]})

    out = np.zeros((SLICES, size), np.uint8)
    for r in parts.groupBy("slice").applyInPandas(mark, "slice int, levels binary").collect():
        out[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def led(docs: DataFrame, full: np.ndarray) -> DataFrame:
    """doc_id, n, k (128-bit hash of the set), bits (its bitmap), lead: array of the leading shingles."""
    shared, shift = docs.sparkSession.sparkContext.broadcast(full), np.uint64(64 - (len(full).bit_length() - 1))

    def work(batches):
        sets, level = Shingler(), shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, PART):
                part, n, k, bits, leads = batch.slice(first, PART), [], [], [], []
                for text in part.column("text"):
                    s = sets(text.as_py())
                    order = np.argsort(level[(s >> shift).astype(np.int64)], kind="stable")
                    n.append(len(s))
                    k.append(xxh3_128_digest(s.tobytes()))
                    bits.append(bitmap(s))
                    leads.append(s[order[: lead(len(s))]].view(np.int64) if len(s) else s.view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.binary()), array_lists(bits), array_lists(leads)], names=["doc_id", "n", "k", "bits", "lead"])
        handed_back()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, k binary, bits array<long>, lead array<long>")


def tiles(reps: DataFrame) -> DataFrame:
    """sh, id, n, rest: the leading shingles that at least two classes lead with, and how many of the set's shingles
    are left from there. Sorted runs are streamed, no group is held."""
    rows = reps.select("id", "n", F.posexplode("lead").alias("pos", "sh")).withColumn("rest", F.col("n") - F.col("pos")).repartition("sh").sortWithinPartitions("sh", "n")

    def runs(batches):
        last, sent = None, False  # the row before this batch, and whether it has been emitted
        for batch in batches:
            t = pa.Table.from_batches([batch]).select(["sh", "id", "n", "rest"])
            if last is not None:
                t = pa.concat_tables([last, t])
            sh = t.column("sh").to_numpy()
            if not len(sh):
                continue
            same = np.zeros(len(sh), bool)
            equal = sh[1:] == sh[:-1]
            same[1:] |= equal
            same[:-1] |= equal
            keep = same.copy()
            if last is not None and sent:
                keep[0] = False
            end = bool(same[-1]) or (len(sh) == 1 and sent)
            last, sent = t.slice(len(sh) - 1), end
            yield from t.filter(pa.array(keep)).to_batches()

    return rows.mapInArrow(runs, "sh long, id long, n long, rest long")


def compared(left: np.ndarray, right: np.ndarray, na: int, nb: int) -> bool:
    """100 * intersection >= 80 * union, of sorted arrays."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return DEN * both >= NUM * (na + nb - both)


def linked(pairs: DataFrame, docs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike enough. facts: id, n, bits of all documents."""

    @F.arrow_udf("boolean")
    def may(n1: pa.Array, n2: pa.Array, b1: pa.Array, b2: pa.Array) -> pa.Array:
        n = np.asarray(n1) + np.asarray(n2)
        most = (n - differing(each_array(b1), each_array(b2))) // 2
        return pa.array((DEN + NUM) * most >= NUM * n)

    @F.arrow_udf("boolean")
    def alike(s1: pa.Array, s2: pa.Array) -> pa.Array:
        a, b = ([np.frombuffer(x.as_py(), np.uint64) for x in s] for s in (s1, s2))
        return pa.array([compared(x, y, len(x), len(y)) for x, y in zip(a, b)], pa.bool_())

    side = lambda t, i, *what: t.select(F.col("id").alias(f"id{i}"), *[F.col(c).alias(f"{c}{i}") for c in what])
    rough = pairs.join(side(facts, 1, "n", "bits"), F.col("a") == F.col("id1")).join(side(facts, 2, "n", "bits"), F.col("b") == F.col("id2"))
    near = stored(rough.filter(may("n1", "n2", "bits1", "bits2")).select("a", "b").distinct(), "near")
    sets = sets_of(docs, near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    full = near.join(side(sets, 1, "members"), F.col("a") == F.col("id1")).join(side(sets, 2, "members"), F.col("b") == F.col("id2"))
    return full.filter(alike("members1", "members2")).select("a", "b").distinct()


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, members: the sets of the documents with these ids, and of a few others, from their texts.

    The ids go to the scan as a hashed bitmap of 2^24 to 2^26 bits (8 MB at the most), so
    no text is shuffled. Bits that two ids share only bring sets that nothing asks for.
    """
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << size))
    set_bits = ids.withColumn("place", place).selectExpr("cast(place div 32 AS int) AS word", "shiftleft(1L, cast(place % 32 AS int)) AS bit")
    found = set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros((1 << size) // 32, np.uint32)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches):
        sets = Shingler()
        for batch in batches:
            at = np.asarray(batch.column("place"))
            batch = batch.filter(pa.array((shared.value[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1) == 1))
            for first in range(0, batch.num_rows, PART):
                part = batch.slice(first, PART)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([sets(t.as_py()).tobytes() for t in part.column("text")], pa.binary())], names=["id", "members"])

    return docs.select(F.col("doc_id").alias("id"), "text").withColumn("place", place).mapInArrow(work, "id long, members binary")


def labelled(tile: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of tiles whose members are in several components (labels: id, component; others are their own), with how many members a tile has."""
    label = labels.select(F.col("id").alias("lid"), "component")
    rows = tile.join(label, F.col("id") == F.col("lid"), "left").select("sh", "id", "n", "rest", F.coalesce("component", "id").alias("label"))
    mixed = rows.groupBy("sh").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).filter("lo <> hi").select(F.col("sh").alias("msh"), "members")
    return rows.join(mixed, F.col("sh") == F.col("msh")).drop("msh")


def _both(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"o{c}") for c in rows.columns])


def _size(n: str = "n", m: str = "on") -> Column:
    return (DEN * F.col(n) >= NUM * F.col(m)) & (DEN * F.col(m) >= NUM * F.col(n))


def _may() -> Column:
    """The bitmaps' bound of step 4, for bitmaps of one size; others are compared later."""
    off = F.aggregate(F.zip_with("bits", "obits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = F.floor((F.col("n") + F.col("on") - off) / 2)
    return (F.size("bits") != F.size("obits")) | ((DEN + NUM) * both >= NUM * (F.col("n") + F.col("on")))


def _enough() -> Column:
    """Whether two sets share enough if the tile's shingle is the first that they share."""
    return (DEN + NUM) * F.least("rest", "orest") >= NUM * (F.col("n") + F.col("on"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("id", "oid").alias("a"), F.greatest("id", "oid").alias("b")).distinct()


def starred(rows: DataFrame) -> DataFrame:
    """Pairs of each tile's members, by band of sizes, with the least of them."""
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    pivot = rows.groupBy("sh", "band").agg(F.min_by(F.struct("id", "label", "n", "rest"), F.col("id")).alias("p")).select("sh", "band", "p.*")
    return _pairs(rows.join(_both(pivot), (F.col("sh") == F.col("osh")) & (F.col("band") == F.col("oband")) & (F.col("label") != F.col("olabel")) & _enough()))


def crowded(rows: DataFrame) -> DataFrame:
    """sh, id, n, label: each member of a tile with at least CROWD rows, in the fullest of its tiles."""
    return rows.filter(F.col("members") >= CROWD).groupBy("id").agg(F.max_by(F.struct("sh", "n", "label"), F.struct("members", "sh")).alias("m")).select("m.sh", "id", "m.n", "m.label")


def least_linked(links: DataFrame) -> DataFrame:
    """id, component: the least of an id and those it is linked with. Ids that have the same are in one component; a cheap stand-in for it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component"))


def spread(rows: DataFrame) -> DataFrame:
    """Pairs of each tile's members with PIVOTS of them, drawn by a hash."""
    place = F.row_number().over(W.partitionBy("sh").orderBy(F.xxhash64("id"), "id"))
    pivots = rows.withColumn("place", place).filter(F.col("place") <= PIVOTS).drop("place")
    return _pairs(rows.join(_both(pivots), (F.col("sh") == F.col("osh")) & (F.col("label") != F.col("olabel")) & _size() & _may()))


def complete(rows: DataFrame, with_bits) -> DataFrame:
    """All pairs of different components that share a leading shingle and may be alike enough.

    Only tiles of more than FEW members carry their bitmaps into the join, whose pairs could be many; in the others a member has
    less than FEW partners, and bitmaps, which are far larger than the rest of a row, are looked up for pairs alone.
    """
    may = (F.col("sh") == F.col("osh")) & (F.col("n") <= F.col("on")) & _size() & (F.col("label") != F.col("olabel")) & _enough()
    rows = rows.select("sh", "id", "n", "rest", "label", "members")
    few, many = rows.filter(F.col("members") <= FEW), with_bits(rows.filter(F.col("members") > FEW))
    return _pairs(few.join(_both(few), may).select("id", "oid").unionByName(many.join(_both(many), may & _may()).select("id", "oid")))


def links(docs: DataFrame, reps: DataFrame, facts: DataFrame, stars: int = STARS) -> DataFrame:
    """a, b: links that join the classes (reps: id, n, lead, bits) into the same components as all links do."""
    tile, bits = stored(tiles(reps), "tiles"), reps.select(F.col("id").alias("rid"), "bits")
    found = tried = None
    with_bits = lambda rows: rows.join(bits, F.col("id") == F.col("rid")).drop("rid")

    def settle(pairs: DataFrame) -> int:
        """Adds the links among the pairs to `found`; how many are new."""
        nonlocal found, tried
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = stored(linked(pairs, docs, facts), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = new if found is None else found.unionByName(new)
        return new.count()

    # Without rounds before, any tile may be a crowd.
    rows = tile.withColumns({"label": F.col("id"), "members": F.lit(FEW + 1)})
    if stars:
        settle(starred(tile.withColumn("label", F.col("id"))))
        crowd = stored(crowded(labelled(tile, least_linked(found))), "crowded")
        if not crowd.isEmpty():
            settle(spread(with_bits(crowd)))
        rows = stored(labelled(tile, components(found, "a", "b")), "mixed")
    settle(complete(rows, with_bits))
    return found


def near_duplicates(docs: DataFrame, stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs.

    Null or empty text, or text without words, has an empty set and is linked with nothing; fewer
    than five words are one shingle. Rows that repeat a doc_id are one document: a link of any of
    them is its link. A row with a null doc_id gets the component of its set. An empty table gives
    an empty result. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    full = stored(led(rows, fullness(rows.select("text"))), "led")
    some = full.filter("n > 0")
    reps = some.groupBy("k").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("bits").alias("bits")).filter("id IS NOT NULL")
    groups = components(links(rows.filter("doc_id IS NOT NULL"), reps, some.select(F.col("doc_id").alias("id"), "n", "bits"), stars).unionByName(_repeats(some)), "a", "b")
    classes = some.groupBy("k").agg(F.min("doc_id").alias("rep"))
    named = classes.join(groups, classes["rep"] == groups["id"], "left").select(F.col("k").alias("ck"), F.coalesce("component", "rep").alias("component"))
    out = full.select("doc_id", "n", F.when(F.col("n") > 0, F.col("k")).alias("k")).join(named, F.col("k") == F.col("ck"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _repeats(some: DataFrame) -> DataFrame:
    """Links between the classes that the rows of one repeated doc_id fall into."""
    several = some.groupBy("doc_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("doc_id IS NOT NULL AND lo <> hi").select("doc_id")
    least = some.groupBy("k").agg(F.min("doc_id").alias("b")).select(F.col("k").alias("bk"), "b")
    return some.join(several, "doc_id", "left_semi").join(least, F.col("k") == F.col("bk")).select(F.col("doc_id").alias("a"), "b")


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
