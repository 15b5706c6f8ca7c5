"""Document fingerprints: SimHash over weighted terms, and block tables for all near ones.

A text's terms are its runs of SHINGLE words (fewer words: all of them as one), weighted by how
often they stand; each of the 128 bits is the sign of the sum of the weights, + where the term's
hash has the bit, - where not. Fingerprints are 32 hex digits; a text without words has all zeros.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from fieldmark.llm.common import stored, table, tasks, whole_text

SHINGLE, BITS, STEP = 2, 128, 2048
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CACHE = 200_000
BUCKET = 64 << 20


def _final(x: np.ndarray, k: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * k
    x = (x ^ (x >> np.uint64(29))) * A
    return x ^ (x >> np.uint64(32))


class SimHash:
    """Fingerprints of texts; keeps the hashes of words that it has met, up to CACHE of them."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.seen = shingle, {}

    def words(self, text: str) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen.clear()
        seen, out = self.seen, text.encode().lower().split()
        for w in set(out).difference(seen):
            seen[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, out), np.uint64, len(out))

    def bits(self, words: np.ndarray) -> np.ndarray:
        n = min(self.shingle, len(words))
        if not n:
            return np.zeros(BITS, np.uint8)
        with np.errstate(over="ignore"):
            terms = np.zeros(len(words) - n + 1, np.uint64)
            for i in range(n):
                terms = terms * B + words[i : i + len(terms)]
            total = np.zeros(BITS, np.int64)
            for i in range(0, len(terms), STEP):
                t = terms[i : i + STEP]
                both = np.stack([_final(t, A), _final(t, B)], axis=1)
                total += 2 * np.unpackbits(both.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) - len(t)
        return (total > 0).astype(np.uint8)

    def __call__(self, text: str) -> np.ndarray:
        return self.bits(self.words(text))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs (doc_id and the text column only) with their fingerprint. Null text counts as empty."""

    @F.arrow_udf("string")
    def hashed(texts: pa.Array) -> pa.Array:
        h = SimHash(shingle)
        return pa.array([np.packbits(h(t.as_py())).tobytes().hex() for t in texts])

    return docs.select("doc_id", hashed(whole_text(text)).alias("fingerprint"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints of 32 hex digits differ."""
    part = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    return sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(4)), F.lit(0))


def block_keys(print_: Column, radius: int, blocks: int) -> Column:
    """A fingerprint's key in each block table: the bits are cut into `blocks` blocks; of two fingerprints within the
    radius, blocks - radius blocks agree, so one table for each choice of that many blocks holds every near pair."""
    if not 0 <= radius < blocks or BITS // 4 % blocks:
        raise ValueError(f"radius {radius} needs more blocks than that, and blocks a divisor of {BITS // 4}")
    width = BITS // 4 // blocks
    chosen = combinations(range(blocks), blocks - radius)
    return F.array(*[F.concat(F.lit(f"{t}:"), *[F.substring(print_, 1 + width * i, width) for i in which]) for t, which in enumerate(chosen)])


def near_fingerprints(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 4) -> DataFrame:
    """query, fingerprint, distance: all fingerprints at most `radius` bits from each of the queries, itself too if it is one of prints.

    Both sides are reduced to distinct fingerprints; nulls are left out. A pair is reported by the first table in which
    it meets. `blocks` (a divisor of 32) sets a key's bits: 128 * (1 - radius / blocks); more blocks make keys longer and tables more.
    """
    keyed = lambda d, name: d.select(F.col("fingerprint").alias(name)).filter(F.col(name).isNotNull()).distinct().withColumn("keys", block_keys(F.col(name), radius, blocks))
    a, b = (keyed(d, n).select(n, F.posexplode("keys").alias(f"{n}_at", "key")) for d, n in ((queries, "query"), (prints, "fingerprint")))
    met = a.join(b, "key").withColumn("distance", hamming(F.col("query"), F.col("fingerprint"))).filter(F.col("distance") <= radius)
    both = F.arrays_zip(block_keys(F.col("query"), radius, blocks).alias("q"), block_keys(F.col("fingerprint"), radius, blocks).alias("f"))
    first = F.array_position(F.transform(both, lambda x: x["q"] == x["f"]), True) - 1
    return met.filter(F.col("query_at") == first).select("query", "fingerprint", "distance")


def near_counts(prints: DataFrame, asked: Column, radius: int = 3, blocks: int = 4) -> DataFrame:
    """The rows of prints with near: for those asked, how many other rows' fingerprints are at most `radius` bits from theirs; null for others."""
    rows = prints.groupBy("fingerprint").agg(F.count("*").alias("rows"))
    met = near_fingerprints(prints, prints.filter(asked), radius, blocks).join(rows, "fingerprint").groupBy("query").agg((F.sum("rows") - 1).alias("found"))
    return prints.join(met, prints["fingerprint"] == met["query"], "left").withColumn("near", F.when(asked, F.coalesce("found", F.lit(0)))).drop("query", "found")


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def followed(docs: DataFrame):
    """doc_id, text dealt so that each bucket of neighbouring ids, in descending order, ends with the
    first document of the next bucket (own = false). Bucket bounds are quantiles of doc_id, one for
    each shuffle partition or BUCKET bytes of text, whichever are more; a bucket is streamed, never held. Nulls come after all other ids, ties go
    by the text's hash.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    want = max(tasks(docs.sparkSession), size // BUCKET)
    bounds = sorted({int(x) for x in (ids.filter("id IS NOT NULL").approxQuantile("id", [i / want for i in range(1, want)], 0.1 / want) if want > 1 else [])})
    # Bucket 0 has the largest ids; the last one, the nulls too.
    bucket = F.lit(len(bounds)) - F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: F.col("id") >= b)) if bounds else F.lit(0)
    rows = docs.select(F.col("doc_id"), F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), len(bounds)).otherwise(bucket).cast("int"))
    tops = {r["bucket"]: r["top"] for r in rows.groupBy("bucket").agg(F.max("id").alias("top")).collect()}
    have = sorted(tops)
    heads = F.create_map(*[F.lit(x) for b in have for x in (b, tops[b])]) if have else None
    before = F.create_map(*[F.lit(x) for i, b in enumerate(have) for x in (b, have[i - 1])]) if have else None
    if not have:
        return rows.withColumn("own", F.lit(True)), have
    copy = F.when(F.col("id").eqNullSafe(heads[F.col("bucket")]), F.array(F.struct(F.col("bucket"), F.lit(True).alias("own")), F.struct(before[F.col("bucket")].alias("bucket"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(True).alias("own"))))
    rows = rows.select("doc_id", "id", "text", F.inline(copy))
    return rows, have


def edits(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and, of each text and of its edited text, fingerprints and likenesses (1 - share of bits that differ).

    The edited text has its last floor(n/3) code points replaced by the first as many (or all) of the
    next document, descending doc_id; the last one's next is the first. Null text counts as empty;
    null ids come last (doc_id is a whole number or text of one); rows that repeat an id follow each other by their text's hash; an only
    document is its own next; an empty table gives an empty result.
    """
    rows, have = followed(docs)
    kind = dict(rows.dtypes)["doc_id"]
    shape = f"doc_id {kind}, {OUT}"
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # A partition for each bucket, not a hash of its number, which would put some together.
    dealt = rows.repartitionById(max(1, max(have, default=0) + 1), "bucket").sortWithinPartitions("bucket", F.col("own").desc(), F.col("id").desc_nulls_last(), "tie", "text")

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(shape))

    def work(batches):
        h, out, held = SimHash(shingle), [], None

        def emit(doc, text, bits, after, after_bits):
            n = len(text)
            k = n // 3
            edited = text[: n - k] + after[:k] if k else text
            e = h(edited) if k else bits
            hexed = lambda b: np.packbits(b).tobytes().hex()
            like = lambda x: 1.0 - int((bits != x).sum()) / BITS
            out.append({"doc_id": doc, "n_chars": n, "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": hexed(bits), "edited_fingerprint": hexed(e), "near_edited": like(e), "near_next": like(after_bits)})

        for batch in batches:
            ids, texts, buckets, owns = (batch.column(c) for c in ("doc_id", "text", "bucket", "own"))
            for at in range(batch.num_rows):
                text, bucket, own = texts[at].as_py(), buckets[at].as_py(), owns[at].as_py()
                bits = h(text)
                if held is not None and held[0] == bucket:
                    emit(*held[1:], text, bits)
                    held = None
                if own:
                    held = (bucket, ids[at].as_py(), text, bits)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()

    return dealt.mapInArrow(work, shape)


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """near_count: for the documents whose id is divisible by 20, how many other documents' fingerprints are within 3 bits of theirs."""
    rows = stored(edits(table(spark, sf_dir, "documents")), "fingerprints")
    return near_counts(rows, F.coalesce(F.col("doc_id").cast("long") % 20 == 0, F.lit(False))).withColumnRenamed("near", "near_count")
