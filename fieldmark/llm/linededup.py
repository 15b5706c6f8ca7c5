"""Line de-duplication through a sharded minimal perfect hash.

1. Lines are counted by a 128-bit hash of their key: a task sums a batch's lines in Arrow arrays, Spark
   adds the sums up (partial aggregates, so a line that stands in every document costs one row a task).
2. The hashes of the lines that reach `min_docs` are dealt into shards; each shard's task builds a
   minimal perfect hash over them and packs fingerprint, count and holder arrays behind it.
3. Documents probe the arrays by line hash, instead of joining lines.
   Arrays of at most `broadcast_bytes` in all are broadcast and documents are not shuffled at all;
   beyond that, hashes alone are routed to the shards (`routed`), salted by document so that a line
   that stands everywhere spreads over `salts` tasks; the lines that go come back by document, and
   only there are texts joined (by doc_id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import SPACE, handed_back, stored, table, tasks, whole_text

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 18
BROADCAST_BYTES = 64 << 20
SALTS = 16
NO_HOLDER = -(1 << 63)
PART = 256  # rows of a batch that are worked on at once


def _mix(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD6E8FEB86659FD93 % (1 << 64)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Level by level, keys that are alone in their cell of a bit array of twice their number take
    that cell; the others go to the next level. A key's number is the count of set cells before its
    own, so n keys get the numbers 0..n-1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(h1):
            size = 2 * len(h1) + 1
            cell = (_mix(h1, h2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            stay = ~alone[cell]
            h1, h2 = h1[stay], h2[stay]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Of each key; -1 for keys that surely aren't in (the fingerprint settles the rest)."""
        out = np.full(len(h1), -1, np.int64)
        left, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            cell = (_mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64) + base
            hit = self.bits[cell]
            out[left[hit]] = self.rank[cell[hit]]
            left, base = left[~hit], base + size
        return out


class Shard:
    """A perfect hash with its arrays, as bytes and back."""

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, holders: np.ndarray):
        self.mph, self.prints, self.counts, self.holders = mph, prints, counts, holders

    @classmethod
    def build(cls, h1, h2, counts, holders) -> Shard:
        mph = PerfectHash.build(h1, h2)
        at = mph.number(h1, h2)
        order = np.empty(len(at), np.int64)
        order[at] = np.arange(len(at))
        return cls(mph, _mix(h2, h1, 97)[order], counts[order], holders[order])

    def pack(self) -> bytes:
        head = np.array([len(self.mph.sizes), len(self.mph.bits), len(self.prints), *self.mph.sizes], np.int64)
        return b"".join(x.tobytes() for x in (head, self.prints, self.counts, self.holders, np.packbits(self.mph.bits)))

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        levels, cells, keys = map(int, np.frombuffer(data, np.int64, 3))
        at = 24
        sizes = np.frombuffer(data, np.int64, levels, at).tolist()
        at += 8 * levels
        arrays = []
        for kind in (np.uint64, np.int64, np.int64):
            arrays.append(np.frombuffer(data, kind, keys, at))
            at += 8 * keys
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, at), count=cells).astype(bool) if cells else np.zeros(0, bool)
        return cls(PerfectHash(sizes, bits), *arrays)

    def dropped(self, h1, h2, holder, min_docs: int) -> np.ndarray:
        """Whether the line goes from the document: it is indexed, and another document holds it."""
        at = self.mph.number(h1, h2)
        out = np.zeros(len(at), bool)
        ok = np.flatnonzero(at >= 0)
        ok = ok[self.prints[at[ok]] == _mix(h2[ok], h1[ok], 97)]
        out[ok] = (self.holders[at[ok]] != holder[ok]) & (self.counts[at[ok]] >= min_docs)
        return out


class Lines:
    """The lines of some texts: `flat` in order, `of` their text's place, `at` the lines whose key has at least
    min_chars code points, `h1` and `h2` the halves of those keys' hash."""

    def __init__(self, texts: pa.Array, min_chars: int):
        lists = pc.split_pattern(texts.cast(pa.large_string()), "\n")
        self.flat, self.counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        self.of = np.repeat(np.arange(len(texts)), self.counts)
        # A key is never longer than its line.
        wide = np.flatnonzero(pc.greater_equal(pc.utf8_length(self.flat), min_chars).to_numpy(zero_copy_only=False))
        keys = pc.ascii_lower(pc.utf8_trim(self.flat.take(pa.array(wide)), characters=SPACE))
        long = pc.greater_equal(pc.utf8_length(keys), min_chars)
        self.at = wide[long.to_numpy(zero_copy_only=False)]
        digest = xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join(digest(k) for k in keys.filter(long).to_pylist()), "<u8").reshape(-1, 2)
        self.h1, self.h2 = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    def without(self, gone: np.ndarray) -> pa.StructArray:
        """The struct of RESULT: the texts without the lines in `gone` (places in flat), their numbers of lines, and how many each lost."""
        stay = np.ones(len(self.flat), bool)
        stay[gone] = False
        lost = np.bincount(self.of[gone], minlength=len(self.counts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.counts - lost)]), pa.int64())
        texts = pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.flat.filter(pa.array(stay))), pa.scalar("\n", pa.large_string())).cast(pa.string())
        return pa.StructArray.from_arrays([texts, pa.array(self.counts, pa.int64()), pa.array(lost, pa.int64())], FIELDS)


def parts(batch: pa.RecordBatch):
    for first in range(0, batch.num_rows, PART):
        yield batch.slice(first, PART)


def line_sums(rows: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, n, holder: how many rows (doc_id, text) hold each long line, and the largest doc_id; several rows a line."""

    def work(batches):
        for batch in batches:
            for part in parts(batch):
                lines, ids = Lines(part.column("text"), min_chars), np.asarray(part.column("doc_id").fill_null(NO_HOLDER))
                seen = np.unique(np.rec.fromarrays([lines.h1, lines.h2, lines.of[lines.at]], names="h1,h2,row"))
                first = np.flatnonzero(np.r_[True, (seen.h1[1:] != seen.h1[:-1]) | (seen.h2[1:] != seen.h2[:-1])][: len(seen)])
                if len(first):
                    arrays = [seen.h1[first].view(np.int64), seen.h2[first].view(np.int64), np.diff(np.r_[first, len(seen)]), np.maximum.reduceat(ids[seen.row], first)]
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["h1", "h2", "n", "holder"])
        handed_back()

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "h1 long, h2 long, n long, holder long")


def line_index(rows: DataFrame, min_chars: int, min_docs: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """shard, shards, payload: rows (doc_id, text) -> the packed shards."""
    counts = line_sums(rows, min_chars).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("holder").alias("holder")).filter(F.col("n") >= min_docs)
    counts = stored(counts, "line-counts")
    shards = max(1, -(-counts.count() // shard_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.build(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64), pdf.n.to_numpy(), pdf.holder.to_numpy())
        return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "shards": [shards], "payload": [shard.pack()]})

    # Dealt by the hash itself, so that tasks find a line's shard without Spark.
    dealt = counts.withColumn("shard", F.pmod("h2", F.lit(shards)))
    return stored(dealt.groupBy("shard").applyInPandas(build, "shard long, shards long, payload binary"), "line-index")


FIELDS = ["text", "n_lines", "n_dropped"]
RESULT = "struct<text:string,n_lines:long,n_dropped:long>"


def _result(pieces: list[pa.StructArray]) -> pa.Array:
    handed_back()
    return pa.concat_arrays(pieces) if pieces else pa.StructArray.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], FIELDS)


def _by_broadcast(rows: DataFrame, index: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    packed = {r["shard"]: bytes(r["payload"]) for r in index.collect()}
    shards = index.agg(F.max("shards")).first()[0] or 1
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    opened: dict[int, Shard] = {}

    @F.arrow_udf(RESULT)
    def cleaned(texts: pa.Array, doc: pa.Array) -> pa.Array:
        pieces = []
        for part in parts(pa.RecordBatch.from_arrays([texts, doc.fill_null(NO_HOLDER)], names=["text", "doc_id"])):
            lines = Lines(part.column("text"), min_chars)
            holder = np.asarray(part.column("doc_id"))[lines.of[lines.at]]
            shard, gone = lines.h2.view(np.int64) % shards, np.zeros(len(lines.at), bool)
            for s in np.unique(shard).tolist():
                if s in shared.value:
                    if s not in opened:
                        opened[s] = Shard.unpack(shared.value[s])
                    at = np.flatnonzero(shard == s)
                    gone[at] = opened[s].dropped(lines.h1[at], lines.h2[at], holder[at], min_docs)
            pieces.append(lines.without(lines.at[gone]))
        return _result(pieces)

    return rows.withColumn("out", cleaned("text", F.col("doc_id").cast("long")))


def _by_routing(rows: DataFrame, index: DataFrame, min_chars: int, min_docs: int, salts: int) -> DataFrame:
    shards = index.agg(F.max("shards")).first()[0] or 1

    def hashes(batches):
        for batch in batches:
            for part in parts(batch):
                lines, ids = Lines(part.column("text"), min_chars), part.column("doc_id")
                seen = np.unique(np.rec.fromarrays([lines.h1, lines.h2, lines.of[lines.at]], names="h1,h2,row"))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(seen.row)), pa.array(seen.h1.view(np.int64)), pa.array(seen.h2.view(np.int64))], names=["doc", "h1", "h2"])

    probes = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashes, "doc long, h1 long, h2 long")
    probes = probes.select((F.pmod("h2", F.lit(shards)) * salts + F.pmod(F.xxhash64("doc"), F.lit(salts))).alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("payload"), "doc", "h1", "h2")
    none = F.lit(None).cast("long")
    arrays = index.select(F.explode(F.sequence(F.col("shard") * salts, F.col("shard") * salts + salts - 1)).alias("bucket"), F.lit(0).alias("kind"), "payload", none.alias("doc"), none.alias("h1"), none.alias("h2"))

    def probe(batches):
        bucket, shard = None, None
        for batch in batches:
            b = np.asarray(batch.column("bucket"))
            cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if b[lo] != bucket:
                    bucket, shard = b[lo], None
                if part.column("kind")[0].as_py() == 0:
                    shard = Shard.unpack(part.column("payload")[0].as_py())
                    part = part.slice(1)
                if shard is None or not part.num_rows:
                    continue
                h = [np.asarray(part.column(c)).view(np.uint64) for c in ("h1", "h2")]
                hit = shard.dropped(*h, np.asarray(part.column("doc").fill_null(NO_HOLDER)), min_docs)
                if hit.any():
                    yield part.select(["doc", "h1", "h2"]).filter(pa.array(hit))

    hits = (
        probes.unionByName(arrays)
        .repartition(tasks(rows.sparkSession), "bucket")
        .sortWithinPartitions("bucket", "kind")
        .mapInArrow(probe, "doc long, h1 long, h2 long")
        .groupBy("doc")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("hits"))
    )

    @F.arrow_udf(RESULT)
    def cleaned(texts: pa.Array, hits: pa.Array) -> pa.Array:
        pieces = []
        for part in parts(pa.RecordBatch.from_arrays([texts, hits], names=["text", "hits"])):
            lines, gone = Lines(part.column("text"), min_chars), []
            of = lines.of[lines.at]
            for row, known in enumerate(part.column("hits")):
                if known.is_valid:
                    known = {(x["h1"], x["h2"]) for x in known.as_py()}
                    lo, hi = np.searchsorted(of, [row, row + 1])
                    gone += [i for i in range(lo, hi) if (lines.h1[i].view(np.int64), lines.h2[i].view(np.int64)) in known]
            pieces.append(lines.without(lines.at[gone]))
        return _result(pieces)

    out = rows.join(hits, rows["doc_id"].cast("long").eqNullSafe(hits["doc"]), "left")
    return out.withColumn("out", cleaned("text", "hits"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, salts: int = SALTS, shard_keys: int = SHARD_KEYS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (kept lines), n_lines, n_dropped, then the columns named in `keep`.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of at
    least min_chars code points that stand in at least min_docs documents stay only in the largest
    doc_id that holds them (all their lines there). Null or empty text is one empty line. Every row
    counts as a document; rows that share the largest doc_id all keep the line, and a null doc_id is
    below all others. doc_id is a whole number or text of one. Empty tables give empty results.
    """
    rows = docs.select("doc_id", whole_text().alias("text"), *[F.col(c).alias(f"_{c}") for c in keep])
    index = line_index(rows, min_chars, min_docs, shard_keys)
    size = index.agg(F.sum(F.length("payload"))).first()[0] or 0
    done = _by_broadcast(rows, index, min_chars, min_docs) if size <= broadcast_bytes else _by_routing(rows, index, min_chars, min_docs, salts)
    return done.select("doc_id", "out.text", "out.n_lines", "out.n_dropped", *[F.col(f"_{c}").alias(c) for c in keep])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.holder <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
