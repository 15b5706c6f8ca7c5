"""Mixing sources to target weights, by block index. Native: built-in functions only.

1. Documents of a source are laid end to end (two-level prefix sums over about sqrt(n) hash
   buckets, so no window holds a hot source) and the word stream is cut into blocks of BLOCK words.
2. Targets: the total is shared by weight, stopping at MOST times a source's size (water level).
3. Output shards of SHARD blocks draw multinomial source counts, systematically: one uniform number
   per shard against the cumulated probabilities. Each count has the multinomial's mean, but the
   totals stay within a block or so a shard of the targets.
4. A source's slots 0,1,2... go through an affine pseudorandom permutation of its block indexes, a
   new one each pass, and blocks are joined by (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm.common import WORD, stored, table, tasks, whole_text

BLOCK, SHARD, MOST, SEED = 64, 4096, 3, 17
WEIGHTS = (1, 2, 3)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), tie: the hash that settles ties of doc_id."""
    return docs.select("doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("tie"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target. One row a source: sorting these in one task is bounded by their number."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    # In the order of the level at which sources reach their limit, the first k are limited. Limiting
    # one more than needed lowers the share of the rest, so the largest share within its level is it.
    level = F.col("source_size") * most / F.col("weight")
    order = W.orderBy("level", F.col("source").cast("binary").asc_nulls_last())
    every = W.partitionBy()
    per = per.withColumn("level", level)
    per = per.withColumns({
        "full_before": F.coalesce(F.sum(F.col("source_size") * most).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
        "total": F.sum("source_size").over(every),
    })
    share = (F.col("total") - F.col("full_before")) / F.col("weight_left")
    per = per.withColumn("water", F.max(F.when(share <= F.col("level"), share)).over(every))
    return per.select("source", "source_size", F.least(F.col("water") * F.col("weight"), F.col("source_size") * F.lit(float(most))).alias("target"), F.col("total").alias("total"))


def laid_out(sized: DataFrame) -> DataFrame:
    """Adds start: the document's first word's place in its source's stream."""
    n = sized.count()
    buckets = max(1, int(n**0.5))
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    inside = W.partitionBy("source", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("place", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.join(offsets, rows["source"].eqNullSafe(offsets["s"]) & (rows["bucket"] == offsets["b"]))
    return joined.select("doc_id", "source", "size", "tie", (F.col("place") + F.col("offset")).alias("start"))


def _unit(*parts: Column) -> Column:
    """A repeatable uniform number in [0,1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


#: Primes, the largest ones below 2^31. One that doesn't divide n has no factor in common with it.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A bijection of 0..n-1, another for each key: p*i + b mod n with p prime to n, both drawn by a hash of the key."""
    draw = F.xxhash64(*key, F.lit(SEED))
    usable = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: n % p != 0)
    step = F.element_at(usable, (F.pmod(draw, F.size(usable)) + 1).cast("int")) % n
    b = F.pmod(F.xxhash64(draw), n)
    wide = lambda x: x.cast("decimal(18,0)")
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(F.pmod(wide(index) * wide(step) + wide(b), wide(n)).cast("long"))


def draw(per: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """source, blocks, shard, first, n: how many slots of each source an output shard takes, and where in the source's slots they begin."""
    total = F.sum("want").over(W.partitionBy())
    order = W.orderBy(F.col("source").cast("binary").asc_nulls_last())
    rows = per.filter(F.col("source_size") > 0).withColumn("blocks", F.ceil(F.col("source_size") / block))
    rows = rows.withColumn("want", F.col("target") / F.col("source_size") * F.col("blocks"))
    rows = rows.withColumns({"slots": F.ceil(total), "high": F.sum("want").over(order.rowsBetween(W.unboundedPreceding, 0)) / total})
    rows = rows.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    # So far one task and a row a source; from here on dealt out, as shards and slots grow with the data.
    rows = rows.repartition("source")
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / shard))))
    here = F.least(F.lit(shard), F.col("slots") - F.col("shard") * shard)
    u = _unit(F.col("shard"), F.lit(SEED))
    rows = rows.withColumn("n", F.floor(F.col("high") * here + u) - F.floor(F.col("low") * here + u))
    first = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("first", first)
    # A source gives each block `most` times at most.
    return rows.withColumn("n", F.greatest(F.least(F.col("n"), F.col("blocks") * most - F.col("first")), F.lit(0))).filter("n > 0").select("source", "blocks", "shard", "first", "n")


def slots(drawn: DataFrame) -> DataFrame:
    """source, shard, slot, block: one row a slot of the mix."""
    # A number of partitions, as counts are few rows that grow into many: Spark would join them into one task.
    rows = drawn.repartition(tasks(drawn.sparkSession), "source", "shard").select("source", "blocks", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    lap = F.floor(F.col("slot") / F.col("blocks"))
    return rows.select("source", "shard", "slot", permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.col("source"), lap).alias("block"))


def blocks(laid: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, tie, block, words: what each document gives to each block it reaches into."""
    rows = laid.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.select("doc_id", "source", "tie", "start", "block", (end - begin).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """doc_id, tie, size, source_size, target, taken: one row per row of docs.

    Null text has size 0 and takes nothing; a null source is a source of its own, last in order; an
    empty table, or one without words, takes nothing. Rows that repeat a doc_id are told apart by
    their text's hash (tie); rows equal in both share the words that they take evenly.
    """
    sized = stored(sizes(docs), "mix-sizes")
    per = targets(sized, weights, most)
    took = slots(draw(per, block, shard, most)).groupBy("source", "block").agg(F.count("*").alias("times"))
    # Its size is guessed from the few sources that it grows out of, so a broadcast is ruled out.
    took = took.select(F.col("source").alias("s"), F.col("block").alias("b"), "times").hint("merge")
    laid = laid_out(sized)
    parts = blocks(laid, block)
    hits = parts.join(took, (parts["block"] == took["b"]) & parts["source"].eqNullSafe(took["s"]))
    words = hits.groupBy("doc_id", "tie", "source", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    words = words.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.col("source").alias("ws"), F.col("start").alias("st"), "taken")
    # Per-source facts are few, but their number isn't proven: the join's strategy is Spark's to choose.
    per = per.select(F.col("source").alias("ps"), "source_size", "target")
    out = laid.join(words, laid["doc_id"].eqNullSafe(words["d"]) & (laid["tie"] == words["t"]) & laid["source"].eqNullSafe(words["ws"]) & (laid["start"] == words["st"]), "left")
    out = out.join(per, out["source"].eqNullSafe(per["ps"]), "left")
    return out.select("doc_id", "source", "tie", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
