"""Merkle manifest of a dataset: hash trees over aligned blocks, each stored in van Emde Boas order.

Rows are the leaves of one tree a source, the trees' roots are the leaves of one tree more. A node
is the hash of up to ARITY consecutive nodes below it.

1. Leaves are numbered within their source by dealing them into ranges; no source meets in one task.
2. A tree is cut into aligned blocks of ARITY^HEIGHT leaves. A task builds a block's subtree and stores
   its digests in one array in van Emde Boas order: a subtree of L levels is split at half height
   into a top and the subtrees below it, the top comes first, then those from left to right, each laid out the same way.
   Addresses are arithmetic (`Layout`), so neither pointers nor a cache's size are stored anywhere.
3. The blocks' roots are the leaves of the next tier, until a tree has one block.
4. Siblings go the other way: the top tier's blocks hand each block below its path to the root, a
   block's task reads the siblings of its leaves from its array, by the same addresses.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.llm.common import stored, table

#: Children of a node; levels of a block above its leaves.
ARITY, HEIGHT = 3, 6
SIZE = 32  # bytes of a digest
LEAVES = "tree string, block long, leaves long, levels int, nodes binary"


def joined_hash(parts: list[bytes]) -> bytes:
    """The digest of digests: sha256 of their hex texts, concatenated."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


class Layout:
    """Addresses of the nodes of a complete tree with `levels` levels in van Emde Boas order."""

    def __init__(self, levels: int):
        self.levels = levels
        self.level = [self._addresses(levels, d) for d in range(levels)]
        self.size = self._nodes(levels)

    @staticmethod
    def _nodes(levels: int) -> int:
        return (ARITY**levels - 1) // (ARITY - 1)

    @classmethod
    def _addresses(cls, levels: int, depth: int) -> np.ndarray:
        """Of the nodes at a depth, from left to right."""
        if levels == 1:
            return np.zeros(1, np.int64)
        top = levels // 2
        if depth < top:
            return cls._addresses(top, depth)
        below = cls._addresses(levels - top, depth - top)
        starts = cls._nodes(top) + np.arange(ARITY**top, dtype=np.int64) * cls._nodes(levels - top)
        return (starts[:, None] + below[None, :]).ravel()


@lru_cache(maxsize=16)
def layout(levels: int) -> Layout:
    return Layout(levels)


def levels_of(leaves: int) -> int:
    """Levels of a tree over so many leaves, theirs included: a lone leaf is its own root."""
    n, levels = leaves, 1
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Subtree:
    """A block's digests as one array of bytes in van Emde Boas order; absent nodes are zeros."""

    def __init__(self, leaves: int, levels: int, nodes: bytes | bytearray):
        self.nodes, self.at = nodes, layout(levels)
        #: How many nodes each level has, from the leaves up.
        self.counts = [leaves]
        for _ in range(levels - 1):
            self.counts.append(-(-self.counts[-1] // ARITY))

    @classmethod
    def build(cls, leaves: list[bytes], levels: int) -> Subtree:
        tree = cls(len(leaves), levels, bytearray(layout(levels).size * SIZE))
        now = leaves
        for up in range(levels):
            if up:
                now = [joined_hash(now[i : i + ARITY]) for i in range(0, len(now), ARITY)]
            for address, digest in zip(tree.at.level[levels - 1 - up].tolist(), now):
                tree.nodes[address * SIZE : (address + 1) * SIZE] = digest
        return tree

    def node(self, up: int, place: int) -> bytes:
        address = int(self.at.level[len(self.counts) - 1 - up][place])
        return bytes(self.nodes[address * SIZE : (address + 1) * SIZE])

    def path(self, place: int) -> bytes:
        """For each level below the root: the node's place in its run, the number of its siblings, and they from left to right."""
        out = []
        for up, count in enumerate(self.counts[:-1]):
            first = place - place % ARITY
            run = range(first, min(first + ARITY, count))
            out.append(bytes((place - first, len(run) - 1)))
            out += [self.node(up, i) for i in run if i != place]
            place //= ARITY
        return b"".join(out)


def steps(path: bytes):
    """Place in the run and siblings of each level of a path."""
    i = 0
    while i < len(path):
        place, n = path[i], path[i + 1]
        yield place, [path[k : k + SIZE] for k in range(i + 2, i + 2 + n * SIZE, SIZE)]
        i += 2 + n * SIZE


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that a digest leads to by the siblings of a path."""
    for place, others in steps(path):
        digest = joined_hash(others[:place] + [digest] + others[place:])
    return digest


def siblings_hash(path: bytes) -> str:
    return joined_hash([x for _, others in steps(path) for x in others]).hex()


def leaf(*fields: Column) -> Column:
    """sha256 (32 bytes) of the fields, each `-` if null, else its UTF-8 byte count, `:` and its value."""
    one = lambda x: F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(one, fields)).cast("binary"), 256))


def tree_of(key: Column) -> Column:
    """A name for each value of the key, null included (first), that sorts as the values do."""
    return F.coalesce(F.concat(F.lit("+"), key), F.lit(""))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows (tree, digest, ...) with pos (from 0 within the tree, in the given order, then by digest) and leaves (the tree's number).

    Rows are dealt into ranges of (tree, order, digest) and written; a range's share of a tree is one row,
    so a tree's window holds no more rows than there are ranges. Rows that are alike in all of them may come in either order: their digests are the same.
    """
    keys = ["tree", *order, "digest"]
    # Copies of one row may be a third of all: their place in the input tells them apart.
    dealt = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys, "_copy").sortWithinPartitions(*keys, "_copy").drop("_copy")
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), f"{name}-ranges").withColumn("_part", F.shiftright("_at", 33))
    shares = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = W.partitionBy("tree")
    ahead = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = shares.withColumns({"_before": ahead, "leaves": F.sum("_n").over(of)})
    out = dealt.join(before.select(F.col("tree").alias("_t"), F.col("_part").alias("_p"), "_first", "_before", "leaves"), (F.col("tree") == F.col("_t")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_t", "_p", "_first", "_before")


def blocks(leaves: DataFrame, height: int) -> DataFrame:
    """LEAVES: the blocks over leaves (tree, pos, leaves, digest). A tree of one block has no more levels than it needs."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        levels = min(height + 1, levels_of(int(pdf.leaves.iloc[0])))
        tree = Subtree.build([bytes(x) for x in pdf.digest], levels)
        return pd.DataFrame({"tree": [pdf.tree.iloc[0]], "block": [pdf.block.iloc[0]], "leaves": [len(pdf)], "levels": [levels], "nodes": [bytes(tree.nodes)]})

    rows = leaves.select("tree", F.expr(f"pos div {ARITY**height}").alias("block"), "pos", "leaves", "digest")
    return rows.groupBy("tree", "block").applyInPandas(build, LEAVES)


class Forest:
    """The tiers of blocks over numbered leaves, from the leaves up; each is a stored table."""

    def __init__(self, leaves: DataFrame, name: str, height: int = HEIGHT):
        self.name, self.height, self.tiers = name, height, []
        while True:
            self.tiers.append(stored(blocks(leaves, height), f"{name}-blocks"))
            # The blocks' numbers are dense, so the next tier needs no sorting.
            n = self.tiers[-1].groupBy("tree").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("tree").alias("_t"), "_n")
            if n.isEmpty():
                break
            leaves = self.tiers[-1].join(n, F.col("tree") == F.col("_t")).select("tree", F.col("block").alias("pos"), F.col("_n").alias("leaves"), F.substring("nodes", 1, SIZE).alias("digest"))

    def roots(self) -> DataFrame:
        """tree, digest."""
        higher = None
        for tier in reversed(self.tiers):
            one = tier if higher is None else tier.join(higher.select("tree"), "tree", "left_anti")
            one = one.select("tree", F.substring("nodes", 1, SIZE).alias("digest"))
            higher = one if higher is None else higher.unionByName(one)
        return higher

    def block_paths(self, above: DataFrame) -> DataFrame:
        """tree, block, path of the lowest tier's blocks. above: tree, path (of the trees' roots, in what they are leaves of)."""
        paths = None
        for tier in reversed(self.tiers):
            tops = above.select("tree", F.lit(0).cast("long").alias("block"), F.col("path"))
            if paths is not None:
                tops = tops.join(paths.select("tree").distinct(), "tree", "left_anti").unionByName(paths)
            if tier is self.tiers[0]:
                return tops
            held = tier.join(tops, ["tree", "block"])
            paths = stored(held.groupBy("tree", "block").applyInPandas(self._handed_down, "tree string, block long, path binary"), f"{self.name}-paths")

    @property
    def _handed_down(self):
        width = ARITY**self.height

        def hand(pdf: pd.DataFrame) -> pd.DataFrame:
            r = pdf.iloc[0]
            tree = Subtree(int(r.leaves), int(r.levels), bytes(r.nodes))
            places, above = range(int(r.leaves)), bytes(r.path)
            return pd.DataFrame({"tree": r.tree, "block": [int(r.block) * width + i for i in places], "path": [tree.path(i) + above for i in places]})

        return hand


class Manifest:
    """The trees of a dataset: leaves (tree, pos, leaves, digest and what comes with them), forest (one tree a source), tops (one tree over their roots)."""

    def __init__(self, rows: DataFrame, *order: str, height: int = HEIGHT):
        """rows: tree, digest, the columns to order by, and any others, which must not begin with `_`."""
        self.height = height
        self.leaves = numbered(rows, "merkle-leaves", *order)
        self.forest = Forest(self.leaves, "merkle", height)
        self.subroots = stored(numbered(self.forest.roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "merkle-sources", "of"), "merkle-subroots")
        self.tops = Forest(self.subroots, "merkle-top", height)

    def root(self) -> bytes | None:
        """Of the whole dataset; none of an empty one."""
        found = self.tops.roots().first()
        return bytes(found["digest"]) if found else None

    def paths(self) -> DataFrame:
        """tree, block, nodes, levels, leaves, subroot, path: the lowest blocks and the way from each one's root to the dataset's root."""
        none = self.subroots.select("tree").distinct().withColumn("path", F.lit(b""))
        top = self._served(self.tops, self.subroots, self.tops.block_paths(none), "of string, digest binary", lambda pdf, path: pd.DataFrame({"of": pdf["of"], "digest": pdf.digest, "path": path}), "path binary")
        above = stored(top.select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "path"), "merkle-tops")
        ways = self.forest.block_paths(above.select("tree", "path"))
        return self.forest.tiers[0].join(ways, ["tree", "block"]).join(above.select("tree", "subroot"), "tree")

    def _served(self, forest: Forest, leaves: DataFrame, ways: DataFrame, kept: str, make, more: str, held: DataFrame | None = None) -> DataFrame:
        """What `make` makes of each block's leaves and their whole paths; leaves meet their block's array and nothing else."""
        width = ARITY**self.height
        held = forest.tiers[0].join(ways, ["tree", "block"]) if held is None else held

        def serve(pdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            r = block.iloc[0]
            tree, above = Subtree(int(r.leaves), int(r.levels), bytes(r.nodes)), bytes(r.path)
            return make(pdf, [tree.path(int(p) % width) + above for p in pdf.pos])

        keyed = leaves.withColumn("block", F.expr(f"pos div {width}"))
        return keyed.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInPandas(serve, f"{kept}, {more}")

    def proofs(self, kept: str, claim: str) -> DataFrame:
        """Of each leaf: the columns in `kept` (DDL), leaf, subroot, proof_sha256 (of its siblings up to the root) and
        folded_root, to which the digest in the column `claim` leads by these siblings."""
        names = [x.split()[0] for x in kept.split(",")]
        held = self.paths()
        subroots = held.select("tree", "subroot").distinct()

        def make(pdf: pd.DataFrame, paths: list[bytes]) -> pd.DataFrame:
            out = pdf[names].copy()
            out["tree"], out["leaf"] = pdf.tree, [bytes(x).hex() for x in pdf.digest]
            out["proof_sha256"] = [siblings_hash(p) for p in paths]
            out["folded_root"] = [folded(bytes(c), p).hex() for c, p in zip(pdf[claim], paths)]
            return out

        rows = self._served(self.forest, self.leaves, None, kept, make, "tree string, leaf string, proof_sha256 string, folded_root string", held.drop("subroot"))
        named = subroots.select(F.col("tree").alias("_t"), F.lower(F.hex("subroot")).alias("subroot"))
        return rows.join(named, F.col("tree") == F.col("_t")).drop("tree", "_t")


def audited(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, of the columns doc_id, source, lang, n_chars, text.

    Leaves ascend by doc_id within a source, nulls first; rows of one doc_id go by their leaf. Null is a
    source like any other and comes first. Rows whose decimal doc_id has an even crc32 are checked with
    their text's line feeds deleted, so they fail if there are any; null texts and null ids aren't tampered with.
    A lone leaf is its source's root, a lone source's root is the root. An empty table gives an empty
    result. Other columns aren't read.
    """
    text = F.col("text")
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))
    own = lambda t: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)
    rows = docs.select(tree_of(F.col("source").cast("string")).alias("tree"), "doc_id", own(text).alias("digest"), F.when(tampers, own(F.translate(text, "\n", ""))).alias("changed"))
    # Kept, so that the texts are read and hashed once.
    rows = stored(rows, "merkle-rows").withColumn("claim", F.coalesce("changed", "digest")).drop("changed")
    manifest = Manifest(rows, "doc_id", height=height)
    root = manifest.root()
    root = F.lit(root.hex() if root else None).cast("string")
    out = manifest.proofs(f"doc_id {dict(rows.dtypes)['doc_id']}", "claim")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


#: crc32 of the text x, bit by bit; DuckDB has none.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}, ''), lambda c: list_transform(range(8), lambda i: (ord(c) >> CAST(i AS INT)) & 1)))), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"
_FIELD = "coalesce(concat(strlen({x}), ':', {x}), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(x=x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}")) + "))"
OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT *, coalesce('+' || source, '') AS tree, {_LEAF.format(text="text")} AS leaf,
  CASE WHEN {CRC_SQL.format(x="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} ELSE {_LEAF.format(text="text")} END AS claim FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
lv AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM p UNION ALL
  SELECT tree, level + 1, pos // 3, CAST(ceil(n / 3.0) AS BIGINT), sha256(string_agg(digest, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY tree, level, pos // 3, n),
sr AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS (SELECT 0 AS level, pos, n, subroot AS digest FROM sr UNION ALL
  SELECT level + 1, pos // 3, CAST(ceil(n / 3.0) AS BIGINT), sha256(string_agg(digest, '' ORDER BY pos)) FROM tv WHERE n > 1 GROUP BY level, pos // 3, n),
sb AS (SELECT a.tree, a.pos, a.level, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.at), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.at), '') AS r
  FROM (SELECT p.tree, p.pos, g.level, p.pos // CAST(pow(3, g.level) AS BIGINT) AS at FROM p JOIN (SELECT DISTINCT tree, level FROM lv WHERE n > 1) g USING (tree)) a
  JOIN lv b ON b.tree = a.tree AND b.level = a.level AND b.pos // 3 = a.at // 3 GROUP BY ALL),
ts AS (SELECT a.tree, 1000 + a.level AS level, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.at), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.at), '') AS r
  FROM (SELECT sr.tree, g.level, sr.pos // CAST(pow(3, g.level) AS BIGINT) AS at FROM sr, (SELECT DISTINCT level FROM tv WHERE n > 1) g) a
  JOIN tv b ON b.level = a.level AND b.pos // 3 = a.at // 3 GROUP BY ALL),
w AS (SELECT tree, pos, level, l, r FROM sb UNION ALL SELECT tree, p.pos, level, l, r FROM ts JOIN p USING (tree)),
o AS (SELECT tree, pos, row_number() OVER (PARTITION BY tree, pos ORDER BY level) AS k, l, r FROM w),
f AS (SELECT tree, pos, 0 AS k, claim AS digest FROM p UNION ALL SELECT f.tree, f.pos, f.k + 1, sha256(concat(o.l, f.digest, o.r)) FROM f JOIN o ON o.tree = f.tree AND o.pos = f.pos AND o.k = f.k + 1),
ff AS (SELECT tree, pos, arg_max(digest, k) AS folded_root FROM f GROUP BY ALL),
pr AS (SELECT tree, pos, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM o GROUP BY ALL),
rt AS (SELECT digest AS root FROM tv WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sr USING (tree) JOIN ff ON ff.tree = p.tree AND ff.pos = p.pos LEFT JOIN pr ON pr.tree = p.tree AND pr.pos = p.pos CROSS JOIN rt
"""
