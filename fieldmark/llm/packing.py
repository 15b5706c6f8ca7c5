"""Best-fit packing of tokenised documents, by a tree of partitions.

1. Documents are tokenised; longer ones are cut into pieces of at most SIZE tokens. The table of
   pieces (numbers only) is written to the shared folder, so that packing never tokenises again.
2. Pieces are dealt by hash into groups of about GROUP pieces; each packs best-fit, longest first.
   Bins with at most SLACK tokens left are done.
3. Of the others, a group hands on the bins that can still change: those at most half full (best fit
   leaves one at most) and, as hosts for them, the FAN_IN + 1 emptiest of the fuller ones. FAN_IN
   groups meet, and their bins are items of the next best-fit round, until one group is left. Each
   round has at most FAN_IN times as many bins to pack as it has groups, so no task grows with the
   data, and every bin that can still find a host among its group's bins finds one.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldmark.llm.common import stored, table, whole_text

SIZE, END_ID, SLACK, GROUP, FAN_IN = 4096, 1, 64, 20_000, 8
CACHE = 100_000
# Fixed values, of the vocabulary file: how it cuts lower-cased text into pieces that it tokenises each by itself,
# for texts of Latin-1 characters only (\p{L}, \p{N} and \s written out for those).
LETTER, NUMBER, BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\r\x0b\x0c\x85\xa0"
PIECE = re.compile(f"[{LETTER}]+|'(?:[stmd]|re|ve|ll)|[{NUMBER}]|[^{BLANKS}{LETTER}{NUMBER}]+")
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Other texts are cut at these only; the tokenizer does the rest.
BLANK = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ODD = [b for b in range(256) if b not in _PRINTED]
BYTES = {b: 256 + _ODD.index(b) for b in _ODD}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Token ids of texts. Where the vocabulary cuts texts as PIECE does, it never joins across pieces, so each
    piece is tokenised once and its ids' bytes are remembered (for up to CACHE pieces). Texts that name a special
    token, and all texts of a vocabulary with other settings, go to the tokenizer whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        says = json.loads(self.tokenizer.to_str())
        self.known = all(says.get(k) == v for k, v in SETTINGS.items()) and says["model"].get("end_of_word_suffix") == "</w>" and all("<|" in t["content"] for t in says["added_tokens"])
        self.tokenize = self.tokenizer.model.tokenize
        self.seen: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> np.ndarray:
        if not self.known or "<|" in text:
            return np.frombuffer(self._encode([text])[0], np.uint32)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            parts, seen = [w for w in BLANK.split(text) if w], self.chunks
            new = list(set(parts).difference(seen))
            if new:
                if len(seen) > CACHE:
                    seen.clear()
                    new = list(set(parts))
                seen.update(zip(new, self._encode(new)))
        else:
            parts, seen = PIECE.findall(text.lower()), self.seen
            if len(seen) > CACHE:
                seen.clear()
            for w in set(parts).difference(seen):
                as_bytes = w if w.isalpha() and w.isascii() else w.encode().decode("latin-1").translate(BYTES)
                seen[w] = array("I", [t.id for t in self.tokenize(as_bytes)]).tobytes()
        return np.frombuffer(b"".join(map(seen.__getitem__, parts)), np.uint32)


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: of each document's tokens and END_ID.

    Null text counts as empty and is the one token END_ID.
    """
    path = path or default_tokenizer()
    rows = docs.select("doc_id", whole_text().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def work(batches):
        words = Words(path)
        for batch in batches:
            at, cols = [], ([], [], [], [], [])
            for n, text in enumerate(batch.column("text")):
                found = np.append(words.ids(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for p, s in enumerate(range(0, len(found), size)):
                    part = found[s : s + size]
                    at.append(n)
                    for c, v in zip(cols, (p, s, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if ids else None)):
                        c.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))[: 4 + ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    return rows.mapInArrow(work, shape)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it, and bins' fills: each length, in the given order, goes to the fullest bin that takes it."""
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    have = 0  # bit r: a bin with room r
    for i, n in enumerate(lengths.tolist()):
        fit = have >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                have ^= 1 << room
        else:
            b, room = len(fills), size
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        room -= n
        if room:
            if not by_room[room]:
                have |= 1 << room
            by_room[room].append(b)
    return bins, offsets, np.array(fills, np.int64)


def _carried(fills: np.ndarray, size: int, slack: int, fan_in: int) -> np.ndarray:
    """Which bins go to the next round."""
    out = np.zeros(len(fills), bool)
    low = np.flatnonzero(fills <= size // 2)
    out[low] = True
    hosts = np.flatnonzero((fills > size // 2) & (fills < size - slack))
    out[hosts[np.lexsort((hosts, fills[hosts]))][: fan_in + 1]] = True
    return out


def pack(parts: DataFrame, size: int = SIZE, slack: int = SLACK, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """parts (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    parts is a stored table. Ties of length go by doc_id, piece and checksum, so every run agrees;
    rows that repeat are pieces of their own. An empty table packs into nothing.
    """
    groups = max(1, -(-parts.count() // group))
    kind = dict(parts.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, fills = best_fit(pdf.length.to_numpy(), size)
        g = int(pdf.grp.iloc[0])
        go = _carried(fills, size, slack, fan_in)
        return pdf[names].assign(bin=g * (1 << 32) + bins, place=offsets, fill=fills[bins], go=go[bins])

    dealt = parts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    placed = stored(dealt.groupBy("grp").applyInPandas(local, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long, go boolean"), "packed")
    if groups == 1:
        return placed.select(*names, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable")
        bins, offsets, fills = best_fit(pdf.fill.to_numpy(), size)
        host = np.empty(len(fills), np.int64)
        host[bins[::-1]] = pdf.bin.to_numpy()[::-1]  # the first item of a bin names it
        go = _carried(fills, size, slack, fan_in)
        return pd.DataFrame({"bin": pdf.bin, "grp": pdf.grp, "into": host[bins], "shift": offsets, "filled": fills[bins], "go": go[bins]})

    # Bins that may still move: at most fan_in + 2 or so for each group of pieces.
    live = placed.filter("go").select("bin", "fill", F.floor(F.col("bin") / (1 << 32)).alias("grp")).distinct()
    moves = live.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"))
    left = groups
    while left > 1:
        left = -(-left // fan_in)
        step = live.withColumn("grp", F.floor(F.col("grp") / fan_in)).groupBy("grp").applyInPandas(merge, "bin long, grp long, into long, shift long, filled long, go boolean")
        step = stored(step, "merged")
        s = step.select(F.col("bin").alias("b"), F.col("into"), F.col("shift").alias("more"))
        moves = moves.join(s, moves["root"] == s["b"], "left").select("bin", F.coalesce("into", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        live = step.filter("go AND into = bin").select("bin", F.col("filled").alias("fill"), "grp")
    moves = moves.select(F.col("bin").alias("b"), "root", "shift")
    out = placed.join(moves, placed["bin"] == moves["b"], "left")
    return out.select(*names, F.coalesce("root", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(stored(pieces(docs, path, size), "pieces"), size)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
