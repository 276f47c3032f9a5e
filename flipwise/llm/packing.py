"""Best-fit packing of whole documents into sequences by hierarchical residual packing.

Round 0 deals the pieces out to groups of bounded size; each group packs its
pieces best-fit (largest first, each into the fullest sequence with room).
Sequences that are nearly full are done.  The underfull ones go up a tree: a
few groups merge into one, an underfull sequence counts as one item of its
fill, and the groups pack best-fit again.  A round also closes the sequences
into which not even the smallest item left fits.  Rounds end when one group
holds what is left, or when a round merges next to nothing.

Only lengths and ids of pieces are shuffled.  A group holds at most about
``group_items`` items of two integers, whatever the corpus size: while more
are left, there are more groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ship, stored, whole_text
from .tokens import VOCABULARY, encoder, text_array

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Items of a group at most, about; groups that merge into one in the next round; fill that counts as full.
GROUP_ITEMS, FAN, NEARLY_FULL = 25_000, 8, 0.998
#: A round that joins fewer than this share of its items ends the rounds.
LEAST_GAIN = 0.002


def document_pieces(docs: DataFrame, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                    vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every whole text and its end id.

    Only longer documents are cut; their first piece takes what the full
    pieces leave.  ``uid`` numbers the pieces; it holds once they are written.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_id = batch.column(0)
            for a, ids, n in encode.slices(text_array(batch.column(1))):
                full = np.full(len(ids) + len(n), end_id, "<u4")
                body = np.ones(len(full), bool)
                body[np.cumsum(n + 1) - 1] = False
                full[body] = ids
                size = n + 1
                pieces = -(-size // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = size - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                at = (np.cumsum(size) - size)[row] + start
                crc = [zlib.crc32(full[i:j]) for i, j in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_pydict({
                    "uid": uid + np.arange(len(row)), "doc_id": doc_id.slice(a, len(n)).take(pa.array(row)),
                    "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())})
                uid += len(row)

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")), cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size in turn: into the fullest bin with room, else a new one.

    ``room`` has a bit for each residual that some bin has, so the tightest
    bin is its lowest bit at or above the size.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, n_bins, bins, offsets = 0, 0, [], []
    for size in sizes:
        fits = room >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            bin_ = by_room[left].pop()
            if not by_room[left]:
                room ^= 1 << left
        else:
            left, bin_ = capacity, n_bins
            n_bins += 1
        bins.append(bin_)
        offsets.append(capacity - left)
        left -= size
        if left:
            by_room[left].append(bin_)
            room |= 1 << left
    return bins, offsets


def _pack_round(items: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """Packs (item, size) in ``groups`` groups: item, size, bin (the id of its first item), shift, fill."""
    ship(items.sparkSession)

    def pack(table):
        size = table.column("size").to_numpy()
        item = table.column("item").to_numpy()
        order = np.lexsort((item, -size))
        size, item = size[order], item[order]
        bins, shift = best_fit(size.tolist(), capacity)
        bins = np.array(bins, np.int64)
        fill = np.bincount(bins, size).astype(np.int64)
        first = np.unique(bins, return_index=True)[1]
        return pa.table({"item": item, "size": size, "bin": item[first][bins], "shift": pa.array(shift, pa.int64()),
                         "fill": fill[bins]})

    key = F.pmod(F.xxhash64(F.col("item"), F.lit(number)), F.lit(groups)).alias("part")
    return items.select(key, "item", "size").groupBy("part").applyInArrow(
        pack, "item long, size long, bin long, shift long, fill long")


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
         vocabulary: str = VOCABULARY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of the end id alone; repeated rows and
    null ids are packed row by row; an empty table gives no rows.  Other
    columns of ``docs`` are not read.
    """
    pieces = stored(document_pieces(docs, capacity, end_id, id_col, text_col, vocabulary), "pieces")
    items = pieces.where(F.col("length") < capacity).select(F.col("uid").alias("item"), F.col("length").alias("size"))
    n, number, rounds = items.count(), 0, []
    groups = max(1, -(-n // group_items))
    while n:
        done = stored(_pack_round(items, groups, number, capacity), f"packed-{number}")
        rounds.append(done)
        bins = done.where((F.col("item") == F.col("bin")) & (F.col("fill") < int(NEARLY_FULL * capacity))) \
            .select(F.col("bin").alias("item"), F.col("fill").alias("size"))
        if groups == 1:
            break
        smallest, smallest_but_one = ([r[0] for r in bins.select("size").orderBy("size").limit(2).collect()] + [capacity] * 2)[:2]
        # a bin stays open if another one fits into it: the smallest, or for the smallest itself the next
        items = bins.where((F.col("size") + F.lit(smallest) <= capacity) & (F.lit(smallest + smallest_but_one) <= capacity))
        left = items.count()
        merged = max(1, -(-groups // FAN), -(-left // group_items))
        if left < 2 or (merged >= groups and left > (1 - LEAST_GAIN) * n):
            break
        n, groups, number = left, merged, number + 1
    whole = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    if not rounds:
        return _columns(whole)
    above = None
    for done in reversed(rounds):
        here = done.select(F.col("item"), F.col("bin"), F.col("shift"))
        if above is not None:
            up = above.select(F.col("item").alias("bin"), F.col("bin").alias("top"), F.col("shift").alias("more"))
            here = here.join(up, "bin", "left").select("item", F.coalesce("top", "bin").alias("bin"),
                                                       (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        above = here
    packed = pieces.where(F.col("length") < capacity).join(above.withColumnRenamed("item", "uid"), "uid") \
        .withColumn("sequence_id", F.col("bin")).withColumn("offset", F.col("shift"))
    return _columns(whole).unionByName(_columns(packed))


def _columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
