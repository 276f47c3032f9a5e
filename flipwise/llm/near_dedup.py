"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text's elements are its distinct shingles of five words.  Each element sends
a Poisson process of arrivals, faster with its weight, each arrival at a
uniformly drawn register; a register keeps the element that arrives first.
Two texts agree in a register with the probability Jaccard similarity of their
weighted elements.  Arrivals later than the latest register are never
generated: an element stops as soon as its clock passes it.

Registers are drawn under two weightings: by occurrences, which finds texts
that are near as bags of shingles, and with weight 1 for every shingle.  Links
are decided by the Jaccard similarity of the shingle sets, which the second
weighting estimates, so it alone has recall by design; the first one adds
candidates.  A text whose shingles all occur once has the same registers in both.

Registers are cut into bands; texts that share a band are candidates.
Candidates meet in blocks of bounded size, where the Jaccard similarity of
their shingle sets is computed exactly, and each class there is returned as
one link per text.  Classes are the connected components of all links.

Copies count once: texts are nodes by their MD5, and rows join at the end.
Groups of candidates that need several blocks take a second pass: members that
the first pass did not link to the group's largest class meet all the other
blocks.  So every candidate pair of different classes is compared, while a
huge group of true near copies costs a number of comparisons in proportion to
its size, and no pair is ever written that is not a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, ship, stored, whole_text
from .components import components
from .tokens import release, text_array

WORDS, SIMILARITY = 5, 0.8
#: 25 bands of 5 registers: a pair at 0.8 shares a band but for a chance of 5e-5.
BANDS, ROWS = 25, 5
#: Bands of the registers weighted by occurrences.
WEIGHTED_BANDS = 8
SLICE_BYTES = 4_000_000
#: A block of candidates holds about so many texts, and about so many bytes of them.
BLOCK_TEXTS, BLOCK_BYTES = 512, 16_000_000


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, occurrences), sorted, of each distinct shingle of each text.

    Words are runs of anything but ASCII white space.  A text with fewer words has one shingle, all its words; one without words none.
    """
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    row = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    row = row[real]
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    word = pd.util.hash_array(distinct, categorize=False).astype(np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] \
        if len(distinct) else np.empty(0, np.uint64)
    count = np.bincount(row, minlength=n)
    base = np.uint64(0x9E3779B97F4A7C15)
    m = max(0, len(word) - words + 1)
    value = np.zeros(m, np.uint64)
    for k in range(words):
        value = value * base + word[k:k + m]
    whole = row[:m] == row[words - 1:] if m else np.empty(0, bool)
    owner, value = row[:m][whole], _mix(value[whole])
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        begin = np.cumsum(count) - count
        short = np.zeros(len(few), np.uint64)
        for k in range(words - 1):
            inside = count[few] > k
            at = np.where(inside, begin[few] + k, 0)
            short = np.where(inside, short * base + word[at] + np.uint64(1), short)
        owner, value = np.concatenate([owner, few]), np.concatenate([value, _mix(short ^ base)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(owner)))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash: per text and register the element that arrives first (0 where a text has no elements)."""
    first = np.full(n * registers, np.inf)
    latest = np.full(n, np.inf)
    clock = np.zeros(len(owner))
    live = np.arange(len(owner))
    seen_at, seen_time, seen_element = [], [], []
    step = 0
    while len(live):
        step += 1
        drawn = _mix(element[live] + np.uint64((0xD1342543DE82EF95 * step) & (2**64 - 1)))
        uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        clock[live] -= np.log(uniform) / weight[live]
        live = live[clock[live] < latest[owner[live]]]
        again = _mix(element[live] ^ _mix(np.full(len(live), step, np.uint64)))
        at = owner[live] * registers + (again % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, clock[live])
        seen_at.append(at)
        seen_time.append(clock[live])
        seen_element.append(element[live])
        latest = first.reshape(n, registers).max(axis=1)
        live = live[clock[live] < latest[owner[live]]]
    out = np.zeros(n * registers, np.uint64)
    if seen_at:
        at, time, who = (np.concatenate(x) for x in (seen_at, seen_time, seen_element))
        won = time == first[at]
        out[at[won]] = who[won]
    return out.reshape(n, registers)


def band_hashes(texts: pa.Array, bands: int, rows: int, words: int) -> list[np.ndarray | None]:
    """The band hashes of each text, of unit weights and of occurrences; None for a text without words."""
    owner, element, times = shingles(texts, words)
    n = len(texts)
    held = np.bincount(owner, minlength=n) > 0
    registers = signatures(owner, element, np.ones(len(owner)), n, bands * rows)
    weighted = registers[:, :min(bands, WEIGHTED_BANDS) * rows].copy()
    repeats = np.unique(owner[times > 1])
    if len(repeats):
        some = np.isin(owner, repeats)
        weighted[repeats] = signatures(np.searchsorted(repeats, owner[some]), element[some], times[some].astype(float),
                                       len(repeats), bands * rows)[:, :weighted.shape[1]]
    each = []
    for number, signature in ((1, registers), (bands + 1, weighted)):
        count = signature.shape[1] // rows
        value = np.broadcast_to(np.arange(number, number + count, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (n, count)).copy()
        for k in range(rows):
            value = _mix(value + signature[:, k::rows])
        each.append(value)
    value = np.concatenate(each, axis=1)
    return [value[i].view(np.int64) if held[i] else None for i in range(n)]


def _with_bands(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, content (MD5 of the text), bands.  Of copies in one run of rows only the first carries bands."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = text_array(batch.column(2))
            for a, n in byte_slices(texts, SLICE_BYTES):
                part = batch.slice(a, n)
                code = part.column(1).dictionary_encode().indices.to_numpy()
                one = np.unique(code, return_index=True)[1]
                found: list[np.ndarray | None] = [None] * n
                for i, hashes in zip(one, band_hashes(texts.slice(a, n).take(pa.array(one)), bands, rows, words)):
                    found[i] = hashes
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "content": part.column(1),
                                                  "bands": pa.array(found, pa.list_(pa.int64()))})

    return arrow_map(docs.select("doc_id", F.md5("text").alias("content"), "text"), banded,
                     "doc_id long, content string, bands array<long>")


def _links(member: pa.Table, words: int, similarity: float, visitors: bool) -> pa.Table:
    """Links of one block: per class found, each text to one other.  With ``visitors``, only pairs of a visitor and a resident."""
    content = np.array(member.column("content").to_pylist(), object)
    keep = np.unique(content, return_index=True)[1] if not visitors else np.arange(len(content))
    content = content[keep]
    visits = np.array(member.column("visits").to_pylist(), bool)[keep]
    texts = text_array(member.column("text")).take(pa.array(keep))
    owner, value, _ = shingles(texts, words)
    n = len(content)
    code = np.unique(value, return_inverse=True)[1]
    size = np.bincount(owner, minlength=n)
    edge = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for i in range(n):
        if visitors and not visits[i]:
            continue
        own = code[edge[i]:edge[i + 1]]
        if not len(own):
            continue
        marked[own] = True
        begin = 0 if visitors else edge[i + 1]
        common = np.bincount(owner[begin:], marked[code[begin:]], minlength=n)
        marked[own] = False
        near = (common >= similarity * (size[i] + size - common)) & (common > 0)
        near[i] = False
        if visitors:
            near &= ~visits
        for j in np.flatnonzero(near).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(content[i])
                b.append(content[j])
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def _texts_of(docs: DataFrame, wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """node, content, text of each wanted node, from one row of each content."""
    # copies collapse before the join: a content that very many rows hold is one row of it
    one = seen.groupBy("content").agg(F.max("doc_id").alias("one")).withColumn("node", F.xxhash64("content")) \
        .join(wanted, "node", "left_semi")
    rows = docs.select("doc_id", F.md5("text").alias("content"), "text")
    chosen = one.select("node", F.col("content").alias("c"), "one")
    found = rows.join(chosen, (F.col("content") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("one")))
    return found.select("node", "content", "text")


def near_links(docs: DataFrame, seen: DataFrame, words: int = WORDS, similarity: float = SIMILARITY,
               block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) between contents whose shingle sets have at least the similarity, enough to connect each class."""
    ship(docs.sparkSession)
    shown = seen.where(F.col("bands").isNotNull()).select(F.xxhash64("content").alias("node"), F.explode("bands").alias("band"))
    buckets = shown.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    candidates = stored(shown.join(buckets, "band").select("leader", "node").distinct(), "candidates")
    texts = stored(_texts_of(docs, candidates.select("node").distinct(), seen).dropDuplicates(["content"])
                   .withColumn("n_bytes", F.octet_length("text")), "candidate-texts")
    member = candidates.join(texts.drop("text"), "node")
    groups = stored(member.groupBy("leader").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block_texts)), F.ceil(F.sum("n_bytes") / F.lit(block_bytes))).cast("int").alias("blocks")),
        "candidate-groups")
    placed = stored(member.select("leader", "content").join(groups, "leader")
                    .withColumn("block", F.pmod(F.hash("content"), F.col("blocks"))), "candidate-blocks")
    with_text = lambda rows: rows.join(texts.select("content", "text"), "content")
    inside = lambda table: _links(table, words, similarity, False)
    across = lambda table: _links(table, words, similarity, True)
    schema = "a string, b string"
    first = stored(with_text(placed).select("leader", "block", "content", "text", F.lit(False).alias("visits"))
                   .groupBy("leader", "block").applyInArrow(inside, schema).distinct(), "links-inside")
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return first
    label = components(first)
    marked = large.join(label.withColumnRenamed("node", "content"), "content", "left") \
        .withColumn("component", F.coalesce("component", "content"))
    largest = marked.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("leader") \
        .agg(F.max(F.struct("n", "component")).getField("component").alias("largest"), F.max("n").alias("n_largest"), F.sum("n").alias("n"))
    largest = largest.withColumn("rounds", F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("n_largest")) / F.lit(block_texts))).cast("int")) \
        .select("leader", "largest", "rounds")
    marked = stored(marked.join(stored(largest, "candidate-largest"), "leader"), "candidate-rest")
    round_ = F.pmod(F.xxhash64("content", F.lit(1)), F.col("rounds")).cast("int")
    guests = marked.where("component <> largest").select(
        "leader", F.col("block").alias("own"), "content", round_.alias("round"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("own <> block") \
        .select("leader", "block", "round", "content", F.lit(True).alias("visits"))
    hosts = marked.select("leader", "block", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"),
                          "content", F.lit(False).alias("visits"))
    second = with_text(guests.unionByName(hosts)).groupBy("leader", "block", "round").applyInArrow(across, schema)
    return stored(first.unionByName(second).distinct(), "links-all")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
                 bands: int = BANDS, rows: int = ROWS, block_texts: int = BLOCK_TEXTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, content.

    The class id is the least id of the class (null only if all are null),
    and the row with it stays; of rows that repeat that id the one with the
    least MD5, of equal rows one.  Null counts as empty; equal texts share a
    class, whatever their length; texts without words are near no other text.
    Other columns, whatever their names, change nothing; an empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    seen = stored(_with_bands(plain, bands, rows, words), "near-bands")
    label = components(near_links(plain, seen, words, similarity, block_texts, block_bytes))
    named = seen.select("doc_id", "content").join(label.withColumnRenamed("node", "content"), "content", "left") \
        .withColumn("component", F.coalesce("component", "content"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("content"))
    classes = named.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size"))
    # stored, so that both sides of the join are shuffled for it and AQE can split the rows of a huge class
    joined = named.join(stored(classes, "near-sizes"), "component")
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("content") == F.col("best.content"))
    repeated = Window.partitionBy("doc_id", "content").orderBy("class_size")
    return joined.withColumn("best_row", best).withColumn("nth", F.row_number().over(repeated)) \
        .select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("best_row") & (F.col("nth") == 1)).alias("kept"), "content")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns, whatever their names.

    Null ids and texts as in ``near_classes``; of rows equal in id and text one stays; an empty table gives no rows.
    """
    kept = near_classes(docs, id_col, text_col, **kw).where("kept").select(F.col("doc_id").alias("__id"), F.col("content").alias("__content"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(id_col).cast("long").alias("__key"),
                       F.md5(whole_text(text_col)).alias("__md5"), F.col(text_col).isNull().alias("__null"))
    found = rows.join(kept, F.col("__key").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__content")), "left_semi")
    repeated = Window.partitionBy("__key", "__md5").orderBy("__null")
    return found.withColumn("__nth", F.row_number().over(repeated)).where("__nth = 1").select("__row.*")
