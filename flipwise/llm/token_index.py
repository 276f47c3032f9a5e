"""Token-id shards with a minimal perfect hash index from document key to payload offset.

A shard file holds at most ``SHARD_BYTES`` of payload and one slice of texts (a
task writes several files where it has more), in this order:

* the payload: ids of all documents joined, as 2-byte (vocabulary up to 65,536) or 4-byte little-endian integers;
* record table: ``n + 1`` offsets (in ids) of the ``n`` documents, their keys, and whether the key is null;
* the hash index over the distinct non-null keys: bit levels, then per slot the
  fingerprint of the key, its first record and its number of records (equal
  keys are neighbours, as documents lie in ascending order of key);
* a JSON footer, its length, and the magic bytes.

The index is built by levels: at each level a key goes to one bit of a bit
array; keys that are alone keep their bit, the others go on to the next level
(a few levels suffice, each a third of the one before).  A key's slot is the
rank of its bit, so a look-up costs one hash per level passed, whatever the
number of documents.  A fingerprint that differs tells absent keys.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, open_folder, runs, scratch_folder, stored, whole_text, write_atomically
from .tokens import VOCABULARY, encoder, text_array

MAGIC = b"TOKSHRD1"
#: Bits per key at each level; more bits, fewer levels.
GAMMA = 1.5
#: A task begins another shard file once one holds this payload, so index and record table stay small.
SHARD_BYTES = 256 << 20
MANIFEST = "task int, part int, file string, n_docs long, n_tokens long, first_key long, last_key long"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit mix of integer keys; one to one for each seed."""
    z = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: ``slots`` maps the i-th key to a number below n."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.ranks = levels, ranks

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, seed = [], keys.astype(np.int64), 0
        while len(left):
            bits = max(8, int(np.ceil(GAMMA * len(left) / 8)) * 8)
            at = (mix(left, seed) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left, seed = left[~alone[at]], seed + 1
        return cls.load(levels)

    @classmethod
    def load(cls, levels: list[np.ndarray]) -> PerfectHash:
        ranks, base = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        return cls(levels, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level holds it (then it is no key)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for seed, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = (mix(keys[open_], seed) % np.uint64(8 * len(bits))).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[open_[hit]] = rank[at[hit] >> 3] + below[hit]
            open_ = open_[~hit]
        return out


def write_shard(folder: str, name: str, width: int, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    """Write one shard from (keys, is null, ids joined, ids per document) in ascending order of key."""
    keys, nulls, lengths = [], [], []

    def chunks() -> Iterator[bytes]:
        for k, z, ids, n in batches:
            keys.append(k)
            nulls.append(z)
            lengths.append(n)
            yield ids.astype(f"<u{width}").tobytes()
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        null = np.concatenate(nulls) if nulls else np.empty(0, bool)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1, np.int64)
        live = np.flatnonzero(~null)
        distinct, first, runs = np.unique(key[live], return_index=True, return_counts=True)
        index = PerfectHash.build(distinct)
        slot = index.slots(distinct)
        order = np.empty(len(distinct), np.int64)
        order[slot] = np.arange(len(distinct))
        prints = fingerprints(distinct[order])
        parts = [offsets.astype("<i8"), key.astype("<i8"), np.packbits(null, bitorder="little"), *index.levels,
                 prints.astype("<u4"), live[first[order]].astype("<i8") if len(live) else np.empty(0, "<i8"), runs[order].astype("<i8")]
        foot = json.dumps({"width": width, "n_docs": len(key), "n_tokens": int(offsets[-1]), "n_keys": len(distinct),
                           "levels": [len(x) for x in index.levels]}).encode()
        yield from (x.tobytes() for x in parts)
        yield foot + len(foot).to_bytes(8, "little") + MAGIC

    write_atomically(folder, name, chunks())
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    live = key[~np.concatenate(nulls)] if keys else key
    return {"n_docs": len(key), "n_tokens": int(sum(x.sum() for x in lengths)),
            "first_key": int(live[0]) if len(live) else None, "last_key": int(live[-1]) if len(live) else None}


class Shard:
    """Reader of one shard file: the index is held in memory, payloads are read by offset."""

    def __init__(self, folder: str, name: str):
        filesystem, path = open_folder(folder)
        self.file = filesystem.open_input_file(f"{path}/{name}")
        size = self.file.size()
        self.file.seek(size - 16)
        tail = self.file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is not a token shard")
        n_foot = int.from_bytes(tail[:8], "little")
        self.file.seek(size - 16 - n_foot)
        self.meta = json.loads(self.file.read(n_foot))
        n, k, self.width = self.meta["n_docs"], self.meta["n_keys"], self.meta["width"]
        self.file.seek(self.meta["n_tokens"] * self.width)
        read = lambda kind, count: np.frombuffer(self.file.read(np.dtype(kind).itemsize * count), kind)
        self.offsets, self.keys = read("<i8", n + 1), read("<i8", n)
        self.null = np.unpackbits(read("u1", (n + 7) // 8), count=n, bitorder="little").astype(bool)
        self.index = PerfectHash.load([read("u1", size_) for size_ in self.meta["levels"]])
        self.prints, self.first, self.runs = read("<u4", k), read("<i8", k), read("<i8", k)

    def records(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records for a key that the shard lacks."""
        slot = self.index.slots(keys)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == fingerprints(keys[found])
        found[found] = self.keys[self.first[slot[found]]] == keys[found]
        at = np.where(found, slot, 0)
        if not len(self.first):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return np.where(found, self.first[at], 0), np.where(found, self.runs[at], 0)

    def payload(self, first: int, last: int) -> np.ndarray:
        """Ids of the records from ``first`` up to ``last``, joined."""
        begin, end = int(self.offsets[first]), int(self.offsets[last])
        self.file.seek(begin * self.width)
        return np.frombuffer(self.file.read((end - begin) * self.width), f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


def write_token_shards(docs: DataFrame, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                       vocabulary: str = VOCABULARY, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text, append ``end_id``, write the shards in ascending order of key; returns the manifest.

    A file ends once its payload reaches ``shard_bytes``, however much one task
    has; ``shards`` fixes the number of tasks.

    Texts are dealt out by sampled ranges of the key (with a hash of the text
    behind it, so that rows of one repeated key may lie in several shards) and
    encoded after the shuffle: the shuffle moves texts once, ids go straight
    to the file.  Null keys come first and are not indexed; null texts count as empty.
    """
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("key"), whole_text(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    by = [F.col("key").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        size = encode.tokenizer.get_vocab_size(with_added_tokens=True)
        task = TaskContext.get()

        def encoded():
            for batch in batches:
                key_, texts = batch.column(0), text_array(batch.column(1))
                null = key_.is_null().to_numpy(zero_copy_only=False)
                number = key_.fill_null(0).to_numpy(zero_copy_only=False)
                for a, ids, n in encode.slices(texts):
                    out = np.full(len(ids) + len(n), end_id, np.uint32)
                    ends = np.cumsum(n + 1) - 1
                    body = np.ones(len(out), bool)
                    body[ends] = False
                    out[body] = ids
                    yield number[a:a + len(n)], null[a:a + len(n)], out, n + 1

        width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
        for part, run in enumerate(runs(encoded(), lambda batch: width * batch[2].size, shard_bytes)):
            name = f"shard-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.tok"
            said = write_shard(folder, name, width, run)
            yield pa.RecordBatch.from_pydict({"task": pa.array([task.partitionId()], pa.int32()), "part": pa.array([part], pa.int32()),
                                              "file": [name], **{k: pa.array([v], pa.int64()) for k, v in said.items()}})

    manifest = arrow_map(dealt.sortWithinPartitions(*by).select("key", "text"), write, MANIFEST)
    return stored(manifest, "token-manifest")


def shard_list(manifest: DataFrame) -> list[dict]:
    """The manifest in order of key with ``shard``, its number, and ``start``, the ids in all shards before.

    One row per shard file, not per document: this metadata alone is read by the driver.
    """
    out, start = [], 0
    for number, row in enumerate(sorted((r.asDict() for r in manifest.collect()), key=lambda r: (r["task"], r["part"]))):
        out.append(row | {"shard": number, "start": start})
        start += row["n_tokens"]
    return out


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the shards, found through the index: doc_id, start, n_tokens, ids_crc32, shard, record."""
    shards = shard_list(manifest)
    placed = manifest.sparkSession.createDataFrame([(r["shard"], r["file"], r["start"]) for r in shards],
                                                   "shard int, file string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["file"])
                at = np.arange(shard.meta["n_docs"])
                first, runs = shard.records(shard.keys)
                held = (first <= at) & (at < first + runs)
                if not (held | shard.null).all():
                    raise ValueError(f"{row['file']}: the index misses keys of its own records")
                crc = np.empty(len(at), np.int64)
                for a in range(0, len(at), 2000):
                    b = min(a + 2000, len(at))
                    ids, base = shard.payload(a, b), shard.offsets[a]
                    for i in range(a, b):
                        crc[i] = zlib.crc32(ids[shard.offsets[i] - base:shard.offsets[i + 1] - base])
                shard.close()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard.keys, pa.int64(), mask=shard.null),
                    "start": pa.array(shard.offsets[:-1] + row["start"], pa.int64()),
                    "n_tokens": pa.array(np.diff(shard.offsets), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    "shard": pa.array(np.full(len(at), row["shard"]), pa.int32()), "record": pa.array(at, pa.int64())})

    return arrow_map(placed.repartition(max(1, len(shards)), "shard"), read,
                     "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, record long")


def look_up(spark: SparkSession, manifest: DataFrame, folder: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Keyed access: one row (doc_id, ids) per record of each key of ``keys``; absent keys give none.

    A key goes to the shards whose range holds it (found by binary search in
    the ends of all shards, one pair per shard file); each shard answers all
    its keys through its index.
    """
    shards = [r for r in shard_list(manifest) if r["first_key"] is not None]
    files = [r["file"] for r in shards]
    first, last = (np.array([r[k] for r in shards], np.int64) for k in ("first_key", "last_key"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            begin, end = np.searchsorted(last, key, "left"), np.searchsorted(first, key, "right")
            n = np.maximum(end - begin, 0)
            at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_pydict({"file": pa.array([files[i] for i in at], pa.string()),
                                              "key": pa.array(np.repeat(key, n), pa.int64())})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for batch in batches:
            for part in _runs(batch):
                if part.column(0)[0].as_py() != name:
                    name = part.column(0)[0].as_py()
                    shard = Shard(folder, name)
                asked = part.column(1).to_numpy()
                begin, runs = shard.records(asked)
                rows = [(int(k), r) for k, a, n in zip(asked, begin, runs) for r in range(a, a + n)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([k for k, _ in rows], pa.int64()),
                    "ids": pa.array([shard.payload(r, r + 1) for _, r in rows], pa.list_(pa.int64()))})

    wanted = keys.select(F.col(key_col).cast("long").alias("key")).where(F.col("key").isNotNull()).distinct()
    routed = arrow_map(wanted, route, "file string, key long")
    dealt = routed.repartition(F.col("file"), F.pmod("key", F.lit(16))).sortWithinPartitions("file")
    return arrow_map(dealt, fetch, "doc_id long, ids array<long>")


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with the same first column, of at most 1,000 rows."""
    names = batch.column(0).to_pylist()
    a = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[a] or i - a == 1000:
            yield batch.slice(a, i - a)
            a = i


def token_shards(spark: SparkSession, docs: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """Write the shards of ``docs`` and read them back: doc_id, start, n_tokens (with the end id), ids_crc32, shard, record.

    Null and empty texts hold the end id alone; repeated rows and repeated ids
    are records of their own, neighbours that the index finds together; null
    ids come first and are read, but not indexed; other columns are not read;
    an empty table gives no rows.
    """
    folder = folder or scratch_folder(spark, "token-shards")
    return read_token_shards(write_token_shards(docs, folder, **kw), folder)
