"""Removal of repeated byte strings by suffix sorting, in shards dealt out by content.

Every byte that is covered by a string of ``length`` bytes which also starts
earlier (in a document of smaller id, or earlier in the same one) is removed.

1. Texts are written as block files in the shared folder.
2. Each string of ``length`` bytes has one gram of least hash (the leftmost
   of equal ones); equal strings have equal such grams at equal places.  The
   strings of one gram occurrence are neighbours, together a passage.  Blocks
   post their passages by gram, so all equal strings come to one shard, and
   identical passages of a block are posted once.
3. A shard looks at each gram's passages.  Identical ones repeat the first.
   Of a gram with several different passages, the text of each is fetched.
4. The shard's texts are suffix-sorted by external induced sorting
   (``induced_sort``); neighbours that share ``length`` bytes are one string,
   and all but its earliest start are repeats.
5. Repeats go back to the blocks as ranges, where documents are put together.

Grams that fill a large part of a shard (a passage or line that very many
documents hold amid ever different text) are found by counts over all blocks;
their strings are posted singly, so copies collapse in each block and the
rest spreads over all shards.  Grams of such counts are told apart by a table
of cells, at most two for each 8 MB of text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, open_folder, scratch_folder, ship, stored, whole_text, write_atomically
from .induced_sort import MEMORY, Disk, sort_suffixes
from .tokens import release

LENGTH = 100
#: Text of a block, of a shard (before passages are picked), and of a piece that is hashed at a time.
BLOCK_BYTES, SHARD_BYTES, PIECE_BYTES = 8_000_000, 8_000_000, 256_000
#: Cells of a shard in which grams are counted; a cell with half as many passages as a shard has on average is posted singly.
CELLS = 8
U = np.uint64
POSITION_BITS = U(31)  # a text has less than 2^31 bytes; the other bits of a gram's hash order the grams
BASE = 0xD1342543DE82EF95
NULL_ID = 2**63 - 1


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


_BYTE = _mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n of them."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            table = np.full(n, base, U)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS


class RangeHash:
    """Hashes of ranges of bytes, by prefix sums of a polynomial over random byte values."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[:len(data)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def every(self, width: int) -> np.ndarray:
        return _mix((self.sums[width:] - self.sums[:-width]) * self.down[:len(self.sums) - width])


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return x if span == width else np.minimum(x[:span - width], x[width - span:])


@dataclass
class Passages:
    """Strings by the gram that they share: range of starts' first byte to last string's end, hash of the gram and of the bytes."""

    begin: np.ndarray
    end: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def passages(data: np.ndarray, first: np.ndarray, length: int) -> Passages:
    """Passages of the texts data[first[k]:first[k + 1]], in order; each start of a string of ``length`` bytes lies in one."""
    width = max(1, 2 * length // 5)
    found: list[tuple[np.ndarray, ...]] = []
    long = np.flatnonzero(np.diff(first) >= length)
    cut = np.flatnonzero(np.diff(np.cumsum(np.diff(first)[long]) // PIECE_BYTES, prepend=-1)) if len(long) else long
    for some in np.split(long, cut[1:]) if len(long) else []:
        at = first[some[0]]
        piece = data[at:first[some[-1] + 1]]
        hashed = RangeHash(piece)
        gram = hashed.every(width)
        key = ((gram >> POSITION_BITS) << POSITION_BITS) | np.arange(len(gram), dtype=U)
        least = (_window_least(key, length - width + 1) & ((U(1) << POSITION_BITS) - U(1))).astype(np.int64)
        starts = np.zeros(len(least) + 1, np.int64)
        np.add.at(starts, first[some] - at, 1)
        np.add.at(starts, first[some + 1] - at - length + 1, -1)
        start = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
        chosen = least[start]
        new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)]))
        begin, end = start[new], start[np.append(new[1:], len(start)) - 1] + length
        found.append((begin + at, end + at, gram[chosen[new]], hashed(begin, end)))
    columns = [np.concatenate([f[k] for f in found]) if found else np.empty(0, U if k > 1 else np.int64) for k in range(4)]
    return Passages(*columns)


def _cell(gram: np.ndarray, cells: int) -> np.ndarray:
    return ((_mix(gram) >> U(32)) % U(cells)).astype(np.int64)


def _singly(data: np.ndarray, found: Passages, hot: np.ndarray, length: int) -> Passages:
    """``found`` with the passages of hot cells cut into their strings (whose gram is the string)."""
    if not hot.any():
        return found
    begin, end = found.begin[hot], found.end[hot]
    count = end - begin - length + 1
    start = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
    string = np.empty(len(start), U)
    for a in range(0, len(start), PIECE_BYTES):
        part = start[a:a + PIECE_BYTES]
        at = part[0]
        string[a:a + PIECE_BYTES] = RangeHash(data[at:part[-1] + length])(part - at, part - at + length)
    cold = ~hot
    joined = [np.concatenate([x[cold], y]) for x, y in zip((found.begin, found.end, found.gram, found.whole),
                                                           (start, start + length, _mix(string + U(1)), string))]
    order = np.argsort(joined[0], kind="stable")
    return Passages(*(x[order] for x in joined))


def _firsts(found: Passages) -> np.ndarray:
    """Which passages are the first with their gram and bytes."""
    order = np.lexsort((np.arange(len(found.gram)), found.whole, found.gram))
    new = np.ones(len(order), bool)
    new[1:] = (found.gram[order][1:] != found.gram[order][:-1]) | (found.whole[order][1:] != found.whole[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[new]] = True
    return out


# ------------------------------------------------------------ blocks

def _ids(block: pa.Table) -> np.ndarray:
    return block.column("doc_id").combine_chunks().fill_null(NULL_ID).to_numpy()


class Block:
    """A block file: rows in order of id, null ids last."""

    def __init__(self, folder: str, name: str):
        fs, path = open_folder(folder)
        with fs.open_input_file(f"{path}/{name}") as source:
            self.rows = pa.ipc.open_file(source).read_all()
        texts = self.rows.column("text").combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        self.first = offsets.astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2], np.uint8) if self.first[-1] else np.empty(0, np.uint8)


def _write_block(folder: str, name: str, batch: pa.RecordBatch) -> None:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches([batch]).set_column(1, "text", batch.column(1).cast(pa.binary())).combine_chunks()
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table, max_chunksize=len(table) or 1)
    write_atomically(folder, name, iter([sink.getvalue().to_pybytes()]))


def _blocks(docs: DataFrame, folder: str, length: int, cells: int) -> DataFrame:
    """Writes the block files; rows (file, null, null) for each, and (null, cell, passages in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        place, count = TaskContext.get().partitionId() << 31, {}
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, [("doc_id", "ascending")], null_placement="at_end"))
            for at, n in byte_slices(batch.column(1), BLOCK_BYTES):
                name = f"{place:016x}-{uuid.uuid4().hex}"
                _write_block(folder, name, batch.slice(at, n))
                block = Block(folder, name)
                cell, times = np.unique(_cell(passages(block.data, block.first, length).gram, cells), return_counts=True)
                for c, k in zip(cell.tolist(), times.tolist()):
                    count[c] = count.get(c, 0) + k
                yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "cell": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64())})
                place += 1
        if count:
            yield pa.RecordBatch.from_pydict({"file": pa.nulls(len(count), pa.string()), "cell": pa.array(list(count), pa.int64()),
                                              "n": pa.array(list(count.values()), pa.int64())})

    return arrow_map(docs, run, "file string, cell long, n long")


def _hot(grams: np.ndarray, hot_cells: np.ndarray, cells: int) -> np.ndarray:
    return np.isin(_cell(grams, cells), hot_cells)


def _posted(files: DataFrame, folder: str, length: int, shards: int, cells: int, hot_cells: list[int]) -> DataFrame:
    """(shard, file, packed passages of the block in it)."""
    hot_cells = np.array(sorted(hot_cells), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                block = Block(folder, name)
                found = passages(block.data, block.first, length)
                found = _singly(block.data, found, _hot(found.gram, hot_cells, cells), length)
                one = np.flatnonzero(_firsts(found))
                shard = (_mix(found.gram[one]) % U(shards)).astype(np.int64)
                one = one[np.argsort(shard, kind="stable")]
                shard = np.sort(shard)
                doc = _ids(block.rows)[np.searchsorted(block.first, found.begin[one], "right") - 1]
                edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
                rows = []
                for a, b in zip(edge, [*edge[1:], len(one)]):
                    part = one[a:b]
                    rows.append((int(shard[a]), name, found.gram[part].tobytes(), found.whole[part].tobytes(),
                                 np.diff(doc[a:b], prepend=0).tobytes(), np.diff(found.begin[part], prepend=0).astype("<i4").tobytes(),
                                 (found.end - found.begin)[part].astype("<u2").tobytes()))
                for a in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a:a + 256])], schema=pa.schema(
                        [("shard", pa.int64()), ("file", pa.string()), *((c, pa.binary()) for c in ("gram", "whole", "doc", "begin", "size"))]))

    return arrow_map(files, run, "shard long, file string, gram binary, whole binary, doc binary, begin binary, size binary")


RANGES = "file string, shard long, begin binary, size binary"


def _ranges(name: list[str], shard: list[int | None], begin: list[np.ndarray], size: list[np.ndarray]) -> pa.Table:
    return pa.table({"file": pa.array(name, pa.string()), "shard": pa.array(shard, pa.int64()),
                     "begin": pa.array([np.asarray(b).astype("<i4").tobytes() for b in begin], pa.binary()),
                     "size": pa.array([np.asarray(s).astype("<i4").tobytes() for s in size], pa.binary())})


def _by_file(files: list[str], of: np.ndarray, shard: int | None, begin: np.ndarray, size: np.ndarray) -> pa.Table:
    order = np.lexsort((begin, of))
    of, begin, size = of[order], begin[order], size[order]
    held, edge = np.unique(of, return_index=True)
    return _ranges([files[f] for f in held], [shard] * len(held), np.split(begin, edge[1:]) if len(held) else [],
                   np.split(size, edge[1:]) if len(held) else [])


def _judged(rows: pa.Table) -> pa.Table:
    """One shard: ranges of passages that repeat an earlier identical one (shard null), and of those whose text is wanted."""
    shard = rows.column("shard")[0].as_py()
    rows = rows.sort_by("file")
    files = rows.column("file").to_pylist()
    read = lambda name, kind: [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
    gram, whole = np.concatenate(read("gram", "<u8")), np.concatenate(read("whole", "<u8"))
    of = np.repeat(np.arange(len(files)), [len(x) for x in read("size", "<u2")])
    doc = np.concatenate([np.cumsum(x) for x in read("doc", "<i8")])
    begin = np.concatenate([np.cumsum(x.astype(np.int64)) for x in read("begin", "<i4")])
    size = np.concatenate(read("size", "<u2")).astype(np.int64)
    order = np.lexsort((begin, of, doc, whole, gram))
    gram, whole = gram[order], whole[order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    first = new_gram | np.concatenate([[True], whole[1:] != whole[:-1]])
    kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_gram))
    several = np.repeat(kinds > 1, np.diff(np.append(np.flatnonzero(new_gram), len(gram))))
    out = []
    for which, to in ((~first, None), (first & several, shard)):
        at = order[which]
        out.append(_by_file(files, of[at], to, begin[at], size[at]))
    return pa.concat_tables(out)


def _fetched(folder: str):
    def run(rows: pa.Table) -> pa.Table:
        """The wanted text of one block, by shard."""
        name = rows.column("file")[0].as_py()
        block = Block(folder, name)
        ids = _ids(block.rows)
        texts, docs = [], []
        for begin, size in zip(rows.column("begin").to_pylist(), rows.column("size").to_pylist()):
            begin, size = np.frombuffer(begin, "<i4").astype(np.int64), np.frombuffer(size, "<i4").astype(np.int64)
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            texts.append(block.data[at].tobytes())
            docs.append(ids[np.searchsorted(block.first, begin, "right") - 1].tobytes())
        return rows.select(["shard", "file", "begin", "size"]).append_column("doc", pa.array(docs, pa.binary())) \
            .append_column("text", pa.array(texts, pa.binary()))

    return run


def repeats_in(snippets: np.ndarray, size: np.ndarray, length: int, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of the strings of ``length`` bytes that occur more than once in the joined snippets, sorted by string."""
    first = np.cumsum(size + 1) - size - 1
    text = np.ones(int(size.sum()) + len(size) + 1, np.int32)  # 0 ends the text, 1 a snippet, bytes from 2
    text[-1] = 0
    inside = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    text[inside] = snippets.astype(np.int32) + 2
    starts = np.zeros(len(text) + 1, np.int32)
    room = size >= length
    starts[first[room]] += 1
    starts[(first + size - length + 1)[room]] -= 1
    valid = np.cumsum(starts) > 0
    group, start, at = [], [], 0
    last: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
    for suffix, shared in sort_suffixes(text, 258, disk).drain():
        number = at + np.cumsum(shared < length)
        at = int(number[-1])
        keep = valid[suffix]
        # a string may go on in the next block: its starts so far wait
        number, suffix = np.concatenate([last[0], number[keep]]), np.concatenate([last[1], suffix[keep]])
        wait = number == at
        last = number[wait], suffix[wait]
        for n, s in ((number[~wait], suffix[~wait]),):
            edge = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.empty(0, np.int64)
            many = np.repeat(np.diff(np.append(edge, len(n))) > 1, np.diff(np.append(edge, len(n))))
            group.append(n[many])
            start.append(s[many])
    if len(last[0]) > 1:
        group.append(last[0])
        start.append(last[1])
    start = np.concatenate(start) if start else np.empty(0, np.int64)
    place = np.searchsorted(first, start, "right") - 1
    return np.concatenate(group) if group else start, start - place  # without the marks between snippets


def _sorted_shard(folder: str, length: int, memory: int):
    def run(rows: pa.Table) -> pa.Table:
        """One shard: ranges of the starts of strings that start earlier in another passage."""
        rows = rows.sort_by("file")
        files = rows.column("file").to_pylist()
        read = lambda name, kind: [np.frombuffer(x, kind).astype(np.int64) for x in rows.column(name).to_pylist()]
        begins, sizes, docs = read("begin", "<i4"), np.concatenate(read("size", "<i4")), np.concatenate(read("doc", "<i8"))
        of = np.repeat(np.arange(len(files)), [len(b) for b in begins])
        begins = np.concatenate(begins)
        disk = Disk(folder, memory)
        string, start = repeats_in(np.frombuffer(b"".join(rows.column("text").to_pylist()), np.uint8), sizes, length, disk)
        disk.close()
        edge = np.cumsum(sizes) - sizes
        snippet = np.searchsorted(edge, start, "right") - 1
        place = begins[snippet] + start - edge[snippet]
        order = np.lexsort((place, of[snippet], docs[snippet], string))
        later = np.zeros(len(order), bool)
        later[1:] = string[order][1:] == string[order][:-1]
        later = order[later]
        file, place = of[snippet][later], place[later]
        order = np.lexsort((place, file))
        file, place = file[order], place[order]
        if not len(file):
            return _ranges([], [], [], [])
        new = np.flatnonzero(np.concatenate([[True], (file[1:] != file[:-1]) | (place[1:] > place[:-1] + 1)]))
        last = np.append(new[1:], len(file)) - 1
        return _by_file(files, file[new], None, place[new], place[last] - place[new] + length)

    return run


def _assembled(folder: str, length: int, cells: int, hot_cells: list[int]):
    hot_cells = np.array(sorted(hot_cells), np.int64)

    def run(rows: pa.Table) -> pa.Table:
        """The documents of one block without the bytes that its ranges cover."""
        release()
        block = Block(folder, rows.column("file")[0].as_py())
        n = len(block.data)
        step = np.zeros(n + 1, np.int32)

        def cover(begin: np.ndarray, end: np.ndarray) -> None:
            np.add.at(step, begin, 1)
            np.add.at(step, end, -1)

        for begin, size in zip(rows.column("begin").to_pylist(), rows.column("size").to_pylist()):
            if begin:
                begin = np.frombuffer(begin, "<i4").astype(np.int64)
                cover(begin, begin + np.frombuffer(size, "<i4"))
        found = passages(block.data, block.first, length)
        found = _singly(block.data, found, _hot(found.gram, hot_cells, cells), length)
        again = ~_firsts(found)
        cover(found.begin[again], found.end[again])
        gone = np.cumsum(step[:-1]) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        heads = block.first[:-1][block.first[:-1] < n]
        edge[heads] = gone[heads]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.first])
        kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.first, block.first[1:])]
        return pa.table({"doc_id": block.rows.column("doc_id"), "n_bytes": pa.array(np.diff(block.first)), "n_removed": pa.array(total(gone)),
                         "n_spans": pa.array(total(edge)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                         "kept": pa.array(kept, pa.binary())})

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes).

    Texts are UTF-8 bytes, null counts as empty; texts shorter than
    ``length`` stay as they are.  Rows with a null id come after all others;
    rows that repeat an id are in the order in which the table is read.
    Other columns change nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    n_bytes = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, -(-n_bytes // shard_bytes))
    cells = CELLS * shards
    folder = scratch_folder(spark, "suffix-blocks")
    written = stored(_blocks(plain, folder, length, cells), "suffix-manifest")
    files = written.where("file IS NOT NULL").select("file")
    counts = written.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most 2 x shards cells hold half of a shard's passages
    hot = [r[0] for r in counts.where(F.col("n") > max(1000, total // (2 * shards))).select("cell").collect()]
    posted = _posted(files.repartition(max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))),
                     folder, length, shards, cells, hot)
    judged = stored(posted.groupBy("shard").applyInArrow(_judged, RANGES), "suffix-passages")
    wanted = judged.where("shard IS NOT NULL").groupBy("file").applyInArrow(_fetched(folder), RANGES + ", doc binary, text binary")
    found = wanted.groupBy("shard").applyInArrow(_sorted_shard(folder, length, memory), RANGES)
    every = judged.where("shard IS NULL").unionByName(found).select("file", "begin", "size") \
        .unionByName(files.select("file", F.lit(None).cast("binary").alias("begin"), F.lit(None).cast("binary").alias("size")))
    return every.groupBy("file").applyInArrow(
        _assembled(folder, length, cells, hot), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
