"""Alignment of two tokenizers' token sequences over the same text, by lockstep vectorised merging.

Both encodings of a text cover the same bytes, so a merge of their token ends
finds the offsets where tokens of both end.  All documents of a block merge at
once: one NumPy state holds a pointer into A's and one into B's tokens for
every lane, each step advances the pointer whose token ends first (both where
they end together, which is a link and a cut), and finished lanes are
compacted away.  A lane is a document; long documents are several lanes, split
at white space where both tokenizers begin a token, so one long document does
not keep the loop busy alone.

The block also yields its distinct linked id pairs with their counts.  Blocks
are stored in the shared folder, the pair counts are summed over the corpus as
a Spark aggregation, and each block gets the totals of its own pairs back:
what moves is the distinct pairs of a block, never a row per link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, ship, stored
from .tokens import VOCABULARY, Encoder, release, text_array

MODEL = "piece_bpe_32k.model"
#: Text of a block, and A tokens of a lane (about: lanes end before a word).
BLOCK_BYTES, LANE_TOKENS = 2_000_000, 256
#: Pieces that each of the two encoders remembers.
PIECES = 200_000
SPACE = "▁"


class PlainEncoder(Encoder):
    """Ids under a byte-level vocabulary; the strings of special tokens inside texts are plain text."""

    most = PIECES

    def __init__(self, vocabulary: str = VOCABULARY):
        super().__init__(vocabulary)
        self.tokenizer.encode_special_tokens = True
        # byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ... in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        names = [self.tokenizer.id_to_token(i) or "" for i in range(len(self.opens))]
        self.token_bytes = np.empty(len(names), object)
        self.token_bytes[:] = [bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode() for name in names]


class PieceEncoder(Encoder):
    """Ids under a sentencepiece model of texts that open with the space which the model adds itself."""

    most = PIECES

    def __init__(self, model: str = MODEL):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.opens = np.array([n.startswith(SPACE) for n in names])
        self.token_bytes = np.empty(len(names), object)
        self.token_bytes[:] = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode()
                               for i, n in enumerate(names)]
        self._forget()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text[1:], num_threads=1) if text else [], np.uint32)

    def _in_chunks(self, text: str) -> np.ndarray:
        return self._whole(text)  # runs of spaces are pieces of the model, so such texts are not cut


_PAIRS: dict[tuple[str, str], tuple[PlainEncoder, PieceEncoder]] = {}


def encoders(vocabulary: str = VOCABULARY, model: str = MODEL) -> tuple[PlainEncoder, PieceEncoder]:
    """The worker's two encoders, made once per Python worker."""
    if (vocabulary, model) not in _PAIRS:
        release()
        _PAIRS[vocabulary, model] = PlainEncoder(vocabulary), PieceEncoder(model)
    return _PAIRS[vocabulary, model]


@dataclass
class Side:
    """Tokens of a block under one tokenizer: ids, ends in bytes of the block, and first token of each document (and the end)."""

    ids: np.ndarray
    end: np.ndarray
    first: np.ndarray


def _encode(encoder: Encoder, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = list(encoder.slices(spaced))
    if not parts:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _same_bytes(encoder: Encoder, ids: np.ndarray, count: np.ndarray, spaced: pa.Array) -> np.ndarray:
    """Whether the bytes of each document's tokens are its text's."""
    pieces = encoder.token_bytes[ids].tolist()
    at = np.concatenate([[0], np.cumsum(count)])
    return np.array([b"".join(pieces[at[k]:at[k + 1]]) == text.as_buffer().to_pybytes() for k, text in enumerate(spaced)], bool)


def encode_both(texts: pa.Array, a: PlainEncoder, b: PieceEncoder) -> tuple[np.ndarray, Side, Side]:
    """(rows with tokens, their A side, their B side): empty texts and texts whose token bytes differ have none."""
    rows = np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    spaced = pc.binary_join_element_wise(" ", texts.take(pa.array(rows)), "")
    coded = [_encode(a, spaced), _encode(b, spaced)]
    same = _same_bytes(a, *coded[0], spaced) & _same_bytes(b, *coded[1], spaced)
    sides = []
    for encoder, (ids, count) in zip((a, b), coded):
        ids = ids[np.repeat(same, count)].astype(np.int64)
        width = np.array([len(x) for x in encoder.token_bytes], np.int64)
        sides.append(Side(ids, np.cumsum(width[ids]), np.concatenate([[0], np.cumsum(count[same])])))
    return rows[same], *sides


def lanes(a: Side, b: Side, opens: np.ndarray, lane_tokens: int = LANE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of each lane: documents, and within them words that both tokenizers begin with a token."""
    word = np.flatnonzero(opens[a.ids])
    near = np.searchsorted(word, np.arange(lane_tokens, len(a.ids), lane_tokens))
    at = np.unique(word[near[near < len(word)]])
    at = at[at > 0]
    before = np.searchsorted(b.end, a.end[at - 1])
    both = (before < len(b.end)) & (b.end[np.minimum(before, len(b.end) - 1)] == a.end[at - 1]) if len(b.end) else np.zeros(len(at), bool)
    start = np.unique(np.concatenate([np.stack([a.first[:-1], b.first[:-1]], 1), np.stack([at[both], before[both] + 1], 1)]), axis=0)
    return start[:, 0], start[:, 1]


def lockstep(a: Side, b: Side, opens: np.ndarray, lane_tokens: int = LANE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Links as (A token, B token), ascending: the tokens that end together, each the last of its group."""
    i, j = lanes(a, b, opens, lane_tokens)
    stop = np.append(i[1:], len(a.ids))
    mate = np.full(len(a.ids), -1, np.int64)
    while len(i):
        end_a, end_b = a.end[i], b.end[j]
        together = end_a == end_b
        mate[i[together]] = j[together]  # a link, and a cut behind it
        i = i + (end_a <= end_b)
        j = j + (end_b <= end_a)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    link = np.flatnonzero(mate >= 0)
    return link, mate[link]


def group_digests(a: Side, b: Side, link_a: np.ndarray, link_b: np.ndarray, names: list[np.ndarray]) -> list[str]:
    """SHA-256 of each document's groups, "a1,a2|b1;a3|b2,b3"; ``names`` has the ids' digits with , and | and , and ; behind."""
    last_a, last_b = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    last_a[link_a], last_b[link_b] = True, True
    before = np.concatenate([[0], link_b + 1])  # B tokens of the groups before each one
    upto = link_a + 1  # A tokens of the groups up to each one
    text = np.empty(len(a.ids) + len(b.ids), object)
    text[np.arange(len(a.ids)) + before[np.cumsum(last_a) - last_a]] = np.where(last_a, names[1][a.ids], names[0][a.ids])
    text[np.arange(len(b.ids)) + upto[np.cumsum(last_b) - last_b]] = np.where(last_b, names[2][b.ids], names[0][b.ids])
    edge = (a.first + b.first).tolist()
    text = text.tolist()
    return [hashlib.sha256(b"".join(text[x:y])[:-1]).hexdigest() for x, y in zip(edge, edge[1:])]


def _names(size: int) -> list[np.ndarray]:
    out = []
    for mark in ",|;":
        table = np.empty(size, object)
        table[:] = [f"{i}{mark}".encode() for i in range(size)]
        out.append(table)
    return out


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """Per row: doc_id, a_ids, b_ids, and a_last, b_last: positions of the last token of each group, whose pairs are the links.

    Null and empty texts, and texts that the token bytes do not give back,
    have empty lists.  Repeated rows and null ids keep their rows, other
    columns change nothing, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_enc, b_enc = encoders(vocabulary, model)
        for batch in batches:
            texts = text_array(batch.column(1))
            for at, n in byte_slices(texts, BLOCK_BYTES):
                rows, a, b = encode_both(texts.slice(at, n), a_enc, b_enc)
                link_a, link_b = lockstep(a, b, a_enc.opens)
                cut = np.searchsorted(link_a, a.first)
                lists: list[list[np.ndarray]] = [[np.empty(0, np.int32)] * n for _ in range(4)]
                for k, r in enumerate(rows):
                    inside = slice(cut[k], cut[k + 1])
                    found = (a.ids[a.first[k]:a.first[k + 1]], b.ids[b.first[k]:b.first[k + 1]],
                             link_a[inside] - a.first[k], link_b[inside] - b.first[k])
                    for column, values in zip(lists, found):
                        column[r] = values.astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(x, pa.list_(pa.int32())) for x in lists)],
                                                 names=["doc_id", "a_ids", "b_ids", "a_last", "b_last"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
                     "doc_id long, a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")


BLOCKS = ("block long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, links array<int>, "
          "pair_at int, pair long, pair_n long")


def _blocks(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Rows of documents (``links``: places in the block's pair list) and of pairs (``pair`` = A id x 2^32 + B id), by block."""
    types = [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
             ("groups_sha256", pa.string()), ("links", pa.list_(pa.int32())), ("pair_at", pa.int32()), ("pair", pa.int64()), ("pair_n", pa.int64())]

    def filled(n: int, **given: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given.get(name, pa.nulls(n, kind)) for name, kind in types], names=[t[0] for t in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_enc, b_enc = encoders(vocabulary, model)
        names = _names(max(len(a_enc.opens), len(b_enc.opens)))
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_array(batch.column(1))
            for at, n in byte_slices(texts, BLOCK_BYTES):
                rows, a, b = encode_both(texts.slice(at, n), a_enc, b_enc)
                link_a, link_b = lockstep(a, b, a_enc.opens)
                pair, place, times = np.unique(a.ids[link_a] << 32 | b.ids[link_b], return_inverse=True, return_counts=True)
                cut = np.searchsorted(link_a, a.first)
                counts = np.zeros((3, n), np.int64)
                counts[:, rows] = np.diff(a.first), np.diff(b.first), np.diff(cut)
                digest = [""] * n
                for r, d in zip(rows, group_digests(a, b, link_a, link_b, names)):
                    digest[r] = d
                edges = np.concatenate([[0], np.cumsum(counts[2])]).astype(np.int32)
                yield filled(n, block=pa.array(np.full(n, block)), doc_id=batch.column(0).slice(at, n), n_a=pa.array(counts[0]),
                             n_b=pa.array(counts[1]), n_links=pa.array(counts[2]), groups_sha256=pa.array(digest),
                             links=pa.ListArray.from_arrays(pa.array(edges), pa.array(place.astype(np.int32))))
                if len(pair):
                    yield filled(len(pair), block=pa.array(np.full(len(pair), block)), pair_at=pa.array(np.arange(len(pair), dtype=np.int32)),
                                 pair=pa.array(pair), pair_n=pa.array(times))
                block += 1

    return arrow_map(docs, run, BLOCKS)


def _with_totals(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """One block: the documents' sums over the corpus counts of their links."""
    count = np.zeros(pairs.num_rows + 1, np.int64)
    best = np.zeros(pairs.num_rows + 1, np.int64)
    at = pairs.column("pair_at").to_numpy()
    count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy().astype(np.int64)
    links = docs.column("links").combine_chunks()
    place = links.flatten().to_numpy()
    row = np.repeat(np.arange(docs.num_rows), pc.list_value_length(links).to_numpy())
    sums = []
    for value in (best, count):
        total = np.concatenate([[0], np.cumsum(value[place])])
        edge = np.searchsorted(row, np.arange(docs.num_rows + 1))
        sums.append(pa.array(total[edge[1:]] - total[edge[:-1]]))
    n_links = docs.column("n_links")
    return pa.table([docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), n_links, n_links, *sums, docs.column("groups_sha256")],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus, and whether no pair with the same B id has more."""
    counts = blocks.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("pair_n").alias("count")) \
        .withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, model: str = MODEL) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Every link joins the two tokens that end at one offset, so there are as
    many links as groups.  Null and empty texts, and texts that the token
    bytes do not give back, have zeros and the empty string, and add nothing
    to the counts.  Repeated rows each keep their row and count each; null ids
    and other columns change nothing; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(_blocks(plain, vocabulary, model), "alignment-blocks")
    pairs = blocks.where("pair IS NOT NULL").select(F.col("block").alias("in_block"), "pair_at", "pair") \
        .join(pair_counts(blocks), "pair").select("in_block", "pair_at", "count", "best")
    rows = blocks.where("pair IS NULL").select("block", "doc_id", "n_a", "n_b", "n_links", "groups_sha256", "links")
    return rows.groupBy("block").cogroup(pairs.groupBy("in_block")).applyInArrow(
        _with_totals, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
