"""Token ids of whole texts by the tokenizers library, in Arrow batches inside tasks.

A byte-level BPE text can be cut before any single space that is followed by
a non-space: the library's own pre-tokenizer always ends a piece there, so the
ids of the parts joined are the ids of the whole.  Natural text repeats its
words, hence each worker keeps a bounded table of the ids of pieces that it
has encoded; the library encodes every piece that the table lacks.  Whether a
vocabulary file is of that kind is read from its settings; with any other the
library encodes each text whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_slices

VOCABULARY = "byte_bpe_50k.json"
#: Text that is encoded at a time, and pieces that a worker remembers.
SLICE_BYTES = 8_000_000
CACHED_PIECES = 800_000
#: Longer pieces are encoded each time; the table stays small.
CACHED_LENGTH = 48
#: A space before white space or the end: such a text is cut by ``CUT`` instead (RE2 knows ASCII white space only).
ODD_SPACE = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
CUT = re.compile(r"(?= [^\s᠎])")
#: Characters that one call of the library gets of a text with odd spaces.
CHUNK = 100_000


def ends_pieces_at_spaces(tokenizer) -> bool:
    """Whether the ids of a text are those of its parts, cut before single spaces that a non-space follows.

    So it is for BPE behind the byte-level pre-tokenizer with its own pattern
    and without an added space, if nothing rewrites the text first and no
    added token holds white space or takes in what stands beside it.
    """
    spec = json.loads(tokenizer.to_str())
    split = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    whole = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])]
    return plain and byte_level and not whole


class Encoder:
    """Ids of texts under one vocabulary file, special strings inside texts handled as the library's default."""

    #: Pieces that this encoder remembers; none given, ``CACHED_PIECES``.
    most: int | None = None
    #: Whether texts may be cut before spaces (``ends_pieces_at_spaces``).
    by_piece = True

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = ends_pieces_at_spaces(self.tokenizer)
        self.most = self.most or CACHED_PIECES
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.begin = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int64)
        self.used = np.zeros(1 << 14, np.int32)
        self.n_pool = self.n_pieces = 0

    def _shrink(self) -> None:
        """Keep the pieces that were used most often, at most half the table."""
        names, at = list(self.place), np.fromiter(self.place.values(), np.int64, len(self.place))
        used = self.used[at]
        floor = max(2, int(np.partition(used, -self.most // 2)[-self.most // 2]) + 1) if len(at) > self.most // 2 else 2
        stay = np.flatnonzero(used >= floor)
        begin, count, pool = self.begin[at[stay]], self.count[at[stay]], self.pool
        self._forget()
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        self._add([names[i] for i in stay], pool[np.repeat(begin - (ends - count), count) + np.arange(total)], count)
        self.used[:len(stay)] = 1

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _in_chunks(self, text: str) -> np.ndarray:
        """A text with odd spaces: cut before single spaces that a non-space follows, joined to chunks."""
        if len(text) <= CHUNK or not self.by_piece:
            return self._whole(text)
        out, held, n = [], [], 0
        for part in CUT.split(text):
            if held and n + len(part) > CHUNK:
                out.append(self._whole("".join(held)))
                held, n = [], 0
            held.append(part)
            n += len(part)
        out.append(self._whole("".join(held)))
        return np.concatenate(out)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ' ' + piece for each, joined, and their counts.

        They are encoded as one text and told apart by the ids that open with
        a space: a piece holds no space, so only its first id can.
        """
        ids = self._whole(" " + " ".join(pieces))
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(pieces) and starts[0] == 0:
            return ids, np.diff(np.append(starts, len(ids)))
        each = [self._whole(" " + p) for p in pieces]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _add(self, pieces: list[str], ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Append pieces to the table; returns their places.  Long ones get a place but no entry."""
        k, n = self.n_pieces, len(pieces)
        while k + n > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
            self.used = np.concatenate([self.used, np.zeros_like(self.used)])
        while self.n_pool + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.n_pool:self.n_pool + len(ids)] = ids
        self.begin[k:k + n] = self.n_pool + np.cumsum(count) - count
        self.count[k:k + n] = count
        self.n_pool += len(ids)
        self.n_pieces += n
        self.place.update((p, i) for i, p in enumerate(pieces, k) if len(p) <= CACHED_LENGTH)
        return np.arange(k, k + n)

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Place in the table of each distinct piece."""
        at = np.fromiter((self.place.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        for a in range(0, len(new), 1000):
            group = [pieces[i] for i in new[a:a + 1000]]
            at[new[a:a + 1000]] = self._add(group, *self._each(group))
        self.used[at] += 1
        return at

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts without odd spaces: begin and count in the pool of each piece, and pieces per text."""
        lists = pc.split_pattern(texts, " ")
        pieces = lists.flatten()
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.zeros(len(pieces), bool)
        first[np.cumsum(per_text) - per_text] = True
        if self.n_pieces > self.most:
            self._shrink()
        coded = pieces.dictionary_encode()
        where = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        inner = np.zeros(len(distinct), bool)
        inner[where[~first]] = True
        table = np.zeros(len(distinct), np.int64)
        wanted = np.flatnonzero(inner)
        table[wanted] = self._places(distinct[wanted].tolist())
        at = table[where]
        heads = [self._whole(p) for p in pieces.filter(pa.array(first)).to_pylist()]
        at[first] = self._add(["\n" * (CACHED_LENGTH + 1)] * len(heads), np.concatenate(heads),
                              np.array([len(x) for x in heads], np.int64))
        return self.begin[at], self.count[at], per_text

    def _slice(self, texts: pa.Array, lengths_only: bool) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(texts), bool)
        rows = np.arange(len(texts))
        length = np.zeros(len(texts), np.int64)
        own = {int(i): self._in_chunks(texts[int(i)].as_py()) for i in rows[odd]}
        for i, ids in own.items():
            length[i] = len(ids)
        parts: list[np.ndarray] = []
        if not odd.all():
            begin, count, per_text = self._regular(texts.filter(pa.array(~odd)))
            length[~odd] = np.add.reduceat(count, np.cumsum(per_text) - per_text)
            if not lengths_only:
                ends = np.cumsum(count)
                flat = self.pool[np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
                parts = [flat]
        if lengths_only:
            return np.empty(0, np.uint32), length
        if not own:
            return parts[0], length
        if not parts:
            return np.concatenate([own[int(i)] for i in rows]), length
        split = iter(np.split(parts[0], np.cumsum(length[~odd])[:-1]))
        return np.concatenate([own[int(i)] if odd[i] else next(split) for i in rows]), length

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = [self._slice(texts.slice(a, n), True)[1] for a, n in byte_slices(texts, SLICE_BYTES)]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def slices(self, texts: pa.Array):
        """(first row, ids of all rows joined, ids per row) of consecutive runs of rows."""
        for a, n in byte_slices(texts, SLICE_BYTES):
            ids, length = self._slice(texts.slice(a, n), False)
            yield a, ids, length


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The worker's encoder of a vocabulary file, made once per Python worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def release() -> None:
    """Let go of the worker's encoders: another operator runs in this worker now."""
    _ENCODERS.clear()


def text_array(column: pa.Array) -> pa.Array:
    """The whole texts of an Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()).fill_null("")
