"""Personal data in whole texts: base rules, and a trained BiLSTM-CRF that adds spans.

The base spans always stand.  The tagger is trained in one task on a bounded
sample of windows (``MAX_TEXTS``, ``MAX_WINDOWS``) that are labelled with the
base spans, with assigned keys (kind ``secret``) and with rewritten forms of
both.  It then reads every whole text in overlapping windows.  An added span
needs a digit or an @ (an anchor), as the base forms of all four kinds do, so
only windows that hold an anchor or a part of its word are computed; forms
spelled out in words are out of reach.  Where windows overlap, the scores and
probabilities of a character are averaged, weighted by its distance from the
window's edge, and each run of windows is decoded once as a whole with the
learned transitions; a span is added if it is likely enough and touches no
base span.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ship, whole_text
from .pii_model import TAGS, Tagger, char_classes, decode
from .pii_rules import KINDS, LABELS, Span, assigned_keys, base_spans
from .tokens import text_array

WINDOW, STRIDE = 64, 32
MAX_TEXTS, MAX_WINDOWS = 1_500, 3_000
#: Mean probability that an added span needs, and its least length.
LIKELY, LEAST_LENGTH = 0.95, 6
ANCHOR = re.compile(r"[0-9@]")
ANCHORED = r"[0-9@]"
WORD = re.compile(r"\S+")
#: Marks around a value that are no part of it.
QUOTES = "\"'"
RUN_AT_ONCE = 2_048


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold an anchor or a part of an anchor's word, from the white space before it to the one after.

    The grid is fixed, every character lies in two windows but at the ends.
    """
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out: list[int] = []
    begin = end = 0
    for m in ANCHOR.finditer(text):
        at = m.start()
        if at >= end:
            begin, end = at, WORD.match(text, at).end()
            while begin > 0 and not text[begin - 1].isspace():
                begin -= 1
        for k in range(max(0, min(at // STRIDE - 1, (begin - 1) // STRIDE), out[-1] + 1 if out else 0),
                       min(last, max(at, end - 1) // STRIDE) + 1):
            out.append(k)
    return [k * STRIDE for k in out]


def _tags(n: int, spans: list[list[Span]]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, found in enumerate(spans):
        for a, b in found:
            if not tags[a:b].any():
                tags[a:b] = 2 + 2 * kind
                tags[a] = 1 + 2 * kind
    return tags


def _rewritten(text: str, spans: list[list[Span]]) -> Iterator[tuple[str, list[list[Span]]]]:
    """Forms that the rules miss: a phone number without its +1, a card number with dots, an e-mail address around [@],
    an IP address around [.], a key in capitals or without quotes."""
    for kind, found in enumerate(spans):
        for a, b in found:
            old = text[a:b]
            new = {"phone": re.sub(r"^\+[0-9]+ ?", "", old), "email": old.replace("@", "[@]", 1), "secret": old.upper(),
                   "card": ".".join(re.findall(r"[0-9]{1,4}", re.sub(r"[ -]", "", old))), "ip": old.replace(".", "[.]")}[LABELS[kind]]
            left, right = text[max(0, a - 24 - a % STRIDE):a], text[b:b + 40]  # so that forms lie at every offset of the grid
            forms = [(left, new, right)] if new and new != old else []
            if LABELS[kind] == "secret":
                forms.append((left.rstrip("\"'") + " " * left.endswith(("=\"", "='")), old, right.lstrip("\"'")))
            for left, new, right in forms:
                yield left + new + right, [[(len(left), len(left) + len(new))] if k == kind else [] for k in range(len(LABELS))]


def training_windows(text: str) -> list[tuple[str, bytes]]:
    """(window, tags) of a text, on the grid of ``window_starts``, and of rewritten forms of its spans."""
    spans = [*base_spans(text), assigned_keys(text)]
    out = []
    for piece, found in [(text, spans), *_rewritten(text, spans)]:
        tags = _tags(len(piece), found)
        for a in window_starts(piece):
            cut = tags[a:a + WINDOW]
            # a span that the window's edge cuts goes on as inside: what precedes the window is not seen
            out.append((piece[a:a + WINDOW], cut.astype(np.int8).tobytes()))
    return out


def fit(docs: DataFrame, text_col: str = "text", seed: int = 0) -> Tagger | None:
    """A tagger trained on windows of the ``MAX_TEXTS`` texts of least hash; None if no text holds an anchor."""
    texts = docs.select(whole_text(text_col).alias("text")).where(F.col("text").rlike(ANCHORED)) \
        .withColumn("hash", F.xxhash64("text", F.lit(seed)))
    least = texts.select("hash").distinct().orderBy("hash").limit(MAX_TEXTS).agg(F.max("hash")).first()[0]
    if least is None:
        return None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = training_windows(text)
                yield pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in rows], pa.string()),
                                                  "tags": pa.array([t for _, t in rows], pa.binary())})

    sample = arrow_map(texts.where(F.col("hash") <= least).select("text"), windows, "window string, tags binary").distinct() \
        .orderBy(F.xxhash64("window", "tags"), "window").limit(MAX_WINDOWS)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if rows:
            chars, tags = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
            for i, (window, marks) in enumerate(rows):
                chars[i, :len(window)] = char_classes(window)
                tags[i, :len(marks)] = np.frombuffer(marks, np.int8)
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(Tagger(seed).train(chars, tags, seed))], pa.binary())})

    return pickle.loads(arrow_map(sample, train, "model binary").first()["model"])


def _weight() -> np.ndarray:
    at = np.arange(WINDOW)
    return (np.minimum(at, WINDOW - 1 - at) + 1).astype(np.float32)


def likely_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, probability) of the spans that the tagger sees in each text."""
    places = [(i, a) for i, text in enumerate(texts) for a in window_starts(text)]
    classes = {i: char_classes(texts[i]) for i in {i for i, _ in places}}
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    weight = _weight()
    run: list[tuple[int, np.ndarray, np.ndarray]] = []
    owner = -1

    def close() -> None:
        if not run:
            return
        begin, end = run[0][0], min(run[-1][0] + WINDOW, len(texts[owner]))
        total, mass = np.zeros((2, end - begin, TAGS), np.float32), np.zeros((end - begin, 1), np.float32)
        for a, *read in run:
            n = min(WINDOW, end - a)
            for k in range(2):
                total[k, a - begin:a - begin + n] += read[k][:n] * weight[:n, None]
            mass[a - begin:a - begin + n, 0] += weight[:n]
        mean, score = total / mass
        if (mean[:, 0] < 0.5).any():
            out[owner].extend(_spans(decode(score, model.ok, model.p["trans"]), mean, begin))
        run.clear()

    for b in range(0, len(places), RUN_AT_ONCE):
        group = places[b:b + RUN_AT_ONCE]
        chars = np.zeros((len(group), WINDOW), np.int64)
        for k, (i, a) in enumerate(group):
            piece = classes[i][a:a + WINDOW]
            chars[k, :len(piece)] = piece
        for (i, a), marginal, score in zip(group, *model.read(chars)):
            if i != owner or (run and a > run[-1][0] + WINDOW):
                close()
                owner = i
            run.append((a, marginal, score))
    close()
    return out


def _spans(tags: np.ndarray, mean: np.ndarray, offset: int) -> Iterator[tuple[int, int, int, float]]:
    begins = np.flatnonzero(tags % 2 == 1)
    for a in begins.tolist():
        kind, b = (int(tags[a]) - 1) // 2, a + 1
        while b < len(tags) and tags[b] == 2 + 2 * kind:
            b += 1
        share = mean[a:b, 1 + 2 * kind] + mean[a:b, 2 + 2 * kind]
        yield kind, offset + a, offset + b, float(share.mean())


def added_spans(text: str, base: list[list[Span]], seen: list[tuple[int, int, int, float]]) -> list[list[Span]]:
    """The likely spans, without white space and quotes around them, that touch no base span, hold an anchor and are long enough."""
    taken = sorted(s for kind in base for s in kind)
    out: list[list[Span]] = [[] for _ in LABELS]
    for kind, a, b, sure in seen:
        while a < b and (text[a].isspace() or text[a] in QUOTES):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in QUOTES):
            b -= 1
        if sure >= LIKELY and b - a >= LEAST_LENGTH and ANCHOR.search(text, a, b) and not any(x < b and a < y for x, y in taken):
            out[kind].append((a, b))
    return out


def _joined(spans: list[list[Span]]) -> str:
    return ",".join(f"{LABELS[k]}:{a}:{b}" for k, found in enumerate(spans) for a, b in sorted(found))


def find_personal_data(docs: DataFrame, model: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (base and added), n_added, n_secret
    (of the added ones, keys), n_spans (all).

    Null and empty texts hold nothing; repeated rows and null ids keep their
    rows; other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    nothing = hashlib.sha256(b"").hexdigest()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            n = batch.num_rows
            counts, digests, spans, added = np.zeros((n, len(KINDS)), np.int64), [nothing] * n, [""] * n, np.zeros((2, n), np.int64)
            held = np.flatnonzero(pc.match_substring_regex(texts, ANCHORED).to_numpy(zero_copy_only=False))
            for a in range(0, len(held), 200):
                rows = held[a:a + 200]
                some = texts.take(pa.array(rows)).to_pylist()
                seen = likely_spans(some, shared.value) if shared.value else [[] for _ in some]
                for i, text, likely in zip(rows.tolist(), some, seen):
                    base = base_spans(text)
                    more = added_spans(text, base, likely)
                    counts[i] = [len(x) for x in base]
                    added[:, i] = sum(map(len, more)), len(more[-1])
                    digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[i] = _joined([x + y for x, y in zip([*base, []], more)])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{f"n_{k}": counts[:, j] for j, k in enumerate(KINDS)},
                                              "base_sha256": digests, "spans": spans, "n_added": added[0], "n_secret": added[1],
                                              "n_spans": counts.sum(axis=1) + added[0]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return arrow_map(rows, find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
                     "n_added long, n_secret long, n_spans long")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return find_personal_data(docs, fit(docs, text_col), id_col, text_col)
