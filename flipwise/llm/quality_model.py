"""Ordinal cumulative-link regression on graded ratings over hashed text.

Grades are 0 .. K-1.  One weight vector over hashed features of the text is
shared by all grades, and ordered thresholds cut its score s:

    P(grade <= k) = 1 / (1 + exp(s - threshold_k))

Hence each text gets an expected grade, and a tail probability P(grade >= k)
for selection.  The model is fitted in one task on a bounded sample of
labelled rows (``MAX_LABELLED``, those with the smallest seeded hash of the
id), so the driver only sees its weights; every text is scored, whole, in
Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, free_name, row_of, ship, whole_text
from .tokens import release, text_array

#: Labelled rows that the fit takes at most.
MAX_LABELLED = 16_000
#: Hash space of the features; features that fewer labelled texts have are left out.
DIMENSIONS, LEAST_TEXTS, LEAST_SHARE = 1 << 20, 4, 0.0005
#: Rows of a grade count (rows / grades / rows of the grade) ** BALANCE times: 0 as they come, 1 all grades alike.
BALANCE = 0.5
#: A word's value is tf / (tf + words / HALF): half of 1 where one word in HALF is this one.
HALF = 200.0
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
#: Sparsity: a weight stays 0 until its gradient exceeds so many times sqrt(texts with the feature) / texts, the size of chance.
SPARSITY = 0.4
SLICE_BYTES = 4_000_000
EDGE = "\"'.,;:!?()[]{}<>|/\\*#$%&+-=_~`^@"


def _code(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % DIMENSIONS


def word_features(word: str) -> tuple[int, int, int]:
    """Hashes of a word's core, of the marks around it, and of its shape."""
    core = word.strip(EDGE)
    marks = word.replace(core, " ", 1) if core else word
    shape = "upper" if len(core) > 1 and core.isupper() else "digit" if any(c.isdigit() for c in core) else "plain" if core else "none"
    return _code("w" + core.lower()), _code("m" + marks), _code("s" + shape)


def _bucket(value: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), value, "right")


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the slice; (text, word, value) triples; per text: hashes of its length and repetition, and whether it has words."""
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    row = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    words = split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(real)).dictionary_encode()
    row = row[real]
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    size = max(1, len(distinct))
    count = np.bincount(row, minlength=n)
    pairs, tf = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    at, word = pairs // size, pairs % size
    value = tf / (tf + count[at] / HALF)
    kinds = np.bincount(at, minlength=n)
    variety = kinds / np.maximum(count, 1)
    length = _bucket(count, [1, 20, 50, 100, 200, 500, 1000, 5000])
    spread = _bucket(variety, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
    whole = np.array([[_code(f"l{a}"), _code(f"v{a}:{b}")] for a, b in zip(length, spread)], np.int64).reshape(n, 2)
    return distinct, at, word, value, whole, count > 0


def sparse_rows(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Feature hashes and values of each text."""
    distinct, at, word, value, whole, _ = text_features(texts)
    codes = np.array([word_features(w) for w in distinct], np.int64).reshape(len(distinct), 3)
    rows, values = [], []
    edges = np.searchsorted(at, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        part = slice(edges[i], edges[i + 1])
        feature = np.concatenate([codes[word[part]].ravel(), whole[i]])
        amount = np.concatenate([np.repeat(value[part], 3), np.ones(2)])
        found, where = np.unique(feature, return_inverse=True)
        rows.append(found.astype(np.int32))
        values.append(np.minimum(np.bincount(where, amount), 4.0).astype(np.float32))
    return rows, values


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32, DIMENSIONS
    thresholds: np.ndarray  # K - 1, ascending

    def score(self, texts: pa.Array) -> np.ndarray:
        """s of each whole text; minus infinity for a text without words, which thus gets grade 0."""
        out = []
        for a, n in byte_slices(texts, SLICE_BYTES):
            distinct, at, word, value, whole, worded = text_features(texts.slice(a, n))
            # the three features of a word share its value; a mark or shape that many words share is bounded as in the fit
            codes = np.array([word_features(w) for w in distinct], np.int64).reshape(len(distinct), 3)
            s = np.bincount(at, value * self.weights[codes[word, 0]], minlength=n)
            for k in (1, 2):
                kinds, kind = np.unique(codes[:, k], return_inverse=True)
                pair, where = np.unique(at * max(1, len(kinds)) + kind[word], return_inverse=True)
                amount = np.minimum(np.bincount(where, value), 4.0)
                s += np.bincount(pair // max(1, len(kinds)), amount * self.weights[kinds[pair % max(1, len(kinds))]], minlength=n)
            s += self.weights[whole].sum(axis=1)
            out.append(np.where(worded, s, -np.inf))
        return np.concatenate(out) if out else np.empty(0)


def fit_rows(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """Maximum likelihood with a ridge, by proximal Adam over all rows; thresholds stay ordered as a first value and positive steps."""
    return fit_flat(np.concatenate(rows), np.concatenate(values), np.array([len(r) for r in rows]), grades, n_grades)


def fit_flat(flat: np.ndarray, amount: np.ndarray, size: np.ndarray, grades: np.ndarray, n_grades: int) -> OrdinalModel:
    """``fit_rows`` on joined rows: feature hashes, values, and features per row."""
    n_rows = len(size)
    held = np.bincount(flat, minlength=DIMENSIONS)
    kept = np.flatnonzero(held >= max(min(LEAST_TEXTS, n_rows), LEAST_SHARE * n_rows))
    index = np.full(DIMENSIONS, -1, np.int32)
    index[kept] = np.arange(len(kept), dtype=np.int32)
    col = index[flat]
    inside = col >= 0
    row = np.repeat(np.arange(n_rows, dtype=np.int32), size)[inside]
    col, amount = col[inside].astype(np.int64), amount[inside].astype(np.float32)
    del flat, inside
    scale = np.sqrt(np.bincount(col, amount**2, minlength=len(kept)) / np.maximum(1, np.bincount(col, minlength=len(kept))))
    amount /= np.maximum(scale, 1e-9).astype(np.float32)[col]
    n, k = n_rows, n_grades - 1
    held = np.bincount(grades, minlength=n_grades)
    each = ((n / n_grades / np.maximum(held, 1)) ** BALANCE)[grades]
    each /= each.mean()
    share = np.clip(np.cumsum(np.bincount(grades, each, minlength=n_grades))[:-1] / n, 0.01, 0.99)
    cuts = np.log(share / (1 - share))
    chance = SPARSITY * np.sqrt(np.bincount(col, minlength=len(kept))) / n
    params = np.concatenate([np.zeros(len(kept)), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, STEPS + 1):
        w, raw = params[:len(kept)], params[len(kept):]
        theta = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        s = np.bincount(row, amount * w[col], minlength=n)
        below = np.concatenate([np.zeros((n, 1)), sigmoid(theta[None, :] - s[:, None]), np.ones((n, 1))], axis=1)
        slope = below * (1 - below)
        at = np.arange(n)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        up, low = each * slope[at, grades + 1] / p, each * slope[at, grades] / p
        ds = up - low  # of -log p
        dtheta = np.zeros(k)
        np.add.at(dtheta, grades[grades < k], -up[grades < k])
        np.add.at(dtheta, grades[grades > 0] - 1, low[grades > 0])
        draw = np.concatenate([[dtheta.sum()], [dtheta[j + 1:].sum() * np.exp(raw[j + 1]) for j in range(k - 1)]])
        grad = np.concatenate([np.bincount(col, amount * ds[row], minlength=len(kept)) / n + RIDGE * w, draw / n])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        params -= rate * m / (1 - 0.9**step)
        w = params[:len(kept)]
        params[:len(kept)] = np.sign(w) * np.maximum(np.abs(w) - rate[:len(kept)] * chance, 0)
    raw = params[len(kept):]
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[kept] = params[:len(kept)] / np.maximum(scale, 1e-9)
    return OrdinalModel(weights, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED, seed: int = 0) -> OrdinalModel:
    """Fit on at most ``max_labelled`` texts: the rows of ``labels`` (id, grade not null) with the smallest seeded hash of
    the id, joined to their texts; where ids repeat, of those the texts with the smallest hash of their features.

    Without any labelled text the model has no weights and puts every text in the highest grade.
    """
    marked = labels.select(F.col(id_col).alias("__id"), grade.cast("int").alias("__grade")) \
        .where(F.col("__id").isNotNull() & F.col("__grade").between(0, n_grades - 1))
    sample = marked.orderBy(F.xxhash64("__id", F.lit(seed)), "__id", "__grade").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text")) \
        .join(F.broadcast(sample), "__id").select("__grade", "__text")  # max_labelled rows of two integers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, n in byte_slices(texts, SLICE_BYTES):
                found, amount = sparse_rows(texts.slice(a, n))
                yield pa.RecordBatch.from_pydict({"grade": batch.column(0).slice(a, n), "found": pa.array(found, pa.list_(pa.int32())),
                                                  "amount": pa.array(amount, pa.list_(pa.float32()))})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, amount, size, grades = [], [], [], []
        for batch in batches:
            grades.append(batch.column(0).to_numpy(zero_copy_only=False))
            size.append(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            flat.append(batch.column(1).flatten().to_numpy())
            amount.append(batch.column(2).flatten().to_numpy())
        if grades:
            model = fit_flat(np.concatenate(flat), np.concatenate(amount), np.concatenate(size),
                             np.concatenate(grades).astype(np.int64), n_grades)
            at = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_pydict({"at": pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                                              "weight": pa.array([model.weights[at]], pa.list_(pa.float32())),
                                              "thresholds": pa.array([model.thresholds], pa.list_(pa.float64()))})

    # the sample is ordered by a hash of its features, so the fit does not depend on the cluster; repeated ids are bounded too
    sample = arrow_map(rows, features, "grade int, found array<int>, amount array<float>") \
        .orderBy(F.xxhash64("found"), "grade").limit(max_labelled)
    got = arrow_map(sample, train, "at array<int>, weight array<float>, thresholds array<double>").first()
    weights = np.zeros(DIMENSIONS, np.float32)
    if got is None:
        return OrdinalModel(weights, np.full(n_grades - 1, -60.0))
    weights[got["at"]] = got["weight"]
    return OrdinalModel(weights, np.array(got["thresholds"]))


def with_scores(docs: DataFrame, model: OrdinalModel, tail: int, text_col: str = "text") -> DataFrame:
    """``docs`` with __expected_grade and __tail (P(grade >= tail)); see ``_scored`` on clashing names.

    Null, empty and blank texts get grade 0 for certain; repeated rows each
    keep their row; an empty table gives no rows.
    """
    scored = _scored(docs, model, tail, text_col)
    return scored.select("row.*", F.col("expected").alias(free_name(docs, "__expected_grade")), F.col("tail").alias(free_name(docs, "__tail")))


def _scored(docs: DataFrame, model: OrdinalModel, tail: int, text_col: str) -> DataFrame:
    """(row, expected, tail): each row of ``docs`` as a struct, its expected grade and P(grade >= tail).

    Names of ``docs`` meet none of those computed here.  Where a caller adds
    its columns to those of ``docs`` and a name is taken, in any case, the
    added one gets underscores behind it (``common.free_name``).
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed 4 MB

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for batch in batches:
            yield pa.array(shared.value.score(text_array(batch)), pa.float64())

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    at_least = [1 / (1 + F.exp(F.lit(float(t)) - F.col("score"))) for t in model.thresholds]
    expected = sum(at_least[1:], at_least[0])
    return docs.select(row_of(docs).alias("row"), F.arrow_udf("double")(scored)(whole_text(text_col)).alias("score")) \
        .select("row", expected.alias("expected"), at_least[tail - 1].alias("tail"))


# Grades of the labels table: 0 poor, 1 well written but toxic, 2 well written and not toxic.
N_GRADES, TAIL, LEAST_TAIL = 3, 2, 0.5


def label_grade() -> Column:
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1) \
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with __expected_grade, __tail and __kept, under a model fitted on ``labels``; see ``_scored`` on clashing names.

    Labels without id or grade are left out, repeated ones each count; texts
    without words are not kept; repeated rows and null ids keep their rows;
    an empty table gives no rows.
    """
    scored = _scored(docs, fit(docs, labels, label_grade(), N_GRADES, id_col, text_col), TAIL, text_col)
    return scored.select("row.*", F.col("expected").alias(free_name(docs, "__expected_grade")), F.col("tail").alias(free_name(docs, "__tail")),
                         (F.col("tail") >= LEAST_TAIL).alias(free_name(docs, "__kept")))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their own columns only, whatever these are called."""
    model = fit(docs, labels, label_grade(), N_GRADES, id_col, text_col)
    return _scored(docs, model, TAIL, text_col).where(F.col("tail") >= LEAST_TAIL).select("row.*")
