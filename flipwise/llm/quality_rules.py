"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one bit per rule
(set: the rule fails) beside the measurements.  A policy is a versioned set of
rules, that is a mask: applying or comparing policies and the ablation of
single rules are bitwise operations on the ledger and read no text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, whole_text
from .tokens import text_array

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "longest_word")
SLICE_BYTES = 8_000_000


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measures, integers only


#: The position of a rule is its bit; new rules go to the end, so that stored ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 25 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "n_letters >= 40 AND 100 * n_upper > 50 * n_letters"),
    Rule("longest_word", "longest_word > 1000"),
)
#: Failing one of these is a failure under every policy.
BASE = ("few_words", "repeated_words")
#: Versions of the policy; a version never changes, a new one is added.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "duplicate_lines"),
    3: ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "shouting", "longest_word"),
}
CURRENT = 3


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


def mask(names) -> int:
    return sum(bit(n) for n in names)


def _per_text(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, values, minlength=n).astype(np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    return np.unique(a * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)[1].astype(np.int64)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each whole text; words are runs of anything but ASCII white space."""
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    row = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    words = split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    words, row = words.filter(pa.array(real)), row[real]
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, chars)
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    repeated = np.zeros(len(code), bool)
    if len(code) >= 3:
        inside = np.flatnonzero(row[2:] == row[:-2])
        window = _pairs(_pairs(_pairs(code[inside], code[inside + 1]), code[inside + 2]), row[inside])
        twice = inside[np.bincount(window)[window] >= 2] if len(window) else inside
        for k in range(3):
            repeated[twice + k] = True
    lines = pc.split_pattern(texts, "\n")
    line_row = pc.list_parent_indices(lines).to_numpy().astype(np.int64)
    line = lines.flatten()
    worded = pc.not_equal(pc.ascii_trim_whitespace(line), "").to_numpy(zero_copy_only=False)
    line, line_row = line.filter(pa.array(worded)), line_row[worded]
    n_lines = np.bincount(line_row, minlength=n)
    line_code = line.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = np.unique(line_code * n + line_row) % n if len(line) else np.empty(0, np.int64)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    return {"n_words": np.bincount(row, minlength=n), "word_chars": _per_text(chars, row, n), "n_symbols": count("[#*$%&|<>]"),
            "n_lines": n_lines, "n_dup_lines": n_lines - np.bincount(distinct, minlength=n),
            "n_repeat_words": _per_text(repeated, row, n), "n_upper": count(r"\p{Lu}"), "n_letters": count(r"\p{L}"),
            "longest_word": longest}


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, ``fail_bits``, then the columns ``carry``.

    Null and empty texts have no words and fail ``few_words`` alone; repeated
    rows and null ids keep their rows; an empty table gives no rows.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for a, n in byte_slices(texts, SLICE_BYTES):
                got = measure(texts.slice(a, n))
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(got[m], pa.int64()) for m in MEASURES), *part.columns[2:]],
                    ["doc_id", *MEASURES, *(f"carry_{i}" for i in range(len(carry)))])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"),
                       *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"doc_id {kind['doc_id']}", *(f"{m} long" for m in MEASURES),
                        *(f"carry_{i} {kind[f'carry_{i}']}" for i in range(len(carry)))])
    return with_bits(arrow_map(rows, measured, schema)).withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


def with_bits(measures: DataFrame) -> DataFrame:
    bits: Column = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measures.withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and ``policy`` from the stored bits."""
    failed = lambda names: F.col("fail_bits").bitwiseAND(F.lit(mask(names)).cast("long")) != 0
    return book.withColumns({"base_failed": failed(BASE), "kept": ~failed(set(BASE) | set(POLICIES[version])),
                             "policy": F.lit(version)})


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """Per rule of a policy, from one aggregation over the bits: n_fail, n_fail_only (documents that this rule alone drops),
    n_kept (under the policy) and n_kept_without (under the policy without the rule)."""
    names = POLICIES[version]
    whole = F.lit(mask(names)).cast("long")
    hit = F.col("fail_bits").bitwiseAND(whole)
    sums = [F.count(F.when(hit == 0, 1)).alias("kept")]
    for n in names:
        one = F.lit(bit(n)).cast("long")
        sums += [F.count(F.when(F.col("fail_bits").bitwiseAND(one) != 0, 1)).alias(f"fail_{n}"),
                 F.count(F.when(hit == one, 1)).alias(f"only_{n}")]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"fail_{n}").alias("n_fail"),
                                        F.col(f"only_{n}").alias("n_fail_only"), F.col("kept").alias("n_kept"),
                                        (F.col("kept") + F.col(f"only_{n}")).alias("n_kept_without")) for n in names)))
    return book.agg(*sums).select(rows.alias("r")).select("r.*")
