"""Derived columns and model features.

Lookups of fixed dictionaries (12 or 5 entries) are literal map
expressions, so they cost no join and no broadcast job; everything here is a
narrow projection inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.binning import (equals_flag, member_flag, right_closed_bin,
                                 right_closed_ordinal, rule_flag)


def literal_map(mapping: dict, key_type: T.DataType | None = None):
    """A fixed dictionary as a map expression (evaluated inside codegen)."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k).cast(key_type) if key_type is not None else F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lookup(df: DataFrame, key: str, mapping: dict, out: str,
           fallback_to_key: bool = False) -> DataFrame:
    """Code -> name, unmapped -> NULL (T3: never drops a row).

    A fixed dictionary of a few entries is a literal map expression: no
    join, no exchange, no broadcast job.  ``fallback_to_key`` (B8b) uses the
    code's text where no name is known.
    """
    key_type = df.schema[key].dataType
    name = F.try_element_at(literal_map(mapping, key_type), F.col(key))
    if fallback_to_key:
        name = F.coalesce(name, F.col(key).cast("string"))
    return df.withColumn(out, name)


def add_diagnosis_name(df: DataFrame, code: str = C.CODE, out: str = C.DIAGNOSIS,
                       names: dict[int, str] | None = None) -> DataFrame:
    """B8."""
    return lookup(df, code, C.DRG_NAMES if names is None else names, out)


def add_insurance_group(df: DataFrame, col: str = C.INSURANCE_RAW, out: str = C.INSURANCE,
                        groups: dict[str, str] | None = None) -> DataFrame:
    """B9."""
    return lookup(df, col, C.INSURANCE_GROUPS if groups is None else groups, out)


def add_age_group(df: DataFrame, col: str = C.AGE, out: str = C.AGE_GROUP,
                  edges: list[float] | None = None, labels: list[str] | None = None,
                  ordinal: str | None = None) -> DataFrame:
    """Right-closed ordered bins; optional ordinal column for ordering."""
    edges = C.AGE_EDGES if edges is None else edges
    labels = C.AGE_LABELS if labels is None else labels
    out_df = df.withColumn(out, right_closed_bin(col, edges, labels))
    if ordinal:
        out_df = out_df.withColumn(ordinal, right_closed_ordinal(col, edges))
    return out_df


def add_rule_flags(df: DataFrame, rules=None, count_col: str | None = C.ABNORMAL_COUNT) -> DataFrame:
    """B11 + B12: one 0/1 flag per rule and their sum."""
    rules = C.VITAL_FLAG_RULES if rules is None else rules
    out = df.withColumns({name: rule_flag(measure, op, thr) for name, measure, op, thr in rules})
    if count_col:
        total = None
        for name, *_ in rules:
            total = F.col(name) if total is None else total + F.col(name)
        out = out.withColumn(count_col, total)
    return out


def derive_features(df: DataFrame) -> DataFrame:
    """B8-B14 in the pipeline's order, on a vitals-cleaned table."""
    d = add_diagnosis_name(df)
    d = add_insurance_group(d)
    d = add_age_group(d)
    d = add_rule_flags(d)
    return d.withColumns({
        C.EXCLUSION_FLAG: member_flag(C.CODE, C.EXCLUSION_CODES),
        C.GENDER_BINARY: equals_flag(C.GENDER, "Male"),
    })


def rederive_keys(df: DataFrame) -> DataFrame:
    """A5: a cleaned table read back from files re-derives the diagnosis name
    and the age group (file round trips lose the ordered category)."""
    return add_age_group(add_diagnosis_name(df.drop(C.DIAGNOSIS, C.AGE_GROUP)))


#: Levels of a categorical column: more are an error (an id taken for a category), not a cut.
MOST_LEVELS = 10_000


def category_levels(df: DataFrame, col: str, most: int = MOST_LEVELS) -> list:
    """Sorted distinct non-NULL levels of a categorical column."""
    return category_levels_multi(df, [col], most)[col]


def category_levels_multi(df: DataFrame, cols: list[str], most: int = MOST_LEVELS) -> dict:
    """Sorted distinct non-NULL levels of several categorical columns, one job.

    The level lists are schema (one output column per level), so they have to
    be known on the driver: the job reads the distinct (column, level) pairs,
    as many as the table will have columns.  More than ``most`` levels of a
    column raise an error before the driver reads them all.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("v"))
                                for i, c in enumerate(cols)]))
    rows = (df.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
            .distinct().limit(most * len(cols) + 1).collect())
    if len(rows) > most * len(cols) or any(sum(r["c"] == i for r in rows) > most for i in range(len(cols))):
        raise ValueError(f"more than {most} levels in one of {cols}")
    out = {}
    for i, c in enumerate(cols):
        vals = [r["v"] for r in rows if r["c"] == i]
        typ = df.schema[c].dataType
        if isinstance(typ, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            vals = [int(v) for v in vals]
        elif isinstance(typ, (T.DoubleType, T.FloatType)):
            vals = [float(v) for v in vals]
        out[c] = sorted(vals)
    return out


def one_hot(df: DataFrame, col: str, prefix: str, levels: list | None = None,
            drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """One 0/1 column per level, first sorted level dropped.

    NULL gives all zeros (same as the dropped level).  ``OneHotEncoder`` is not
    used: it drops the last level, not the first.  Returns the new columns.
    """
    levels = category_levels(df, col) if levels is None else sorted(levels)
    kept = levels[1:] if drop_first else levels
    names = [f"{prefix}_{lvl}" for lvl in kept]
    out = df.withColumns({n: equals_flag(col, lvl).cast("double") for n, lvl in zip(names, kept)})
    return out, names


def model_features(df: DataFrame, base: list[str] | None = None,
                   ins_levels: list | None = None,
                   code_levels: list | None = None) -> tuple[DataFrame, list[str]]:
    """base features + insurance dummies + code dummies, as doubles."""
    base = C.BASE_FEATURES if base is None else base
    need = [c for c, lv in ((C.INSURANCE, ins_levels), (C.CODE, code_levels)) if lv is None]
    found = category_levels_multi(df, need) if need else {}
    ins_levels = found.get(C.INSURANCE, ins_levels)
    code_levels = found.get(C.CODE, code_levels)
    d, ins_cols = one_hot(df, C.INSURANCE, "Ins", ins_levels)
    d, code_cols = one_hot(d, C.CODE, "DRG", code_levels)
    feats = list(base) + ins_cols + code_cols
    d = d.withColumns({c: F.col(c).cast("double") for c in base})
    return d, feats
