"""Registry of named queries (``queries()``) and their SQL oracles (``oracle_sql()``).

Every query reads the driver's tables under ``sf_dir`` (whole tables), runs
the library operators on them and returns a DataFrame.  The call itself may run
jobs: the cleaned and the split table are stored on first use, and operators
read bounded sketches (cut points, levels).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .registry_eval import EVAL_QUERIES, EVAL_SQL
from .registry_exact import EXACT_QUERIES, EXACT_SQL
from .registry_models import MODEL_QUERIES
from .registry_multi import MULTI_QUERIES, MULTI_SQL
from .registry_profile import PROFILE_QUERIES, PROFILE_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    out.update(PROFILE_QUERIES)
    out.update(EVAL_QUERIES)
    out.update(MULTI_QUERIES)
    out.update(EXACT_QUERIES)
    out.update(MODEL_QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(PROFILE_SQL)
    out.update(EVAL_SQL)
    out.update(MULTI_SQL)
    out.update(EXACT_SQL)
    return out


__all__ = ["queries", "oracle_sql"]
