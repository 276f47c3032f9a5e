"""Readers for the driver's parquet tables and generic file sources/sinks (A1, A2, A4)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder (column pruning and filter
    pushdown reach the scan because nothing is materialised here)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value in Spark but the missing marker in the analysed
    pipeline; turn every floating NaN into NULL once, at load."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType))
                        .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def tokens_to_null(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """Every listed missing-value token in a string column becomes NULL."""
    tokens = C.NULL_TOKENS if tokens is None else tokens
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(F.col(f.name).isin(tokens), F.lit(None).cast("string"))
                        .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


# Spellings of truth values, and the forms of numbers, that the analysed pipeline's reader takes.
TRUE_TOKENS, FALSE_TOKENS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
INTEGER_FORM = r"^ *[+-]?[0-9]+ *$"
DOUBLE_FORM = r"^ *[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?) *$"
#: Bits of the kinds of a cell; a column's kinds are their union, whatever the order of rows.
MISSING, BOOLEAN, INTEGER, DOUBLE, TEXT = 1, 2, 4, 8, 16


def cell_kind(text: Column, null_tokens: list[str]) -> Column:
    """The kind bit of one text cell."""
    return (F.when(text.isNull() | text.isin(null_tokens), MISSING).when(text.isin(TRUE_TOKENS + FALSE_TOKENS), BOOLEAN)
            .when(text.rlike(INTEGER_FORM) & F.trim(text).try_cast("bigint").isNotNull(), INTEGER).when(text.rlike(DOUBLE_FORM) | text.rlike(INTEGER_FORM), DOUBLE)
            .otherwise(TEXT))


def kind_type(kinds: int) -> str:
    """Type of a column that holds cells of these kinds.

    Truth values without missing cells are boolean, integers without missing
    cells bigint, numbers else double (also integers beside missing cells or
    beyond 64 bits, and columns without any value), everything else string.
    """
    kinds = kinds or MISSING
    if kinds & TEXT or (kinds & BOOLEAN and kinds != BOOLEAN):
        return "string"
    return "boolean" if kinds == BOOLEAN else "bigint" if kinds == INTEGER else "double"


def inferred_kinds(df: DataFrame, null_tokens: list[str] | None = None) -> DataFrame:
    """(column, position, kinds) of a table of text columns: one scan, one mergeable bitwise aggregate for all columns."""
    tokens = C.NULL_TOKENS if null_tokens is None else null_tokens
    one = df.agg(*[F.bit_or(cell_kind(F.col(f"`{c}`"), tokens)).alias(f"k{i}") for i, c in enumerate(df.columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.coalesce(f"k{i}", F.lit(MISSING)).alias("kinds"))
                                         for i, c in enumerate(df.columns)])))


def typed(df: DataFrame, kinds: dict[str, int], null_tokens: list[str] | None = None) -> DataFrame:
    """Text columns as the types of their kinds; missing-value tokens become NULL."""
    tokens = C.NULL_TOKENS if null_tokens is None else null_tokens
    out = []
    for c in df.columns:
        text, kind = F.col(f"`{c}`"), kind_type(kinds[c])
        held = F.when(~text.isin(tokens), text)
        if kind == "boolean":
            held = held.isin(TRUE_TOKENS)
        elif kind != "string":
            number = F.regexp_replace(F.trim(held), "^[+]", "")
            endless = F.lower(number).rlike("^-?inf(inity)?$")
            held = number.cast("bigint") if kind == "bigint" else \
                F.when(endless, F.when(number.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.when(~endless, number).try_cast("double"))
        out.append(held.alias(c))
    return df.select(*out)


def _read_text(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return (spark.read.option("header", True).option("inferSchema", False).option("nullValue", "").option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, null_tokens: list[str] | None = None,
             multi_line: bool = True, corrupt_col: str | None = None) -> DataFrame:
    """A1: CSV scan with header; types as declared, or without a schema as the cells show (one more scan, inside the call).

    Inferred types follow ``kind_type``: they hold for every cell of the file,
    so nothing fails to parse and ``corrupt_col`` is not used then.

    Quotes inside a quoted field are doubled, and a quoted field may span
    lines.  The latter makes a file the unit of parallelism; pass
    ``multi_line=False`` for large files without quoted line breaks.  Whole
    numbers may be written as ``276.0``.  Typed columns that fail to parse
    become NULL (PERMISSIVE); ``corrupt_col`` adds a column with the text that
    failed, NULL on sound rows, so they can be counted.  Text columns keep
    their text and the missing-value tokens are mapped to NULL.
    """
    if schema is None:
        text = _read_text(spark, path, multi_line)
        return typed(text, {r["column"]: r["kinds"] for r in inferred_kinds(text, null_tokens).collect()}, null_tokens)  # a row per column
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, _WHOLE) else f.dataType) for f in fields])
    if corrupt_col:
        raw = raw.add(corrupt_col, T.StringType())
    reader = (spark.read.schema(raw).option("header", True).option("mode", "PERMISSIVE").option("nullValue", "")
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line))
    if corrupt_col:
        reader = reader.option("columnNameOfCorruptRecord", corrupt_col)
    df = tokens_to_null(reader.csv(path), null_tokens)
    whole, failed = {}, []
    for f in fields:
        if isinstance(f.dataType, _WHOLE):
            text, kind = F.col(f.name), f.dataType.simpleString()
            number = text.try_cast("double")
            exact = F.when(number == F.floor(number), number).try_cast(kind)
            whole[f.name] = F.coalesce(text.try_cast(kind), exact)
            failed.append(F.when(text.isNotNull() & whole[f.name].isNull(), F.concat(F.lit(f"{f.name}="), text)))
    if corrupt_col and failed:
        whole[corrupt_col] = F.coalesce(F.col(corrupt_col), *failed)
    return nan_to_null(df.withColumns(whole) if whole else df)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A2: sink.  Parquet (optionally partitioned) is the native default;
    ``fmt='csv'`` writes header CSV without an index column."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


POINTER = "_current"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def publish_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """A2 for readers that may come at any time: write a new version beside the others, then point to it.

    The table goes to a folder of its own below ``path``; only when it is
    whole does the pointer file change, by one rename, so a reader sees the
    version before or the version after, and a write that fails changes
    nothing.  Returns the version.  Earlier versions stay for readers that
    have them open (``drop_versions``).
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    write_table(df, f"{path}/{version}", partition_by=partition_by, mode="errorifexists")
    fs, draft = _path(spark, f"{path}/.{version}.pointer")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    overwrite[0] = jvm.Options.Rename.OVERWRITE
    context.rename(draft, _path(spark, f"{path}/{POINTER}")[1], overwrite)
    return version


def current_version(spark: SparkSession, path: str) -> str:
    """The version that the pointer of a published table names."""
    fs, pointer = _path(spark, f"{path}/{POINTER}")
    stream = fs.open(pointer)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table."""
    return spark.read.parquet(f"{path}/{current_version(spark, path)}")


def drop_versions(spark: SparkSession, path: str) -> int:
    """Delete all versions of a published table but the current one; returns how many."""
    current = current_version(spark, path)
    fs, top = _path(spark, path)
    old = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("v-") and s.getPath().getName() != current]
    for p in old:
        fs.delete(p, True)
    return len(old)


def shape(df: DataFrame) -> DataFrame:
    """A4: one-row (n_rows, n_columns) profile."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("bigint"))
