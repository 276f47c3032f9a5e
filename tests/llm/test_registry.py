"""The registered queries on the small tables, their SQL, and the pipeline."""

import duckdb
import pytest

import corpus_pipeline
from flipwise.llm import registry

TABLES = ["documents", "pages", "labels"]


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, sf_small, name):
    df = registry.QUERIES[name](spark, sf_small)
    cur = duck.execute(registry.SQL[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal([d[0] for d in cur.description], cur.fetchall())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_has_a_row_for_every_document(spark, sf_small, name):
    df = registry.QUERIES[name](spark, sf_small)
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    assert df.select("doc_id").distinct().count() == n


def test_pipeline_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert 0 < len(kept) <= n
        docs, n = docs.where(docs.doc_id.isin(*kept)), len(kept)
        assert stage(spark, docs.limit(0), sf_small).collect() == []
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small)
    assert packed.select("doc_id").distinct().count() == n


def test_pipeline_mixing_counts_the_end_token(spark, sf_small):
    """Empty texts are sequences of one token after packing, so they take their part of the budget."""
    rows = [(i, "", "en", "src0", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.mixed(spark, docs, sf_small).count() == 80


def test_pipeline_run(spark, sf_small):
    assert corpus_pipeline.run(spark, sf_small).count() > 0
