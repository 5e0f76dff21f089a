"""Every query of the catalogue against its SQL on DuckDB, and invariants of those that SQL cannot express."""

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def canon(df):
    cell = lambda v: "null" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf, db, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), db.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_every_kind_of_personal_data_is_redacted_before_the_gate(spark, tmp_path):
    values = ["900101-1234567", "02-123-4567", "01012345678", "123-45-67890", "a@b.co", "12가 3456", "123456789012345"]
    rows = [(i, f"before {v} after", "en") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.QUERIES["flagship_redact_gate_chunk"](spark, str(tmp_path)).count() == len(values)
    got = {r.doc_id: r.categories for r in catalogue.QUERIES["redact_spans_full"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(7)] == ["resident_registration_number", "phone_number", "phone_number", "account_number", "email", "vehicle_number", "account_number"]


def test_flagship_numbers_documents_without_id_last_as_its_sql_does(spark, tmp_path):
    rows = [(None, "no id", "en"), (2, "two words", "en"), (1, "mail a@b.co", "en"), (None, None, None), (3, "drei", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "flagship_redact_gate_chunk"
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select("lang", "chunk_id", "document_id", "n_chars").collect()
    assert sorted(map(tuple, got), key=str) == sorted(c.execute(catalogue.ORACLES[name]).fetchall(), key=str)
