"""Every query that SQL can express equals its SQL, values and types."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_DIR

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(table, columns):
    frame = table.select(columns).to_pandas().astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


def types(table, columns):
    return [str(table.schema.field(c).type).replace("large_", "") for c in columns]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    expected = duck.execute(ORACLES[name]).to_arrow_table()
    got = entry.queries()[name](spark, SF_DIR).toArrow()
    columns = sorted(expected.column_names)
    assert sorted(got.column_names) == columns
    assert types(got, columns) == types(expected, columns)
    assert rows(got, columns) == rows(expected, columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship(spark):
    cells = {r.concepto: r.n for r in entry.entry(spark).collect()}
    assert set(cells) == {"perdida_evitada", "costo_oportunidad", "perdida_no_detectada", "ganancia_capturada"}
