"""Every query with SQL against DuckDB at the smallest size; the others run."""

import duckdb
import pytest

from loomseg import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "nation supplier customer orders lineitem events benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    same = lambda v: round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(columns), sorted((tuple(same(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    con = duck.execute(catalog.ORACLES[name])
    want = _rows([c[0] for c in con.description], con.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for g, w in zip(*(x[1] for x in (got, want)), strict=True):
        assert g == pytest.approx(w, abs=2e-5) if all(isinstance(v, (int, float)) for v in g) else g == w


#: Queries of regions that are to give what SQL gives where dead stretches leave no bin.
NO_BINS = ["em_step_single", "forward_ll"]


@pytest.mark.parametrize("name", NO_BINS)
def test_query_without_bins_equals_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ((s_suppkey + 10 * i)::BIGINT AS s_suppkey) FROM '{SF}/supplier.parquet', range(600) r(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"COPY (FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for t in ("supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert catalog.ev_regions(spark, str(tmp_path)).isEmpty()
    df = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(catalog.ORACLES[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([c[0] for c in want.description], want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).columns) == 7
