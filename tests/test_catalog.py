"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from duskframe.operators import tracking
from duskframe.plans import adapters, catalog, oracle
from duskframe.plans.versions import VersionedTable

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)):
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def test_names_agree():
    assert set(oracle.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = duck.execute(oracle.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, found.fetchall())


def test_stored_detections_are_rewritten_without_features(spark, monkeypatch):
    written, write = [], VersionedTable._write
    monkeypatch.setattr(VersionedTable, "_write", lambda self, rows, base: written.append(set(rows.columns)) or write(self, rows, base))
    catalog.QUERIES["retracked_incrementally"](spark, DATA)
    assert len(written) >= 4 and not any("cnn_features" in columns for columns in written)
    x, i, _ = catalog._traps(spark, DATA)
    features = adapters.features(spark, DATA)
    for in_order in (False, True):
        early = tracking.candidates(x.join(features, "feature_id", "left"), i, 1200, 800, in_order=in_order)
        late = tracking.candidates(x, i, 1200, 800, in_order=in_order, features=features)
        assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))


def test_the_replayed_stream_is_written_by_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog, "_place", lambda spark, name: str(tmp_path))
    monkeypatch.setattr(catalog.stream_tracker, "run", lambda stream, out, *args, **options: os.makedirs(out) or type("Query", (), {"awaitTermination": lambda self: None})())
    catalog._replayed(spark, DATA, "tracker", 3)
    files = glob.glob(f"{tmp_path}/in/*.parquet")
    assert 3 < len(files) <= 3 * spark.sparkContext.defaultParallelism
    seen = [{r[0] for r in duckdb.sql(f"select distinct session from '{f}'").fetchall()} for f in sorted(files, key=os.path.getmtime)]
    assert len(set().union(*seen)) > 0 and sum(len(s) for s in seen) <= 3 * len(set().union(*seen))
