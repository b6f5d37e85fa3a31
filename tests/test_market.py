"""Every market query against its oracle."""
import duckdb
import pytest
from pyspark.sql import SparkSession

from ledgermill.operators import aggregates, commitments, derivatives, market, markets, rules
from ledgermill.streaming import stream

SF = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "customer", "supplier", "part", "events", "nation", "region")


@pytest.fixture(scope="module")
def engines():
    spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return spark, con


@pytest.mark.parametrize("module, name", [(m, n) for m in (market, derivatives, rules, aggregates, markets, commitments, stream) for n in m.SQL])
def test_matches_oracle(engines, module, name):
    spark, con = engines
    frame = module.query(name)(spark, SF)
    cur = con.execute(module.SQL[name])
    columns = [c[0] for c in cur.description]
    norm = lambda rows: sorted(rows, key=repr)
    assert set(frame.columns) == set(columns)
    want = [tuple(int(v) if type(v).__name__ == "Decimal" else v for v in r) for r in cur.fetchall()]
    got = [tuple(int(v) if type(v).__name__ == "Decimal" else v for v in (r[c] for c in columns)) for r in frame.collect()]
    assert norm(got) == norm(want) and got
