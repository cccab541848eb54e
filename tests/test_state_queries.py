import duckdb
import pytest

from floeline import catalog
from floeline.operators.graph import levels
from floeline.operators.transitions import group_members

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in ("orders", "lineitem", "events", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    relation = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted(relation.select(*columns).fetchall(), key=repr)


def test_levels_of_a_chain_a_cycle_and_a_dangling_dependency(spark, monkeypatch):
    steps = [("a", ""), ("b", "a"), ("c", "b,a"), ("d", "gone"), ("x", "y"), ("y", "x")]
    df = spark.createDataFrame([(f"r{k}", n, d) for k in range(5) for n, d in steps], "run_id string, name string, depends_on string")
    monkeypatch.setattr("floeline.operators.graph.NODES", 8)
    want = {"a": 0, "b": 1, "c": 2, "d": 0, "x": 0, "y": 0}
    assert {(r["run_id"], r["name"]): r["level"] for r in levels(df).collect()} == {(f"r{k}", n): v for k in range(5) for n, v in want.items()}


def test_no_oracle_is_empty(oracle):
    """A query that agrees on no rows shows nothing."""
    for name, text in catalog.oracle_sql().items():
        assert oracle.sql(f"SELECT COUNT(*) FROM ({text})").fetchall()[0][0] > 0, name


def test_group_expansion_is_dealt_by_its_rows(spark, monkeypatch, tmp_path):
    """Tasks follow the number of steps, not the session's setting; repeated runs count as in SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"COPY (SELECT * FROM '{DATA}/orders.parquet' UNION ALL SELECT * FROM '{DATA}/orders.parquet' WHERE o_orderkey % 50 = 0) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (SELECT * FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    lines = con.sql("SELECT COUNT(*) FROM lineitem").fetchall()[0][0]
    monkeypatch.setattr("floeline.sources.state.TASK_ROWS", 200)
    got = catalog.queries()["group_expansion"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 1 + lines // 200 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = con.sql(f"SELECT run_id, step, dep FROM ({catalog.oracle_sql()['group_expansion']})").fetchall()
    assert sorted(tuple(r) for r in got.select("run_id", "step", "dep").collect()) == sorted(want)
    assert len(want) > len(set(want))


def test_a_group_named_twice_counts_once(spark):
    rows = [("r", "a", "x", []), ("r", "b", "x", []), ("r", "c", "y", ["x", "x", "gone"]), ("r", "d", "z", ["y", "x"]), ("q", "e", "x", []), ("q", "f", "y", None)]
    groups = spark.createDataFrame(rows, "run_id string, step string, grp string, after array<string>")
    want = [("r", "c", "a"), ("r", "c", "b"), ("r", "d", "a"), ("r", "d", "b"), ("r", "d", "c")]
    for tasks in (None, 5):
        assert sorted(tuple(r) for r in group_members(groups, groups, tasks).collect()) == want
