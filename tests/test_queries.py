import ast
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from skein.plans import layer_queries  # noqa: F401
from skein.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def norm(rows, cols):
    order = sorted(cols)
    out = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[cols.index(c)] for c in order)) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in plans.ORACLES:
        cur = duck.execute(plans.ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert norm(rows, df.columns) == norm(cur.fetchall(), cols)
    else:
        assert rows


def test_entry_works_without_the_llm_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['skein.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert [int(x) for x in out] == [len(plans.QUERIES), len(plans.ORACLES)]


def test_tags_of_letters_whose_capital_is_longer(spark, tmp_path):
    import duckdb

    rows = [(1, 1, "user", "Erungßau das"), (1, 2, "assistant", "ßa"), (1, 3, "user", "ﬁn ŉ"), (2, 2, "user", "Öä"), (2, 4, "user", "ß")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cur = duck.execute(plans.ORACLES["tag_problems"])
    got = plans.QUERIES["tag_problems"](spark, str(tmp_path))
    want = norm(cur.fetchall(), [d[0] for d in cur.description])
    assert norm([tuple(r) for r in got.collect()], got.columns) == want
    assert sum("echoes the pronoun" in r for r in want) == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name,small", [("cohort_problems", 0), ("presence_problems", 0), ("presence_lines", 0), ("lock_problems", 0), ("addressee_problems", 0), ("lock_assembly", 0), ("graph_edges", 4), ("graph_problems", 2)])
def test_no_table_of_scenes_is_broadcast(spark, name, small):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") <= small


def test_scans_are_pruned(spark):
    plan = plans.QUERIES["kg_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("module", [plans, layer_queries])
def test_no_import_hides_another(module):
    with open(module.__file__) as f:
        names = [a.asname or a.name for node in ast.walk(ast.parse(f.read())) if isinstance(node, ast.Import | ast.ImportFrom) for a in node.names]
    assert sorted(set(names)) == sorted(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_items_are_moved_once_and_dealt_by_rows(spark, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.crossJoin(spark.range(0, 70)).select((lines.l_orderkey * 70 + F.col("id")).alias("l_orderkey"), *lines.columns[1:]).write.parquet(f"{tmp_path}/lineitem.parquet")
    i = layer_queries.items(spark, str(tmp_path))
    plan = i.groupBy("scene").agg(F.max("qty"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(l_orderkey" in plan and f", {1 + lines.count() * 70 // 200_000})" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["lock_assembly", "lock_names"])
def test_line_items_are_read_once_for_lists_and_once_for_places(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/lineitem.parquet") == 2


def test_an_order_that_stands_twice_is_assembled_twice(spark, tmp_path):
    import duckdb

    orders = [(1, 7, "1-URGENT", "O"), (1, 7, "1-URGENT", "O"), (2, 7, "5-LOW", "F"), (3, 7, "5-LOW", "P"), (4, 8, "5-LOW", "F")]
    lines = [(1, 1, 10, 3, 5.0, "R", "F"), (1, 2, 4, 5, 6.0, "N", "O"), (1, 2, 4, 5, 6.0, "N", "O"), (1, 3, 7, 1, 2.0, "R", "F"), (3, 3, 3, 2, 1.0, "A", "F")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    for t in ("orders", "lineitem"):
        duck.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = duck.execute(plans.ORACLES["lock_assembly"])
    want = norm(cur.fetchall(), [d[0] for d in cur.description])
    got = plans.QUERIES["lock_assembly"](spark, str(tmp_path))
    assert norm([tuple(r) for r in got.collect()], got.columns) == want and len(want) == 5
