"""Reachable nodes over tables without keys here and there, by kind and with hops, and how often edges are shuffled."""

import duckdb
from shuffles import rows_shuffled

import __spark_entry__
from timetide.operators import graph


def test_missing_keys_are_one_node(spark, tmp_path):
    """Suppliers, orders and customers without a key: the SQL gives one node for all of them."""
    tables = {
        "part": ([(1, 1), (2, 5), (None, 1)], "p_partkey long, p_size int"),
        "lineitem": ([(1, 10, 100), (1, 10, 101), (1, None, 102), (2, 11, 103), (2, 10, None)], "l_partkey long, l_suppkey long, l_orderkey long"),
        "orders": ([(100, 7), (101, None), (102, 8), (103, 9), (None, 6)], "o_orderkey long, o_custkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    wanted = duckdb.sql(__spark_entry__.oracle_sql()["q_reachability"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["q_reachability"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted)) and (None,) in got


def test_hops_over_kinds_and_circles(spark):
    """x -> y -> x -> z, with a circle of x and y: every node once, at its fewest hops."""
    pairs = lambda rows: spark.createDataFrame(rows, "a int, b int")
    edges = [("x", "y", pairs([(1, 1), (1, 2), (3, 4)])), ("y", "x", pairs([(2, 3), (1, 1)])), ("x", "z", pairs([(3, 9), (8, 10)])), ("x", "x", pairs([(1, 5), (5, 3)]))]
    found = graph.reachable_kinds(edges, {"x": spark.createDataFrame([(1,), (1,)], "node int")})
    got = {kind: sorted(map(tuple, rows.collect())) for kind, rows in found.items()}
    assert got == {"x": [(1, 0), (3, 2), (5, 1)], "y": [(1, 1), (2, 1), (4, 3)], "z": [(9, 3)]}


def test_edges_are_cut_once(spark):
    """A chain takes a round a hop: the edges are not made again in each."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        made.add(1)
        yield from batches

    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "a int, b int").coalesce(1).mapInArrow(count, "a int, b int")
    found = graph.reachable(edges, spark.createDataFrame([(0,)], "node int"))
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(5)]
    assert made.value <= 1 and rows_shuffled(found) == 0
