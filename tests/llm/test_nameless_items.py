"""Benchmark items without an id."""

import duckdb

from parlance.llm import decontaminate, queries
from tests.llm.common import docs


def test_nameless_items_are_hit(spark):
    item = lambda c: " ".join(f"{c}{k}" for k in range(12))
    rows = [(1, "before " + item("a")), (2, item("b") + " after " + item("a")), (3, item("c") + " " + item("a")), (4, "clean words")]
    bench = [(None, item("a")), (7, item("b")), (None, item("c"))]
    table = docs(spark, rows)
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contamination(table, benchmark, window=10).collect()))
    assert [(r[0], r[2], r[3], r[5]) for r in got] == [(1, 12, 1, True), (2, 24, 2, True), (3, 24, 1, True), (4, 0, 0, False)]
    con = duckdb.connect()
    con.register("documents", table.toPandas())
    con.register("benchmark", benchmark.toPandas().astype({"item_id": "Int64"}))
    assert got == sorted(con.execute(queries.ORACLES["op7_benchmark_decontamination"]).fetchall())
    assert [r.doc_id for r in decontaminate.keep_clean(table, benchmark, window=10).collect()] == [4]
