from pyspark.sql import functions as F

from parlance.llm import substring_dedup
from parlance.llm._cluster import Scratch
from tests.llm.common import docs


def test_frequent_digests_are_met_like_all_others(spark, monkeypatch):
    """Results don't depend on which digests count as frequent, nor on whether there are any."""
    line = "a line that most of the documents hold at one place or another"
    rows = [(i, f"own start number {i} of it.\n{line}\nmiddle {i % 7} shared by a few of them here\n{line if i % 2 else 'x'}\nend {i}") for i in range(120)] + [(500, None), (501, "")]
    table = docs(spark, rows)
    want = sorted(map(str, substring_dedup.dedup(table, least_words=4, every_line=True).collect()))
    assert sum(line in r for r in want) == 1
    meet = substring_dedup._meet
    for hot in (1, 10, 50, 10_000_000):
        monkeypatch.setattr(substring_dedup, "_meet", lambda u, f, hot=hot: meet(u, f, hot))
        assert sorted(map(str, substring_dedup.dedup(table, least_words=4, every_line=True).collect())) == want


def test_there_are_never_more_frequent_digests_than_allowed(spark):
    s = Scratch(spark, "t")
    units = s.table(spark.range(1000).select((F.col("id") % 100).alias("h1"), F.lit(0).cast("long").alias("h2"), "id"))
    firsts = s.table(units.groupBy("h1", "h2").agg(F.min("id").alias("o"), F.count("*").alias("n")))
    plan = lambda most: substring_dedup._meet(units, firsts, hot=1, most=most)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan(1000) and "LeftAnti" not in plan(50)  # ten each: more than 1000 / 1000, not more than 1000 / 50
    for most in (1000, 50):
        assert substring_dedup._meet(units, firsts, hot=1, most=most).count() == 1000
