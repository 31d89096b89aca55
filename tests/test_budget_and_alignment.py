"""The spending limit as batch and stream against a plain loop; positional alignment that stops a job."""

import random

import pytest

from parlance.operators import budget
from parlance.operators.guards import side_by_side, stopped_by
from parlance.operators.ordering import in_file_order

PRICES = {"nano": (0.15, 0.60), "lite": (0.10, 0.40), "full": (2.50, 10.00)}
SCHEMA = "call_id string, ts long, model string, prompt_tokens long, completion_tokens long"


def ledger(n=500, seed=3):
    r = random.Random(seed)
    return [(f"c{i:04d}", r.randrange(n // 3), r.choice(["nano", "lite", "full", "unknown", None]), r.choice([None, r.randrange(4000)]), r.randrange(700)) for i in range(n)]


def by_hand(calls, cap, cheapest="lite"):
    spent, out = 0, {}
    for call, _, model, a, b in sorted(calls, key=lambda c: (c[1], c[0])):
        if spent >= cap:
            out[call] = ("refused", 0, None)
            continue
        late = spent * 100 >= cap * 80 and model != cheapest
        p = PRICES.get(cheapest if late else model, (0, 0))
        cost = round((a or 0) * p[0] * 1000) + round((b or 0) * p[1] * 1000)
        out[call] = ("downgraded" if late else "made", cost, spent)
        spent += cost
    return out


def as_dict(rows):
    return {r.call_id: (r.status, r.nano_usd, r.before_nano) for r in rows}


@pytest.mark.parametrize("cap", [1, 300_000_000, 10**15])
def test_batch_and_a_plain_loop(spark, monkeypatch, cap):
    from parlance.operators import ordering

    monkeypatch.setattr(ordering.ranged, "__defaults__", ("_tie", 60))  # many ranges
    calls = ledger()
    got = as_dict(budget.decided(spark.createDataFrame(calls, SCHEMA), PRICES, "lite", cap).collect())
    assert got == by_hand(calls, cap)
    if cap == 300_000_000:
        assert {s for s, _, _ in got.values()} == {"made", "downgraded", "refused"}


def test_no_calls(spark):
    assert budget.decided(spark.createDataFrame([], SCHEMA), PRICES, "lite", 1).count() == 0


def test_stream_agrees_with_batch_and_goes_on_after_a_restart(spark, tmp_path):
    calls, cap = sorted(ledger(), key=lambda c: (c[1], c[0])), 300_000_000
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = budget.spending(stream, PRICES, "lite", cap)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)

    try:
        for part in (calls[:120], calls[120:300], calls[300:]):  # three runs, each from the state of the one before
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert as_dict(spark.read.parquet(str(tmp_path / "out")).collect()) == by_hand(calls, cap)


def test_places_in_file_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.jsonl").write_text("".join(f'{{"id": {100 * k + i}}}\n' for i in range(50 * (3 - k))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = in_file_order(spark.read.schema("id long").json(str(tmp_path))).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.place for r in got] == list(range(300))
    assert [r.id for r in got] == [100 * k + i for k in range(3) for i in range(50 * (3 - k))]


def test_rows_side_by_side(spark, tmp_path):
    def file(name, ids):
        (tmp_path / name).write_text("".join(f'{{"id": "{i}", "intent": "x{i}"}}\n' for i in ids))
        return spark.read.schema("id string, intent string").json(str(tmp_path / name))

    a = file("a", range(40))
    same = side_by_side(a, file("b", range(40)))
    assert same.where("left.id = right.id").count() == 40
    with pytest.raises(Exception, match="not side by side: 10, 11, 12, 13, 14"):
        side_by_side(a, file("c", [*range(10), *range(20, 30), *range(10, 20), *range(30, 40)])).collect()
    with pytest.raises(Exception, match="not side by side: 39"):
        side_by_side(a, file("d", range(39))).collect()
    rows = spark.createDataFrame([(1, "a")], "id int, x string")
    assert stopped_by(rows, rows.where("id = 2"), "x", "none").count() == 1
