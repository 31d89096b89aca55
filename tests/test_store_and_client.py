"""The keyed store against damage, killed writes and two writers; the client against a model that fails."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parlance.operators import client, labelling
from parlance.sources.store import KeyedStore

ASK = "model string, system string, prompt string, temperature double, max_tokens int"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_values_and_versions(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "x long, y string", buckets=4)
    keys = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("zz", 5)], "key string, n int")
    assert store.all().count() == 0 and store.get(keys).where("found").count() == 0
    assert store.put(spark.createDataFrame([("a", 1, "one"), ("b", 2, None), ("b", 2, None), (None, 9, "no key")], "key string, x long, y string")) == 1
    assert store.put(spark.createDataFrame([("a", 10, "ten"), ("c", 7, "")], "key string, x long, y string")) == 2
    assert rows(store.get(keys.where("n <> 4")), "key", "n", "found", "x", "y") == [("a", 1, True, 10, "ten"), ("a", 2, True, 10, "ten"), ("b", 3, True, 2, None), ("zz", 5, False, None, None)]
    assert store.get(keys).count() == 5
    assert rows(store.all(1), "key", "x") == [("a", 1), ("b", 2)]  # the older version is still there
    assert rows(store.missing(keys), "key") == [("zz",)]
    before = rows(store.all(), "key", "x")
    store.compact()
    assert len(store.manifest()["batches"]) == 1 and rows(store.all(), "key", "x") == before
    assert store.vacuum(1) == 2 and rows(store.all(), "key", "x") == before
    store.put(spark.createDataFrame([], "key string, x long, y string"))
    assert rows(store.all(), "key", "x") == before
    with pytest.raises(ValueError, match="has 4 buckets"):
        KeyedStore(spark, str(tmp_path / "s"), "x long, y string", buckets=8).all()


def test_only_the_buckets_of_the_keys_are_read(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "x long", buckets=16)
    store.put(spark.range(200).selectExpr("CAST(id AS STRING) AS key", "id AS x"))
    got = store.get(spark.createDataFrame([("7",)], "key string"))
    assert rows(got, "key", "x") == [("7", 7)]
    assert len(got.inputFiles()) <= 16
    assert "PartitionFilters" in got._jdf.queryExecution().toString() and "bucket#" in got._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_killed_write_and_broken_part(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "x long", buckets=4)
    store.put(spark.range(40).selectExpr("CAST(id AS STRING) AS key", "id AS x"))
    store._write(spark.range(40, 50).selectExpr("CAST(id AS STRING) AS key", "id AS x"))  # written, never listed
    with pytest.raises(Exception, match="boom"):
        store.put(spark.range(9).selectExpr("CAST(id AS STRING) AS key", "CAST(raise_error('boom') AS LONG) AS x"))
    assert store.manifest()["version"] == 1 and store.all().count() == 40 and store.damaged().count() == 0
    part = next(Path(tmp_path / "s/data").glob(f"batch={store.manifest()['batches'][0]['name']}/bucket=1/*.parquet"))
    part.write_bytes(b"not parquet")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    lost = store.manifest()["batches"][0]["rows"]["1"]
    assert store.all().count() == 40 - lost
    assert rows(store.damaged(), "bucket", "rows", "readable") == [(1, lost, 0)]
    assert store.missing(spark.range(40).selectExpr("CAST(id AS STRING) AS key")).count() == lost
    store.put(spark.range(40).selectExpr("CAST(id AS STRING) AS key", "id AS x"))  # what is lost can be put again
    assert store.all().count() == 40


def test_two_writers(spark, tmp_path):
    stores = [KeyedStore(spark, str(tmp_path / "s"), "x long", buckets=2) for _ in range(4)]
    failed = []

    def write(i):
        try:
            for j in range(2):
                stores[i].put(spark.createDataFrame([(f"{i}-{j}", i)], "key string, x long"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and stores[0].manifest()["version"] == 8
    assert rows(stores[0].all(), "key") == sorted((f"{i}-{j}",) for i in range(4) for j in range(2))
    taken = dict(stores[0].manifest(3))
    assert not stores[1]._claim(taken)  # a version is taken once


def model(tmp_path, fails=0, error="503 overloaded"):
    """A connector that keeps a file for each call and fails the first times for each prompt."""

    class Stub:
        def ask(self, model, system, prompt, temperature, max_tokens):
            import hashlib
            import os
            import uuid

            name = hashlib.md5(prompt.encode()).hexdigest()
            folder = f"{tmp_path}/calls/{name}"
            os.makedirs(folder, exist_ok=True)
            tries = len(os.listdir(folder))
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            if tries < fails:
                raise RuntimeError(error)
            if "prose" in prompt and "ONLY a single" not in prompt or "never" in prompt:
                return "I would rather not", 3, 4
            return "Sure: ```json\n" + json.dumps({"intent": "other" if "odd" in prompt else "praise_or_chitchat", "confidence": 0.5, "n": len(prompt)}) + "\n```", 3, 4

    return Stub()


def calls(tmp_path):
    return sum(1 for _ in Path(tmp_path).glob("calls/*/*"))


def test_retries_and_write_through(spark, tmp_path):
    store = client.replies(spark, str(tmp_path / "r"), 4)
    asked = spark.createDataFrame([(1, "m", None, "a", 0.0, 9), (2, "m", "", "a", 0.0, 9), (3, "m", "s", "b", 0.0, 9), (4, "m", "s", None, 0.0, 9)], f"id int, {ASK}")
    with pytest.raises(Exception, match="no reply for model=m"):
        client.complete(asked, store).collect()
    quiet = lambda s: None
    got = client.complete(asked, store, model(tmp_path, fails=2), wave=2, sleep=quiet)
    assert rows(got, "id", "found", "attempts") == [(1, True, 3), (2, True, 3), (3, True, 3), (4, True, 3)]
    assert calls(tmp_path) == 9  # three distinct requests, three attempts each
    assert client.complete(asked, store, model(tmp_path), sleep=quiet).count() == 4 and calls(tmp_path) == 9
    assert client.complete(asked, store).where("text like 'Sure%'").count() == 4
    assert client.complete(asked.limit(0), store, model(tmp_path)).count() == 0


def test_errors_that_stay_are_asked_again(spark, tmp_path):
    store = client.replies(spark, str(tmp_path / "r"), 4)
    asked = spark.createDataFrame([("m", "", "a", 0.0, 9)], ASK)
    quiet = lambda s: None
    got = client.complete(asked, store, model(tmp_path, fails=1, error="400 bad request"), sleep=quiet).first()
    assert got.text is None and "400" in got.error and got.attempts == 1
    with pytest.raises(Exception, match="no reply"):
        client.complete(asked, store).collect()
    assert client.complete(asked, store, model(tmp_path), sleep=quiet).first().error is None


def test_backoff():
    waits = []

    def down():
        raise TimeoutError("timeout")

    out = client.attempt(down, waits.append, lambda: 0.25)
    assert waits == [1.25, 2.25, 4.25, 8.25] and out["attempts"] == 5 and "timeout" in out["error"]


def test_calls_in_flight(spark, tmp_path):
    class Counting:
        def ask(self, model, system, prompt, temperature, max_tokens):
            import os
            import time
            import uuid

            folder = f"{tmp_path}/flight"
            os.makedirs(folder, exist_ok=True)
            mine = f"{folder}/{uuid.uuid4().hex}"
            open(mine, "w").close()
            n = len(os.listdir(folder))
            time.sleep(0.02)
            os.unlink(mine)
            return str(n), 0, 0

    store = client.replies(spark, str(tmp_path / "r"), 4)
    asked = spark.range(60).selectExpr("'m' AS model", "'' AS system", "CAST(id AS STRING) AS prompt", "0.0 AS temperature", "1 AS max_tokens")
    most = client.complete(asked, store, Counting(), in_flight=6, threads=3).selectExpr("max(CAST(text AS INT)) AS n").first().n
    assert 2 <= most <= 6


def test_json_once_more(spark, tmp_path):
    store = client.replies(spark, str(tmp_path / "r"), 4)
    asked = spark.createDataFrame([(i, "m", "", p, 0.0, 9) for i, p in enumerate(["fine", "prose", "never", "prose"])], f"id int, {ASK}")
    for connector in (model(tmp_path), None):
        got = client.complete_json(asked, store, connector, sleep=lambda s: None)
        assert rows(got, "id", "parse_failed") == [(0, False), (1, False), (2, True), (3, False)]
    assert calls(tmp_path) == 5  # three, and two asked again


@pytest.mark.parametrize("sent", [client.SENT, 0])
def test_replies_kept_before_are_asked_once_more_with_the_new_ones(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(client, "SENT", sent)  # keys are broadcast or shuffled
    store = client.replies(spark, str(tmp_path / "r"), 4)
    asked = spark.createDataFrame([(i, "m", "", p, 0.0, 9) for i, p in enumerate(["fine", "prose one", "prose two", "prose two", "never", "fine too"])], f"id int, {ASK}")
    quiet = lambda s: None
    client.complete(asked.where("id < 2"), store, model(tmp_path), sleep=quiet)
    for keep in (None, ["id"]):
        got = client.complete_json(asked, store, model(tmp_path), keep=keep, wave=2, sleep=quiet)
        assert rows(got, "id", "parse_failed") == [(0, False), (1, False), (2, False), (3, False), (4, True), (5, False)]
    assert calls(tmp_path) == 8  # five distinct requests, three asked again


def test_label_passes_read_texts_twice_in_like_shares(spark, tmp_path):
    """Once for the keys and once for the calls; further texts are those that were written for the calls, in files of a bounded number of rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return "prose" if i % 5 == 0 else f"fine {i}"

    store = client.replies(spark, str(tmp_path / "r"), 4)
    book = spark.createDataFrame([("other", "the rest")], "intent string, definition string")
    texts = spark.range(200).select("id", text("id").alias("text"), F.array().cast("array<string>").alias("context"))
    assert labelling.labels(texts, book, "corpus", "m", store, model(tmp_path), wave=64, sleep=lambda s: None).where("not parse_failed").count() == 200
    assert seen.value == 400
    asked = client.keyed(labelling.requests(spark.range(400, 1000).selectExpr("id", "CAST(id AS STRING) AS text", "NULL AS context").withColumn("context", F.array().cast("array<string>")), book, "corpus", "m"))
    _, wrote = client._call_missing(asked, client._keys(asked), store, model(tmp_path), wave=64, sleep=lambda s: None)
    assert wrote.count() == 600 and wrote.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 64 // (4 * 8)


def test_label_passes(spark, tmp_path):
    store = client.replies(spark, str(tmp_path / "r"), 4)
    book = spark.createDataFrame([("other", "the rest"), ("praise_or_chitchat", "kind"), ("account_access_login", None)], "intent string, definition string")
    texts = spark.createDataFrame([(1, "nice", ["x" * 500, "y", None, "z", "w"]), (2, "odd", None), (3, "never", []), (4, None, []), (5, "prose", [])], "id int, text string, context array<string>")
    answer = json.dumps({"intent": "praise_or_chitchat", "confidence": "high", "escalate": "yes", "reply_must_include": ["a", "b", "c", "d"], "notes": "n" * 300})

    class Stub:
        def ask(self, model, system, prompt, temperature, max_tokens):
            if "never" in prompt or "prose" in prompt and "ONLY" not in prompt:
                return "no", 1, 1
            return (answer if "odd" not in prompt else '{"intent": "made up"}'), 1, 1

    for name in labelling.PASSES:
        got = {r.id: r for r in labelling.labels(texts, book, name, "m", store, Stub(), sleep=lambda s: None).collect()}
        assert [got[i].intent for i in (1, 2, 3, 4, 5)] == ["praise_or_chitchat", "other", "other", "praise_or_chitchat", "praise_or_chitchat"]
        assert [got[i].parse_failed for i in (1, 2, 3, 4, 5)] == [False, False, True, False, False]
        if name == "corpus":
            assert got[1].confidence == 0.0 and got[3].confidence == 0.0
        if name in ("A-full", "B"):
            assert got[1].must_include == ["a", "b", "c"] and len(got[1].notes) == 160 and got[1].escalate and not got[2].escalate and got[1].difficulty == "medium"
    asked = {r.id: r for r in labelling.requests(texts, book, "B", "m").collect()}
    assert all(r.system.index("- other:") > r.system.index("- praise") for r in asked.values()) and len({r.system for r in asked.values()}) == 2
    assert asked[1].prompt.count("\n- ") == 3 and "x" * 200 in asked[1].prompt and "x" * 201 not in asked[1].prompt
    full = labelling.labels(texts, book, "A-full", "m", store)
    assert labelling.projected(full, spark.createDataFrame([(2,), (1,)], "id int")).count() == 2
    with pytest.raises(Exception, match="no row in the full pass for id 77"):
        labelling.projected(full, spark.createDataFrame([(2,), (77,)], "id int")).collect()
