"""Calls of a language model from the executors, behind a store of replies.

A request is (model, system, prompt, temperature, max_tokens); its key covers all five. Equal requests are one call. Misses go
out in waves, each kept before the next one starts, so a run that dies has lost one wave of calls at most. A task that
Spark runs again calls again: calls happen at least once, and replies count once.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.tables import shared_folder, written
from parlance.session import ship
from parlance.sources.cache import OfflineMiss
from parlance.sources.store import KeyedStore

REQUEST = ("model", "system", "prompt", "temperature", "max_tokens")
#: What the store of replies holds; error is null for a reply.
REPLY = "text string, prompt_tokens long, completion_tokens long, attempts int, error string"
ATTEMPTS = 5
#: Parts of messages of errors that are worth another attempt.
PASSING = ("429", "500", "502", "503", "504", "overloaded", "timeout")
#: Calls in flight at once over all executors, calls at once in a task, and calls between two writes of the store.
IN_FLIGHT, THREADS, WAVE = 64, 8, 100_000
#: Waves at most (more requests make longer ones), and keys that are broadcast.
WAVES, SENT = 1000, 500_000
ONLY_JSON = "\n\nReturn ONLY a single valid JSON object. No prose, no code fences."


class Connector(Protocol):
    """What calls a model; it is pickled to the executors, so it opens its connection there."""

    def ask(self, model: str, system: str, prompt: str, temperature: float, max_tokens: int) -> tuple[str, int, int]:
        """(text, prompt tokens, completion tokens); raises where there is no reply."""


def keyed(requests: DataFrame) -> DataFrame:
    """requests with their key: the SHA-256 of the five columns as JSON, a null system being empty."""
    parts = [F.coalesce("system", F.lit("")).alias(c) if c == "system" else F.col(c).cast({"temperature": "double", "max_tokens": "int"}.get(c, "string")).alias(c) for c in sorted(REQUEST)]
    return requests.withColumn("key", F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def attempt(call: Callable[[], tuple[str, int, int]], sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random, attempts: int = ATTEMPTS) -> dict:
    """The reply of a call, or its last error; errors that pass are met with a wait of 2^k + U(0, 1) seconds."""
    for k in range(attempts):
        try:
            text, n_in, n_out = call()
            return {"text": text or "", "prompt_tokens": n_in, "completion_tokens": n_out, "attempts": k + 1, "error": None}
        except Exception as e:  # noqa: BLE001 - reported in the row
            error = f"{type(e).__name__}: {e}"
            if k + 1 == attempts or not any(s in error for s in PASSING):
                return {"text": None, "prompt_tokens": 0, "completion_tokens": 0, "attempts": k + 1, "error": error[:500]}
            sleep(2**k + draw())
    raise ValueError("attempts must be 1 or more")


def called(requests: DataFrame, connector: Connector, threads: int = THREADS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, text, prompt_tokens, completion_tokens, attempts, error) of requests(key, ...), a call a row, with as many at once as a task has threads."""
    ship(requests.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                rows = list(batch[["key", *REQUEST]].itertuples(index=False, name=None))
                replies = list(pool.map(lambda r: {"key": r[0], **attempt(lambda: connector.ask(*r[1:]), sleep)}, rows))
                if replies:
                    yield pd.DataFrame(replies).astype({"text": object, "error": object})

    plain = requests.selectExpr("key", "CAST(model AS STRING) AS model", "coalesce(system, '') AS system", "coalesce(prompt, '') AS prompt", "CAST(temperature AS DOUBLE) AS temperature", "CAST(max_tokens AS INT) AS max_tokens")
    return plain.mapInPandas(run, f"key string, {REPLY}")


def replies(spark, root: str, buckets: int = 64) -> KeyedStore:
    """The store of replies at a path."""
    return KeyedStore(spark, root, REPLY, buckets)


def _call_missing(asked: DataFrame, keys: DataFrame, store: KeyedStore, connector: Connector, in_flight: int = IN_FLIGHT, threads: int = THREADS, wave: int = WAVE, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, DataFrame] | None:
    """Calls for the requests that the store lacks and keeps the replies, wave by wave. Returns their keys and the requests as written, one a key; None if none was lacking.

    Texts are shuffled once, into as many parts as a wave has tasks for each wave, so that no task's share grows with the table; a part belongs to one wave, which reads its own.
    """
    known = store.get(keys).where("found and error is null").select("key")
    missing = written(keys.join(known, "key", "left_anti"), "missing")
    n = missing.count()
    if n == 0:
        return None
    waves = min(WAVES, -(-n // wave))
    threads = min(threads, in_flight)
    tasks = in_flight // threads
    parts, lacking = tasks * waves, n < keys.count()
    wanted = asked.select("key", *REQUEST)
    if lacking and n <= SENT:
        wanted = wanted.join(F.broadcast(missing), "key", "left_semi")
    dealt = wanted.repartition(parts, "key")
    if lacking and n > SENT:
        dealt = dealt.join(missing.repartition(parts, "key").hint("shuffle_hash"), "key", "left_semi")
    one = dealt.dropDuplicates(["key"]).withColumn("wave", F.spark_partition_id() % waves)
    path = f"{shared_folder(store.spark)}/requests-{uuid.uuid4().hex[:12]}"
    one.write.partitionBy("wave").option("maxRecordsPerFile", max(1, wave // (4 * tasks))).parquet(path)  # files that Spark does not split, so that the tasks of a wave get like shares
    every = store.spark.read.schema(one.schema).parquet(path)
    for w in range(waves):
        store.put(called(every.where(F.col("wave") == w).coalesce(tasks), connector, threads, sleep), distinct=True)
    return missing, every.drop("wave")


def _keys(asked: DataFrame) -> DataFrame:
    return written(asked.select("key").distinct(), "keys")


def _offline(out: DataFrame) -> DataFrame:
    """out, stopping the job that reads it at a request without a reply."""
    stop = F.raise_error(F.concat(F.lit(f"{OfflineMiss.__name__}: no reply for model="), F.coalesce(F.col("model").cast("string"), F.lit("")), F.lit(" key="), F.substring("key", 1, 12)))
    return out.withColumn("text", F.when(F.col("found") & F.col("error").isNull(), F.col("text")).otherwise(stop.cast("string")))


def complete(requests: DataFrame, store: KeyedStore, connector: Connector | None = None, **how) -> DataFrame:
    """requests with key, found and the columns of REPLY.

    Without a connector no call is made, and the job that reads the rows stops at a request that the store lacks. With
    one, misses are called (in_flight, threads, wave and sleep say how) and kept; a call that failed to the end leaves its error in the store, which the next
    run takes for a miss. Null prompts are empty ones; repeated rows share a reply; an empty table makes no call.
    """
    asked = keyed(requests)
    keys = _keys(asked)
    if connector is not None:
        _call_missing(asked, keys, store, connector, **how)
    out = store.get(asked, among=keys)
    return out if connector is not None else _offline(out)


def json_object(text: str):
    """The JSON object of a reply, whole or between its first and last brace; null if there is none."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.size(F.json_object_keys(body)) >= 0, body)


def _requests_of(bad: DataFrame, asked: DataFrame, sent: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """The requests of bad(key), as _first and the columns of a request: those of sent as they were written, so that texts are made anew only for keys that were not called for."""
    among = lambda rows, keys, n: rows.select(F.col("key").alias("_first"), *REQUEST).join(F.broadcast(keys) if n <= SENT else keys, F.col("_first") == F.col("key"), "left_semi")
    n = bad.count()
    if sent is None:
        return among(asked, bad, n)
    rest = written(bad.join(sent[0], "key", "left_anti"), "unsent")
    more = rest.count()
    found = among(sent[1], bad, n)
    return found.unionByName(among(asked, rest, more)) if more else found


def complete_json(requests: DataFrame, store: KeyedStore, connector: Connector | None = None, keep: list[str] | None = None, **how) -> DataFrame:
    """complete() with parsed, a JSON object or null, and parse_failed; replies without one are asked for once more in plain words.

    keep names the columns of requests that are wanted beside key and model; they are written with the key, so that texts are not read and hashed again for the result.
    """
    asked = keyed(requests)
    wanted = asked if keep is None else written(asked.select(*dict.fromkeys([*keep, "key", "model"])), "asked")
    keys = _keys(wanted)
    sent = _call_missing(asked, keys, store, connector, **how) if connector is not None else None
    bad = written(store.get(keys).where(F.col("found") & F.col("error").isNull() & json_object("text").isNull()).select("key"), "unparsed")
    again = written(keyed(_requests_of(bad, asked, sent).withColumn("prompt", F.concat(F.coalesce("prompt", F.lit("")), F.lit(ONLY_JSON)))), "again")
    seconds = _keys(again)
    if connector is not None:
        _call_missing(again, seconds, store, connector, **how)
    pairs = again.select("_first", "key", "model").dropDuplicates(["_first"])
    found = store.get(pairs, among=seconds)
    found = (found if connector is not None else _offline(found)).select(F.col("_first").alias("key"), json_object("text").alias("_second"))
    out = store.get(wanted, among=keys)
    out = (out if connector is not None else _offline(out)).join(found, "key", "left")
    return out.withColumn("parsed", F.coalesce(json_object("text"), "_second")).drop("_second").withColumn("parse_failed", F.col("parsed").isNull())
