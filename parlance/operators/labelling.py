"""Passes of labels by a model over a table of messages, all by one operator.

A pass says what is asked for, in how many tokens, with how much context and whether the options are shuffled for each message.
Pass A over a sample takes no calls: it is the full pass A projected onto the sample's ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import patterns as P
from parlance.operators.client import Connector, complete_json
from parlance.sources.store import KeyedStore

SEED = "20260909"


@dataclass(frozen=True)
class Pass:
    """fields: what the answer holds beside the intent; turns, chars: earlier turns shown, and how much of each."""

    fields: tuple[str, ...]
    max_tokens: int
    turns: int = 3
    chars: int = 200
    shuffled: bool = False


FULL = ("escalate", "reason", "must_include", "must_not_include", "difficulty", "notes")
PASSES = {
    "A-full": Pass(FULL, 320),
    "B": Pass(FULL, 320, shuffled=True),
    "C": Pass(("escalate", "reason", "difficulty", "notes"), 220),
    "corpus": Pass(("confidence",), 60, turns=2, chars=180),
    "dev": Pass(("escalate", "reason", "difficulty"), 320),
}
#: How each field is asked for.
ASKS = {
    "confidence": '"confidence": 0 to 1', "escalate": '"escalate": true or false', "reason": '"escalate_reason_code": a code or empty', "must_include": '"reply_must_include": up to 3 strings',
    "must_not_include": '"reply_must_not_include": up to 3 strings', "difficulty": '"difficulty": easy, medium or hard', "notes": '"notes": under 20 words',
}


def requests(rows: DataFrame, codebook: DataFrame, name: str, model: str) -> DataFrame:
    """rows(id, text, context array<string>) as (id, model, system, prompt, temperature, max_tokens); codebook(intent, definition) has a row an intent."""
    p = PASSES[name]
    book = codebook.agg(F.array_sort(F.collect_list(F.struct("intent", F.coalesce("definition", F.lit("")).alias("definition")))).alias("_book"))  # one row of a taxonomy's size
    last = lambda x: (x["intent"] == "other").cast("int")
    salt = lambda x: F.md5(F.concat_ws("-", F.lit(SEED), F.col("id").cast("string"), x["intent"])) if p.shuffled else x["intent"]
    placed = F.array_sort(F.transform("_book", lambda x: F.struct(last(x).alias("last"), salt(x).alias("salt"), x["intent"].alias("intent"), x["definition"].alias("definition"))))
    options = F.array_join(F.transform(placed, lambda x: F.concat(F.lit("- "), x["intent"], F.lit(": "), x["definition"])), "\n")
    asks = ", ".join(['"intent": one of the intents', *[ASKS[f] for f in p.fields]])
    system = F.concat(F.lit("Give a customer's message exactly one intent, by what the customer wants resolved.\n\n"), options, F.lit(f"\n\nReturn one JSON object only: {{{asks}}}"))
    if not p.shuffled:  # one text for all rows, made once
        book, system = book.select(system.alias("_system")), F.col("_system")
    turns = F.slice(F.filter(F.coalesce("context", F.array().cast("array<string>")), lambda c: c.isNotNull()), 1, p.turns)
    earlier = F.when(F.size(turns) > 0, F.concat(F.lit("EARLIER TURNS:\n"), F.array_join(F.transform(turns, lambda c: F.concat(F.lit("- "), F.substring(c, 1, p.chars))), "\n"), F.lit("\n\n"))).otherwise("")
    prompt = F.concat(earlier, F.lit('MESSAGE:\n"'), F.coalesce("text", F.lit("")), F.lit('"'))
    return rows.crossJoin(F.broadcast(book)).select("id", F.lit(model).alias("model"), system.alias("system"), prompt.alias("prompt"), F.lit(0.0).alias("temperature"), F.lit(p.max_tokens).alias("max_tokens"))


def labels(rows: DataFrame, codebook: DataFrame, name: str, model: str, store: KeyedStore, connector: Connector | None = None, **how) -> DataFrame:
    """(id, intent, the fields of the pass, labeler, parse_failed) of every row.

    An answer without an object, or with an intent that is none, is `other`; a confidence that is no number is 0.0; lists keep
    three entries, notes 160 characters, and an unnamed difficulty is medium. Without a connector a missing reply stops the job.
    """
    p = PASSES[name]
    said = complete_json(requests(rows, codebook, name, model), store, connector, keep=["id"], **how)
    typed = F.from_json("parsed", "confidence double, escalate boolean, reply_must_include array<string>, reply_must_not_include array<string>")
    raw = lambda k: F.get_json_object("parsed", f"$.{k}")
    listed = lambda k: F.slice(F.coalesce(F.col("_typed")[k], F.array().cast("array<string>")), 1, 3)
    truthy = F.coalesce(F.col("_typed")["escalate"], ~F.coalesce(raw("escalate"), F.lit("")).isin("", "0", "0.0", "null", "[]", "{}"))
    made = {
        "confidence": F.coalesce(F.col("_typed")["confidence"], F.lit(0.0)), "escalate": truthy, "reason": F.coalesce(raw("escalate_reason_code"), F.lit("")),
        "must_include": listed("reply_must_include"), "must_not_include": listed("reply_must_not_include"),
        "difficulty": F.coalesce(raw("difficulty"), F.lit("medium")), "notes": F.substring(F.coalesce(raw("notes"), F.lit("")), 1, 160),
    }
    intent = F.when(raw("intent").isin(P.INTENTS), raw("intent")).otherwise("other")
    return said.withColumn("_typed", typed).select("id", intent.alias("intent"), *[made[f].alias(f) for f in p.fields], F.lit(f"pass_{name}:{model}").alias("labeler"), "parse_failed")


def projected(full: DataFrame, sample: DataFrame) -> DataFrame:
    """Pass A over sample(id): the rows of the full pass; the job stops at an id that the full pass lacks."""
    there = full.withColumn("_there", F.lit(True))
    out = sample.select("id").join(there, "id", "left")
    stop = F.raise_error(F.concat(F.lit("no row in the full pass for id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return out.withColumn("intent", F.when(F.col("_there"), F.col("intent")).otherwise(stop.cast("string"))).drop("_there")
