"""Routing rules, the decision cascade and the baselines."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.catalog import query
from parlance.functions import patterns as P
from parlance.functions import text as T
from parlance.functions.dialect import DUCK, SPARK
from parlance.operators.client import ONLY_JSON, replies
from parlance.operators.labelling import labels
from parlance.operators.tables import shared_folder
from parlance.plans.common import both, messages, run_sql
from parlance.plans.metrics import D
from parlance.sources.store import KeyedStore

BLOB = "CASE WHEN has_context THEN concat(text, ' ', context) ELSE text END"


def heads(d, source: str | None = None, sim: str | None = None, intent: str | None = None, confidence: str | None = None) -> str:
    """h(id, blob, intent, confidence, sim, verdict columns): messages with the outputs of the model heads, as a replay table would hold them."""
    intents = d.array(*[f"'{i}'" for i in P.INTENTS])
    codes = d.array("'troubleshooting_already_failed'", "'requires_account_specific_pii'", "NULL")
    return f"""{source or messages(d)}, h AS (SELECT id, text, {BLOB} AS blob, {intent or d.at(intents, 'id % 11 + 1')} AS intent, {confidence or D('(id * 7919) % 1000') + ' / 1000'} AS confidence, {sim or D('(id * 31) % 997') + ' / 997'} AS sim,
  id % 23 <> 0 AS parsed, id % 6 = 1 AS model_escalates, {d.at(codes, 'id % 3 + 1')} AS model_code, CASE WHEN id % 5 = 0 THEN 0.5 ELSE {D('id % 100')} / 100 END AS model_confidence FROM m)"""


def corroborated(d) -> str:
    return f"CASE WHEN intent = 'billing_charge_dispute' AND {d.like('blob', P.MONEY)} THEN 'billing_dispute' WHEN intent = 'account_access_login' AND {d.like('blob', P.SECURITY)} THEN 'suspected_account_compromise' END"


@both("route_rules")
def _(d):
    return f"WITH {heads(d)} SELECT id, {T.first_rule(d, 'blob', P.RULES)} AS code, {T.first_span(d, 'blob', P.RULES)} AS span FROM h"


@both("route_corroborated")
def _(d):
    return f"WITH {heads(d)} SELECT id, intent, {corroborated(d)} AS code FROM h"


@both("route_model_layer")
def _(d):
    return f"""WITH {heads(d)} SELECT id, CASE WHEN NOT parsed OR model_escalates THEN 'escalate' ELSE 'auto' END AS route,
  CASE WHEN NOT parsed THEN 'low_model_confidence' WHEN model_escalates THEN coalesce(model_code, 'requires_account_specific_pii') ELSE 'informational_answer' END AS code, CASE WHEN parsed THEN model_confidence ELSE 0 END AS confidence FROM h"""


@both("route_gates")
def _(d):
    return f"WITH {heads(d)} SELECT id, CASE WHEN confidence < 0.1 THEN 'low_model_confidence' WHEN sim < 0.3 THEN 'no_retrieval_support' END AS gate FROM h"


def cascade(d, tau: float = 0.0, sigma: float = 0.3, source: str | None = None, sim: str | None = None, intent: str | None = None, confidence: str | None = None) -> str:
    """c(id, layer, code): the first layer that decides, and its code."""
    return f"""{heads(d, source, sim, intent, confidence)}, r AS (SELECT *, {T.first_rule(d, 'blob', P.RULES)} AS rule, {corroborated(d)} AS joined FROM h),
c AS (SELECT id, text, intent, confidence, sim, model_confidence, parsed, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN joined IS NOT NULL THEN 'intent_rule' WHEN NOT parsed OR model_escalates THEN 'model' WHEN confidence < {tau} OR sim < {sigma} THEN 'gate' ELSE 'model' END AS layer,
  CASE WHEN rule IS NOT NULL THEN rule WHEN joined IS NOT NULL THEN joined WHEN NOT parsed THEN 'low_model_confidence' WHEN model_escalates THEN coalesce(model_code, 'requires_account_specific_pii')
    WHEN confidence < {tau} THEN 'low_model_confidence' WHEN sim < {sigma} THEN 'no_retrieval_support' ELSE 'informational_answer' END AS code FROM r)"""


@both("route_cascade")
def _(d):
    sentence = " ".join(f"WHEN '{k}' THEN {d.lit(v)}" for k, v in P.SENTENCES.items())
    auto = ", ".join(f"'{c}'" for c in P.AUTO_CODES)
    return f"""WITH {cascade(d)} SELECT id, CASE WHEN code IN ({auto}) THEN 'auto' ELSE 'escalate' END AS route, code, layer, CASE code {sentence} END AS sentence,
  CASE WHEN layer IN ('rule', 'intent_rule') THEN 1 WHEN layer = 'gate' THEN CASE WHEN code = 'low_model_confidence' THEN confidence ELSE round(sim, 6) END WHEN parsed THEN model_confidence ELSE 0 END AS confidence FROM c"""


@both("route_rollup")
def _(d):
    return f"WITH {cascade(d)} SELECT layer, code, count(*) AS n FROM c GROUP BY layer, code"


@both("baseline_b0")
def _(d):
    """The majority intent, one canned reply and always a human."""
    return f"""WITH {heads(d)}, t AS (SELECT intent FROM (SELECT intent, count(*) AS n, min(id) AS f FROM h GROUP BY intent) g ORDER BY n DESC, f LIMIT 1)
SELECT h.id, t.intent, {d.lit(P.CANNED)} AS reply, 'escalate' AS route, 'low_model_confidence' AS code, {D('0')} AS max_sim, {D('1')} AS confidence FROM h, t"""


@both("baseline_b1_rules")
def _(d):
    return f"WITH {heads(d)}, k AS (SELECT id, {T.first_rule(d, 'blob', P.KEYWORD_RULES)} AS code FROM h) SELECT id, CASE WHEN code IS NULL THEN 'auto' ELSE 'escalate' END AS route, coalesce(code, 'known_troubleshooting_flow') AS code, CASE WHEN code IS NULL THEN {D('0.5')} ELSE {D('1')} END AS confidence FROM k"


@both("validate_grounding")
def _(d):
    hits, used = d.array("'a'", "'b'", "'c'"), d.array("'b'", "'z'", "'b'", "concat('', CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'q' END)")
    kept = d.filter(used, "g", d.has(hits, "g"))
    return f"SELECT doc_id AS id, {d.join(kept, ',')} AS grounded_in, {d.size(kept)} > 0 AND doc_id % 3 <> 0 AS used_retrieval FROM documents"


def _keys(d) -> str:
    return d.sha256("concat('mini|', text)")


def _lookup(d) -> str:
    return f"""WITH {messages(d)}, p AS (SELECT id, {_keys(d)} AS k FROM m), c AS (SELECT DISTINCT {_keys(d)} AS k, length(text) AS answer FROM m WHERE id % 3 <> 0)
SELECT p.id, c.k IS NOT NULL AS hit, coalesce(c.answer, -1) AS answer FROM p LEFT JOIN c ON p.k = c.k"""


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, KeyedStore]:
    """The messages of a table by key, and a store that holds the answers to two of three."""
    asked = run_sql(spark, sf_dir, f"WITH {messages(SPARK)} SELECT id, {_keys(SPARK)} AS key, CAST(length(text) AS BIGINT) AS size FROM m")
    store = KeyedStore(spark, f"{shared_folder(spark)}/answers-{uuid.uuid4().hex[:12]}", "answer long")
    store.put(asked.where("id % 3 <> 0").select("key", F.col("size").alias("answer")))
    return asked, store


@query("cache_lookup", _lookup(DUCK))
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of keys against the keyed store: each key's answer, or -1."""
    asked, store = _cached(spark, sf_dir)
    return store.get(asked.select("id", "key")).selectExpr("id", "found AS hit", "coalesce(answer, -1) AS answer")


@query("cache_miss_count", f"WITH {messages(DUCK)}, c AS (SELECT {_keys(DUCK)} AS k FROM m WHERE id % 3 <> 0) SELECT count(*) AS misses FROM (SELECT {_keys(DUCK)} AS k FROM m) p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = p.k)")
def cache_miss_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without an answer in the keyed store."""
    asked, store = _cached(spark, sf_dir)
    return store.get(asked.select("id", "key")).agg(F.count_if(~F.col("found")).alias("misses"))


class EchoModel:
    """Stands for a model where none can be called: a verdict by the hash of the message, in prose for a tenth of the messages until it is asked for JSON only, and for a twentieth then too."""

    def ask(self, model, system, prompt, temperature, max_tokens):
        message = prompt[prompt.index('MESSAGE:\n"') + 10 : prompt.rindex('"')]
        h = int(hashlib.md5(message.encode()).hexdigest()[:8], 16)
        if h % 20 == 0 or (h % 10 == 0 and not prompt.endswith(ONLY_JSON)):
            return "I can't tell.", len(prompt) // 4, 4
        verdict = {"intent": [*P.INTENTS, "made_up"][h % (len(P.INTENTS) + 1)], "confidence": h % 100 / 100 if h % 7 else "high"}
        return f"Here it is: {json.dumps(verdict)}", len(prompt) // 4, 12


def _corpus_labels(d) -> str:
    intents = d.array(*[f"'{i}'" for i in P.INTENTS], "'other'")
    return f"""WITH {messages(d)}, h AS (SELECT id, {d.hex32('text')} AS h FROM m) SELECT id, CASE WHEN h % 20 = 0 THEN 'other' ELSE {d.at(intents, f'h % {len(P.INTENTS) + 1} + 1')} END AS intent,
  CASE WHEN h % 20 = 0 OR h % 7 = 0 THEN 0 ELSE {D('h % 100')} / 100 END AS confidence, h % 20 = 0 AS parse_failed FROM h"""


@query("label_corpus", _corpus_labels(DUCK))
def label_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pass over all messages: requests, calls from the executors behind the store of replies, a second request where the first reply holds no object."""
    rows = run_sql(spark, sf_dir, f"WITH {messages(SPARK)} SELECT id, text, CAST(array() AS ARRAY<STRING>) AS context FROM m")
    book = spark.createDataFrame([(i, i.replace("_", " ")) for i in P.INTENTS], "intent string, definition string")
    store = replies(spark, f"{shared_folder(spark)}/replies-{uuid.uuid4().hex[:12]}")
    return labels(rows, book, "corpus", "stub", store, EchoModel()).select("id", "intent", "confidence", "parse_failed")


@both("draft_head")
def _(d):
    """Drafts from replayed answers: a fixed reply where there was none, else the answer cut to its limit and the ids among those retrieved, in order and with repeats."""
    hits, used = d.array("'a'", "'b'", "'c'"), d.array("'b'", "'z'", "'b'", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'q' END")
    return f"""WITH {heads(d)}, g AS (SELECT id, parsed, {T.trim(d, 'text')} AS reply, CASE WHEN id % 5 = 0 THEN {d.filter(used, 'g', "g = 'never'")} ELSE {d.filter(used, 'g', d.has(hits, 'g'))} END AS kept FROM h)
SELECT id, NOT parsed AS failed, CASE WHEN parsed THEN {T.truncate_reply(d, 'reply')} ELSE {d.lit(P.HANDED_ON)} END AS reply, parsed AND length(reply) > {P.REPLY_CHARS} AS truncated, CASE WHEN parsed THEN {d.join('kept', ',')} ELSE '' END AS grounded_in, parsed AND id % 3 <> 0 AND {d.size('kept')} > 0 AS used_retrieval FROM g"""
