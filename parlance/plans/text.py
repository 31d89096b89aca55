"""Scalar text functions and the filters made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.catalog import query
from parlance.functions import patterns as P
from parlance.functions import text as T
from parlance.functions.dialect import ASCII, SPARK
from parlance.functions.unicode import nfkc
from parlance.plans.common import PHRASES, both, brand, messages
from parlance.session import ship, table


def simple(name: str, expression, column: str, source: str = "text"):
    @both(name, ASCII)
    def _(d):
        return f"WITH {messages(d)} SELECT id, {expression(d, source)} AS {column} FROM m"


simple("strip_mention", T.strip_mention, "stripped")
simple("signature", T.signature, "signature", "reply")
simple("scrub_pii", T.scrub_pii, "scrubbed")
simple("normalise", T.normalise, "normalised")
simple("clean_customer", T.clean_customer, "cleaned")
simple("clean_brand", T.clean_brand, "cleaned", "reply")
simple("english_filter", T.is_english, "is_english")
simple("token_count", T.token_count, "n_tokens")
simple("dedupe_key", T.dedupe_key, "dedupe_key")
simple("truncate_reply", T.truncate_reply, "reply")


@both("tokenize")
def _(d):
    return f"WITH {messages(d)} SELECT id, {d.join(T.terms(d, 'text'), ' ')} AS terms, {d.size(T.terms(d, 'text'))} AS n FROM m"


@both("norm_id")
def _(d):
    raw = d.array("'2'", "' 456 '", "'123.0'", "'nan'", "'None'", "'<NA>'", "''", "'12.50'", "'abc.0'")
    return f"SELECT doc_id AS id, {T.norm_id(d, d.at(raw, 'doc_id % 9 + 1'))} AS norm_id FROM documents"


@both("split_children")
def _(d):
    raw = d.array("'2, 3 ,4'", "''", "'7.0,nan, 8'", "'nan'", "',,5'")
    return f"SELECT doc_id AS id, {d.join(T.split_children(d, d.at(raw, 'doc_id % 5 + 1')), '|')} AS children FROM documents"


@both("quality_reason", ASCII)
def _(d):
    return f"""WITH {messages(d)}, c AS (SELECT id, {T.clean_customer(d, 'text')} AS cleaned FROM m), r AS (SELECT {T.quality_reason(d, 'cleaned')} AS reason FROM c)
SELECT reason, count(*) AS n FROM r GROUP BY reason"""


@both("score_reply", ASCII)
def _(d):
    return f"WITH {messages(d)} " + T.score_reply(d, "reply", "m", "id")


@both("score_message", ASCII)
def _(d):
    return f"WITH {messages(d)} " + T.score_reply(d, "text", "m", "id")


@both("resolution_filter", ASCII)
def _(d):
    return f"WITH {messages(d)}, s AS ({T.score_reply(d, 'reply', 'm', 'id')}) SELECT id, score FROM s WHERE score >= 2"


@both("score_distribution", ASCII)
def _(d):
    return f"""WITH {messages(d)}, s AS ({T.score_reply(d, 'reply', 'm', 'id')}), g AS (SELECT score, count(*) AS n FROM s GROUP BY score)
SELECT score, n, round(CAST(sum(n) OVER (ORDER BY score DESC) AS DOUBLE) / sum(n) OVER (), 6) AS share_at_or_above FROM g"""


@both("hard_flags", ASCII)
def _(d):
    flags = T.hard_flags(d, "text", "has_context")
    names = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in flags.items())
    return f"WITH {messages(d)} SELECT id, concat_ws('|', {names}) AS flags FROM m"


def is_hard(d) -> str:
    f = T.hard_flags(d, "text", "has_context")
    return f"({f['sarcasm']} OR {f['multi_intent']} OR {f['very_short']} OR {f['escalation_trigger']} OR ({f['negation']} AND has_context))"


@both("is_hard", ASCII)
def _(d):
    return f"WITH {messages(d)} SELECT id, {is_hard(d)} AS is_hard FROM m"


@both("must_include")
def _(d):
    reply, item, never = T.content_words(d, "reply"), T.content_words(d, "context"), T.content_words(d, "text")
    share = lambda: f"CAST({d.size(d.filter('iw', 'w', d.has('rw', 'w')))} AS DOUBLE) / nullif({d.size('iw')}, 0)"
    against = f"CAST({d.size(d.filter('nw', 'w', d.has('rw', 'w')))} AS DOUBLE) / nullif({d.size('nw')}, 0)"
    return f"""WITH {messages(d)}, w AS (SELECT id, {reply} AS rw, {item} AS iw, {never} AS nw FROM m)
SELECT id, coalesce({share()} >= 0.5, false) AS included, coalesce({against} >= 0.6, false) AS violated, round({share()}, 6) AS rate FROM w"""


@both("build_prompt")
def _(d):
    """The last three of the earlier turns, the message and the known replies, each cut to its limit."""
    line = chr(10) if d.name == "duck" else chr(92) + "n"
    turn = lambda k: d.at(brand(d), f"(id * {k} + 5) % {len(PHRASES)} + 1")
    last = f"slice({d.array(*map(turn, (11, 3, 17, 23)))}, greatest(n - 3, 0) + 1, least(n, 3))" if d.name == "spark" else f"({d.array(*map(turn, (11, 3, 17, 23)))})[greatest(n - 3, 0) + 1 : n]"
    earlier = d.join(d.map("turns", "t", "concat('Earlier: ', substr(t, 1, 200))"), line)
    known = d.join(d.map(d.array("reply", "context"), "r", "concat('Known reply: ', substr(r, 1, 240))"), line)
    return f"""WITH {messages(d)}, n AS (SELECT id, text, reply, context, CAST(id % 5 AS INT) AS n FROM m), t AS (SELECT *, {last} AS turns FROM n)
SELECT id, concat_ws('{line}', CASE WHEN n > 0 THEN {earlier} END, concat('Message: ', substr(text, 1, 300)), {known}) AS prompt FROM t"""


@both("json_extract")
def _(d):
    raw = d.array("""'```json {"intent":"other","confidence":0.5} ```'""", """'{"intent":"praise_or_chitchat"}'""", "'no object here'", """'text {"intent": "x", "confidence": "high"} tail'""", """'{"a": {"intent": 1}}'""")
    body = d.group("raw", r"(\{.*\})", 1, "s")
    field = (lambda k: f"get_json_object(body, '$.{k}')") if d.name == "spark" else (lambda k: f"json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.{k}')")
    return f"""WITH r AS (SELECT doc_id AS id, {d.at(raw, 'doc_id % 5 + 1')} AS raw FROM documents), b AS (SELECT id, {body} AS body FROM r)
SELECT id, body, body <> '' AS is_object, {field('intent')} AS intent, {d.number(field('confidence'))} AS confidence FROM b"""


@both("cache_key")
def _(d):
    return f"WITH {messages(d)} SELECT id, {d.sha256(f'concat_ws(chr(31), {d.lit('mini')}, text, {d.text('id % 3')})')} AS cache_key FROM m"


@both("probe_counts", ASCII)
def _(d):
    hits = [f"CAST(sum(CAST({d.like('text', p)} AS INT)) AS BIGINT) AS {k}" for k, p in P.PROBES.items()]
    praise = f"CAST(sum(CAST({d.like('text', P.PRAISE)} AND NOT {d.like('text', P.NOT_PRAISE)} AS INT)) AS BIGINT) AS praise_or_chitchat"
    return f"WITH {messages(d)} SELECT count(*) AS total, {', '.join(hits)}, {praise} FROM m"


@both("dedupe_first", ASCII)
def _(d):
    return f"""WITH {messages(d)}, k AS (SELECT id, {T.dedupe_key(d, T.clean_customer(d, 'text'))} AS k FROM m)
SELECT id, k AS dedupe_key FROM (SELECT id, k, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM k) x WHERE r = 1"""


@both("non_empty_reply", ASCII)
def _(d):
    return f"WITH {messages(d)} SELECT id, {T.clean_brand(d, 'reply')} AS cleaned FROM m WHERE {T.trim(d, T.clean_brand(d, 'reply'))} <> ''"


@both("any_contains")
def _(d):
    return f"WITH {messages(d)} SELECT coalesce(bool_or(text LIKE '%SYNTHETIC%'), false) AS is_synthetic, bool_or(text LIKE '%charged%') AS has_charged FROM m"


@both("longest_reply")
def _(d):
    return f"""WITH {messages(d)} SELECT g, reply FROM (SELECT id % 50 AS g, reply, row_number() OVER (PARTITION BY id % 50 ORDER BY length(reply) DESC, id) AS r FROM m) x WHERE r = 1"""


@both("thread_resolution_score", ASCII)
def _(d):
    return f"""WITH {messages(d)}, s AS ({T.score_reply(d, 'reply', 'm', 'id')}), r AS (SELECT id % 50 AS g, score, signals, row_number() OVER (PARTITION BY id % 50 ORDER BY score DESC, id) AS r FROM s)
SELECT g, greatest(0, score) AS score, CASE WHEN score > 0 THEN signals ELSE '' END AS signals FROM r WHERE r = 1"""


@both("best_reply_raw", ASCII)
def _(d):
    return f"""WITH {messages(d)}, s AS ({T.score_reply(d, 'reply', 'm', 'id, reply')}), r AS (SELECT id % 50 AS g, score, reply, row_number() OVER (PARTITION BY id % 50 ORDER BY score DESC, id) AS r FROM s)
SELECT g, score, reply FROM r WHERE r = 1"""


@both("first_signature", ASCII)
def _(d):
    return f"""WITH {messages(d)}, s AS (SELECT id, {T.signature(d, 'reply')} AS sig FROM m), r AS (SELECT id % 50 AS g, sig, row_number() OVER (PARTITION BY id % 50 ORDER BY id) AS r FROM s WHERE sig <> '')
SELECT g, sig FROM r WHERE r = 1"""


@both("viability_check", ASCII)
def _(d):
    return f"""WITH {messages(d)}, c AS (SELECT id, {T.clean_customer(d, 'text')} AS cleaned FROM m), r AS (SELECT {T.quality_reason(d, 'cleaned')} AS reason FROM c)
SELECT sum(CAST(reason = 'kept' AS INT)) >= 2000 AND avg(CAST(reason = 'kept' AS DOUBLE)) >= 0.15 AS viable, round(avg(CAST(reason = 'kept' AS DOUBLE)), 6) AS rate FROM r"""


@both("filter_validation", ASCII)
def _(d):
    return f"""WITH {messages(d)}, s AS ({T.score_reply(d, 'reply', 'm', 'id')}), p AS (SELECT score >= 2 AS pred, id % 3 = 0 OR score >= 3 AS gold FROM s WHERE id % 2 = 0),
c AS (SELECT CAST(sum(CAST(pred AND gold AS INT)) AS DOUBLE) AS tp, CAST(sum(CAST(pred AND NOT gold AS INT)) AS DOUBLE) AS fp, CAST(sum(CAST(NOT pred AND gold AS INT)) AS DOUBLE) AS fn, CAST(count(*) AS DOUBLE) AS n FROM p),
a AS (SELECT *, n - tp - fp - fn AS tn FROM c), k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (n - tp - fp) * (n - tp - fn)) / (n * n) AS pe FROM a)
SELECT round(tp / nullif(tp + fp, 0), 6) AS p, round(tp / nullif(tp + fn, 0), 6) AS r, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((po - pe) / greatest(1e-9, 1 - pe), 6) AS kappa FROM k"""


@query("normalise_unicode")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in NFKC, then normalised; the normaliser is Python's, so there is no SQL for it."""
    ship(spark)
    form = table(spark, sf_dir, "documents").select("doc_id", nfkc(F.col("text")).alias("text"))
    return form.selectExpr("doc_id AS id", f"{T.normalise(SPARK, 'text')} AS normalised")
