"""Scalar text functions as SQL expressions: each takes a dialect and the expression of its text."""

from __future__ import annotations

from parlance.functions import patterns as P


def trim(d, x: str) -> str:
    """White space of any kind off both ends."""
    return d.trim(x)


def any_of(d, x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(d.said("said", x, p, P.FUNCTION_WORDS) for p in patterns) + ")"


def hits(d, x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST({d.said('said', x, p, P.FUNCTION_WORDS)} AS INT)" for p in patterns) + ")"


def norm_id(d, x: str) -> str:
    s = f"trim({x})"
    return f"CASE WHEN {s} IN ('', 'nan', 'NaN', 'None', '<NA>') THEN '' ELSE {d.replace(s, '^([0-9]+)[.]0$', '$1')} END"


def split_children(d, x: str) -> str:
    parts = f"split({norm_id(d, x)}, ',')" if d.name == "spark" else f"string_split({norm_id(d, x)}, ',')"
    return d.filter(d.map(parts, "c", norm_id(d, "c")), "c", "c <> ''")


def strip_mention(d, x: str, brand: str = "brandcare") -> str:
    return d.replace(x, f"@{brand}\\b", " ", "i")


def signature(d, x: str) -> str:
    s = d.group(d.replace(x, r"\s+$", ""), P.SIGNATURE, 1)
    return f"CASE WHEN length({s}) > 4 AND {s} <> upper({s}) THEN '' ELSE {s} END"


def without_signature(d, x: str) -> str:
    return f"CASE WHEN {signature(d, x)} = '' THEN {x} ELSE {d.replace(d.replace(d.replace(x, r'\s+$', ''), P.SIGNATURE, ''), r'\s+$', '')} END"


def scrub_pii(d, x: str) -> str:
    x = d.replace(x, P.URL, " <URL> ", "i")
    for pattern, tag in ((P.EMAIL, "EMAIL"), (P.PHONE, "PHONE"), (P.HANDLE, "USER"), (P.LONG_NUMBER, "NUM")):
        x = d.replace(x, pattern, f" <{tag}> ")
    return x


def normalise(d, x: str) -> str:
    """Entities, repeated punctuation and white space; of text that is already NFKC (parlance.functions.unicode has that step)."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        x = f"replace({x}, '{a}', '{b}')"
    for c in "!?.,":
        x = d.replace(x, f"[{c}]{{3,}}", c + c)
    return trim(d, d.replace(x, r"\s+", " "))


def clean_customer(d, x: str) -> str:
    return normalise(d, scrub_pii(d, strip_mention(d, x)))


def clean_brand(d, x: str) -> str:
    return normalise(d, scrub_pii(d, without_signature(d, strip_mention(d, x))))


def is_english(d, x: str) -> str:
    """Few letters of other scripts, eight Latin letters or more, and a function word, itself or with a final s taken off."""
    latin, other = d.count(x, "[A-Za-z]"), d.count(x, P.NON_LATIN)
    known = d.array(*[f"'{w}'" for w in P.FUNCTION_WORDS])

    def said(low: str) -> str:
        words = d.map(d.find_all(low, "[a-z']+"), "w", "replace(w, '''', '')" if d.name == "duck" else 'replace(w, "\'", "")')
        shorter = d.map(d.filter(words, "w", "w LIKE '%s' AND length(w) > 2"), "w", "substr(w, 1, length(w) - 1)")
        return d.overlap(d.concat_lists(words, shorter), known)

    unlike = d.foreign(x, f"{other} >= 3 AND {other} > {latin} * CAST(0.2 AS DOUBLE)")
    return f"(NOT ({unlike}) AND {d.enough(x, 'A-Za-z', 8)} AND {d.early(f'lower({x})', said)})"


def tokens(d, x: str) -> str:
    return d.filter(d.find_all(x, r"[^ \t\n\r\f]+"), "w", "w NOT IN ('<URL>', '<USER>')")


def token_count(d, x: str) -> str:
    return d.size(tokens(d, x))


def dedupe_key(d, x: str) -> str:
    return d.sha1(f"trim({d.replace(d.replace(f'lower({x})', '[^a-z0-9 ]', ''), ' +', ' ')})")


def terms(d, x: str) -> str:
    return d.find_all(f"lower({x})", "[a-z0-9]+")


def quality_reason(d, x: str) -> str:
    return f"CASE WHEN NOT {is_english(d, x)} THEN 'non_english' WHEN {token_count(d, x)} < {P.MIN_TOKENS} THEN 'too_short' ELSE 'kept' END"


def reply_parts(d, x: str) -> dict[str, str]:
    """The points and the signal of each family of a trimmed reply, in order; a column said stands beside it where the dialect has one."""
    t, verbs = x, hits(d, x, P.TROUBLESHOOT)
    return {
        "troubleshoot": (f"least(2, {verbs})", f"concat('troubleshoot:', {verbs})"),
        "link": (f"CASE WHEN {any_of(d, t, P.STRONG_LINK)} THEN 2 WHEN {any_of(d, t, P.WEAK_LINK)} THEN 1 ELSE 0 END", f"CASE WHEN {any_of(d, t, P.STRONG_LINK)} THEN 'support_link' ELSE 'shortened_link' END"),
        "feature": (f"CASE WHEN {any_of(d, t, P.FEATURE)} THEN 2 ELSE 0 END", "'feature_request_resolution'"),
        "policy": (f"CASE WHEN {any_of(d, t, P.POLICY)} THEN 2 ELSE 0 END", "'policy_explanation'"),
        "action": (f"CASE WHEN {any_of(d, t, P.ACTION)} THEN 2 ELSE 0 END", "'confirmed_action'"),
        "length": (f"CASE WHEN length({t}) >= 120 THEN 1 ELSE 0 END", "'substantive_length'"),
        "handoff": (f"CASE WHEN {any_of(d, t, P.HANDOFF)} THEN -2 ELSE 0 END", "'handoff'"),
        "ack": (f"CASE WHEN length({t}) < 90 AND {any_of(d, t, P.ACK_ONLY)} THEN -1 ELSE 0 END", "'ack_only'"),
    }


def score_reply(d, x: str, source: str, keep: str) -> str:
    """SELECT keep columns, score and signals (joined by |) FROM source."""
    parts = reply_parts(d, "trimmed")
    inner = ", ".join(f"CAST({points} AS INT) AS p_{k}, {name} AS s_{k}" for k, (points, name) in parts.items())
    score = " + ".join(f"p_{k}" for k in parts)
    names = "concat_ws('|', " + ", ".join(f"CASE WHEN p_{k} <> 0 THEN s_{k} END" for k in parts) + ")"
    trimmed, said = f"SELECT *, {trim(d, x)} AS trimmed FROM {source}", d.among("trimmed", [p for family in P.REPLY_FAMILIES for p in family], P.FUNCTION_WORDS)
    words = f"SELECT *, {said} AS said FROM ({trimmed}) w" if said else trimmed
    return f"SELECT {keep}, {score} AS score, {names} AS signals FROM (SELECT {keep}, {inner} FROM ({words}) u) s"


def hard_flags(d, x: str, context: str) -> dict[str, str]:
    return {
        "negation": d.like(x, P.NEGATION), "sarcasm": d.like(x, P.SARCASM), "multi_intent": d.like(x, P.MULTI_INTENT),
        "very_short": f"{d.size(d.find_all(x, '[^ \\t\\n\\r\\f]+'))} <= 8", "escalation_trigger": d.like(x, P.TRIGGER), "has_context": context,
    }


def truncate_reply(d, x: str, limit: int = P.REPLY_CHARS) -> str:
    """At most limit characters, cut after a sentence that ends beyond three fifths of them, or with an ellipsis."""
    head = d.group(f"substr({x}, 1, {limit})", r"^(.*[.!?]\s)", 1, "s")
    return f"CASE WHEN length({x}) <= {limit} THEN {x} WHEN length({head}) > {limit} * 3 / 5 THEN {d.replace(head, r'\s+$', '')} ELSE concat({d.replace(f'substr({x}, 1, {limit - 1})', r'\s+$', '')}, '…') END"


def first_rule(d, x: str, rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {d.like(x, p)} THEN '{code}'" for code, p in rules) + f" ELSE {otherwise} END"


def first_span(d, x: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {d.like(x, p)} THEN {d.find(x, p)}" for _, p in rules) + " END"


def content_words(d, x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in P.MUST_STOP)
    return d.distinct(d.filter(d.find_all(f"lower({x})", "[a-z]+"), "w", f"w NOT IN ({stop}) AND length(w) > 2"))
