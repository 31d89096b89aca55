"""SQL fragments in the engine's own dialect and in that of the oracle, so that a query is stated once.

A query is a function of a dialect that returns SQL text. Spark runs it through Catalyst like any other plan.
"""

from __future__ import annotations

import re

#: Negated classes that Java's matcher takes ten times as long for as for what they leave out.
FASTER = {r"[^\x00-\x7F]": r"[\x{80}-\x{10FFFF}]", "[^a-z0-9 ]": r"[\x00-\x1F!-/:-`{-\x{10FFFF}]", r"[^ \t\n\r\f]+": r"[\x00-\x08\x0B\x0E-\x1F!-\x{10FFFF}]+"}


def held(pattern: str) -> str:
    """Letters that every match of a pattern holds as they stand, in lower case: the longest run outside classes, groups and what may be left out; empty if there is none."""
    rest = re.sub(r"\[[^\]]*\]", "\0", re.sub(r"\\.", "\0", pattern))
    while (inner := re.sub(r"\([^()]*\)", "\0", rest)) != rest:
        rest = inner
    rest = re.sub(r"[.^$+]", "\0", re.sub(r".(?:[?*]|\{[^}]*\})", "\0", rest))
    return "" if "|" in rest or not rest.isascii() else max(rest.lower().split("\0"), key=len)


#: What lies between words of letters in an ASCII text in lower case.
NO_LETTERS = r"[\x00-`{-\x7F]+"
#: In what spelled() returns: an end of a word, and what may be anything. Spellings at most.
END, ANY, SPELLINGS = "\0", "\1", 2000


def spelled(pattern: str) -> list[str]:
    """What a pattern spells, in lower case, with END where no letter can follow or precede and ANY for classes and repeats; [ANY] if there is too much of it."""

    def choice(k: int) -> tuple[list[str], int]:
        out, row = [], [""]
        while k < len(pattern) and pattern[k] != ")":
            if pattern[k] == "|":
                out, row, k = out + row, [""], k + 1
                continue
            item, k = one(k)
            row = [a + b for a in row for b in item] if len(row) * len(item) <= SPELLINGS else [ANY]
        return out + row, k + 1

    def one(k: int) -> tuple[list[str], int]:
        c = pattern[k]
        if c == "(":
            item, after = choice(k + 3 if pattern.startswith("(?:", k) else k + 1)
        elif c == "[":
            item, after = [ANY], pattern.index("]", k + 2) + 1
        elif c == "\\":
            letter, after = pattern[k + 1], k + 2
            item = [END if letter in "bs" else ANY if letter.isalnum() else letter]
        else:
            item, after = [END if c in "^$" else ANY if c == "." else c.lower()], k + 1
        if often := re.compile(r"(?:[?*+]|\{[^}]*\})[?+]?").match(pattern, after):
            item = ["", *item] if often[0] == "?" else item if often[0] == "+" and item == [END] else [ANY]
            after = often.end()
        return list(dict.fromkeys(item)), after

    if re.search(r"\(\?[^:]", pattern):
        return [ANY]
    out, end = choice(0)
    return out if end > len(pattern) else [ANY]


def one_of(pattern: str, common: list[str] = ()) -> list[str]:
    """Whole words of letters, one of which every match of a pattern holds; those of common, the most common first, only where there is no rarer one. Empty if there are no such words."""
    chosen, rank = set(), {w: k for k, w in enumerate(common)}
    for text in spelled(pattern):
        words = [m[1] for m in re.finditer(r"(?<=[^a-z\1])([a-z]+)(?=[^a-z\1])", text)]
        if not words or not text.isascii():
            return []
        chosen.add(max(words, key=lambda w: (rank.get(w, len(rank)), len(w), w)))
    return sorted(chosen)


class Spark:
    """Spark SQL. Regular expressions are Unicode-aware; ANSI mode is on, so divisions and casts are guarded."""

    name = "spark"

    def lit(self, s: str) -> str:
        return f'r"{s}"' if "'" in s else f"r'{s}'"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.lit('(?iU)' + pattern)})"

    def among(self, x: str, patterns: list[str], common) -> str:
        """A column for said(): which words of patterns a text has; empty if like() has no use for it."""
        return ""

    def said(self, column: str, x: str, pattern: str, common) -> str:
        """like(), by a column of among()."""
        return self.like(x, pattern)

    def find(self, x: str, pattern: str) -> str:
        return f"regexp_extract({x}, {self.lit('(?iU)' + pattern)}, 0)"

    def group(self, x: str, pattern: str, k: int, flags: str = "") -> str:
        return f"regexp_extract({x}, {self.lit('(?U' + flags + ')' + pattern)}, {k})"

    def replace(self, x: str, pattern: str, to: str, flags: str = "") -> str:
        return f"regexp_replace({x}, {self.lit('(?U' + flags + ')' + FASTER.get(pattern, pattern))}, {self.lit(to)})"

    def trim(self, x: str) -> str:
        """White space of any kind off both ends."""
        return self.replace(self.replace(x, r"^\s+", ""), r"\s+$", "")

    def find_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(FASTER.get(pattern, pattern))}, 0)"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.lit(pattern)})"

    def enough(self, x: str, kind: str, n: int) -> str:
        """Whether n or more characters are of a kind, [kind]; looks no further than the last that it needs."""
        return f"regexp_like({x}, {self.lit(f'(?:[{kind}][^{kind}]*+){{{n}}}')})"

    def foreign(self, x: str, cond: str) -> str:
        """cond, which no ASCII text meets; a CASE, as parts that occur twice behind an AND are computed ahead."""
        return f"CASE WHEN octet_length({x}) > length({x}) THEN {cond} ELSE false END"

    def early(self, x: str, cond) -> str:
        """cond(text), which holds if it holds of some first words already."""
        head = f"regexp_replace(substr({x}, 1, 400), {self.lit("[a-z']+$")}, '')"
        return f"CASE WHEN {cond(head)} THEN true ELSE {cond(x)} END"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def at(self, a: str, k: str) -> str:
        return f"element_at({a}, CAST({k} AS INT))"

    def size(self, a: str) -> str:
        return f"size({a})"

    def filter(self, a: str, v: str, cond: str) -> str:
        return f"filter({a}, {v} -> {cond})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def append(self, a: str, x: str) -> str:
        return f"array_append({a}, {x})"

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def range(self, a: str, b: str) -> str:
        """Integers from a up to and with b; b is at least a."""
        return f"sequence({a}, {b})"

    def concat_lists(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def text(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def hex32(self, x: str) -> str:
        """The first eight hex digits of md5 as a number."""
        return f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)"

    def sha1(self, x: str) -> str:
        return f"sha1({x})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}D)"

    def collect(self, x: str, order: str) -> str:
        """List of x by order; order is an expression without nulls."""
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS v))), s -> s.v)"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"

    def seconds(self, a: str, b: str) -> str:
        return f"timestampdiff(MICROSECOND, {a}, {b}) / 1e6D"

    def mod(self, a: str, b: str) -> str:
        return f"pmod({a}, {b})"


class Ascii(Spark):
    """Spark SQL for texts of ASCII characters alone: classes need no Unicode, and what a match must hold is looked for first."""

    def like(self, x, pattern):
        word, found = held(pattern), f"regexp_like({x}, {self.lit('(?i)' + pattern)})"
        return f"(contains(lower({x}), {self.lit(word)}) AND {found})" if len(word) > 1 else found

    def among(self, x, patterns, common):
        words = sorted({w for p in patterns for w in one_of(p, common)})
        return f"array_intersect(split(lower({x}), {self.lit(NO_LETTERS)}), array({', '.join(map(self.lit, words))}))"

    def said(self, column, x, pattern, common):
        words = one_of(pattern, common)
        return f"(arrays_overlap({column}, array({', '.join(map(self.lit, words))})) AND regexp_like({x}, {self.lit('(?i)' + pattern)}))" if words else self.like(x, pattern)

    def find(self, x, pattern):
        return f"regexp_extract({x}, {self.lit('(?i)' + pattern)}, 0)"

    def group(self, x, pattern, k, flags=""):
        return f"regexp_extract({x}, {self.lit((f'(?{flags})' if flags else '') + pattern)}, {k})"

    def replace(self, x, pattern, to, flags=""):
        return f"regexp_replace({x}, {self.lit((f'(?{flags})' if flags else '') + FASTER.get(pattern, pattern))}, {self.lit(to)})"

    def trim(self, x):
        return f"btrim({x}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


class Duck(Spark):
    """DuckDB, whose regular expressions are RE2."""

    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def like(self, x, pattern):
        return f"regexp_matches({x}, {self.lit('(?i)' + pattern)})"

    def find(self, x, pattern):
        return f"regexp_extract({x}, {self.lit('(?i)' + pattern)})"

    def group(self, x, pattern, k, flags=""):
        return f"regexp_extract({x}, {self.lit((f'(?{flags})' if flags else '') + pattern)}, {k})"

    def replace(self, x, pattern, to, flags=""):
        return f"regexp_replace({x}, {self.lit((f'(?{flags})' if flags else '') + pattern)}, {self.lit(to.replace('$1', chr(92) + '1'))}, 'g')"

    def find_all(self, x, pattern):
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def count(self, x, pattern):
        return f"len(regexp_extract_all({x}, {self.lit(pattern)}))"

    def enough(self, x, kind, n):
        return f"{self.count(x, f'[{kind}]')} >= {n}"

    def foreign(self, x, cond):
        return cond

    def early(self, x, cond):
        return cond(x)

    def array(self, *xs):
        return f"[{', '.join(xs)}]"

    def at(self, a, k):
        return f"list_extract({a}, {k})"

    def size(self, a):
        return f"CAST(len({a}) AS INT)"

    def filter(self, a, v, cond):
        return f"list_filter({a}, lambda {v}: {cond})"

    def map(self, a, v, e):
        return f"list_transform({a}, lambda {v}: {e})"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def overlap(self, a, b):
        return f"list_has_any({a}, {b})"

    def join(self, a, sep):
        return f"array_to_string({a}, '{sep}')"

    def append(self, a, x):
        return f"list_append({a}, {x})"

    def explode(self, a):
        return f"unnest({a})"

    def range(self, a, b):
        return f"range({a}, ({b}) + 1)"

    def concat_lists(self, a, b):
        return f"list_concat({a}, {b})"

    def text(self, x):
        return f"CAST({x} AS VARCHAR)"

    def number(self, x):
        return f"TRY_CAST({x} AS DOUBLE)"

    def hex32(self, x):
        return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"

    def sha256(self, x):
        return f"sha256({x})"

    def quantile(self, x, p):
        return f"quantile_cont({x}, {p})"

    def collect(self, x, order):
        return f"list({x} ORDER BY {order})"

    def dot(self, a, b):
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"

    def seconds(self, a, b):
        return f"date_diff('microsecond', {a}, {b}) / 1e6::DOUBLE"

    def mod(self, a, b):
        return f"(({a}) % ({b}))"


SPARK, ASCII, DUCK = Spark(), Ascii(), Duck()
