"""Substring dedup by hashing units: lines, and the sentences within them.

Each text is cut into units at line ends and after words that end a sentence, so that a paragraph which other text
precedes or follows on its line still has the units that it has elsewhere. A unit is normalised (A-Z lower case,
white space collapsed) and hashed to 128 bits. Digests are grouped over the whole corpus; the occurrence with the
least (doc_id, position) is the original and every other one a repeat. Runs of neighbouring repeats that hold
`least_words` words or more in all are removed. With `every_line`, as the query and the pipeline have it, every repeat
of a whole line goes too, whatever its length (a paragraph is one line or several), and so do runs of `least_chars`
characters or more, which text without blanks reaches too. Lines of several sentences have a digest of their own, so
that a line whose sentences occur only apart is no repeat; a line of one sentence repeats it wherever it stood. What stays is a shorter run of sentences within a line.

The removed spans are given as offsets into the original text, in code points. A removed span that makes up whole
lines takes a line break along; one that ends a line takes the blanks before it.

A row is known by its doc_id and a 64-bit hash of its text, or by 128 bits of hash where it has no doc_id. Repeated
rows with one doc_id and text count as the same document, so they don't repeat each other; rows without a doc_id rank
last, and of texts under one doc_id that of the lesser hash comes first. Null texts stay null and, like empty ones,
have no units; an empty table gives an empty result. Texts have no limit of length: what a task holds at least is one
text and the numbers of its repeats. Other columns pass through untouched, whatever their names.

Units are cut once and written, as are the originals of repeated digests, with the number of their units. Digests of more
than HOT units, and of more than a MOST_HOTth of all, are at most MOST_HOT; these are broadcast, so that a line which fills
a quarter of the corpus is met where it lies. All others are joined by a shuffle at every size, and so are the documents with
the numbers of their repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import _bytes as B
from parlance.llm._cluster import Scratch, free, own, plain, quoted, tidy

LEAST_WORDS, LEAST_CHARS = 20, 100
#: Units from which a digest counts as frequent, and how many frequent digests there can be at most (10 bytes a number: some MB).
HOT, MOST_HOT = 10_000, 100_000
#: Marks the number of a line, which is that of its first unit.
LINE = 1 << 30

_LETTER = ~B.table([x for x in range(128) if not chr(x).isalnum()])
_STOP = B.table(b".!?")
_BREAK = B.table([0x0A])
_BLANK = B.table([0x20, 0x09])
_K1, _K2 = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xA24BAED4963EE407)


def _cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The index of the first word of each unit; rows are row offsets into the words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
    breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
    last = np.maximum.accumulate(np.where(_LETTER[raw], np.arange(len(raw)), -1))[ends - 1]
    closes = stops[ends] > stops[np.maximum(last + 1, starts)]
    first = np.ones(len(starts), bool)
    first[1:] = closes[:-1] | (breaks[starts[1:]] > breaks[ends[:-1]])
    first[rows[:-1][rows[:-1] < len(starts)]] = True
    return np.flatnonzero(first)


def _opens(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether each unit begins a line."""
    breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
    out = np.ones(len(cut), bool)
    out[1:] = breaks[starts[cut[1:]]] > breaks[ends[cut[1:] - 1]]
    out[np.isin(cut, rows)] = True
    return out


def _digests(hashes: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words of each unit, in which each word's place counts."""
    lens = np.diff(np.append(cut, len(hashes)))
    place = (np.arange(len(hashes)) - np.repeat(cut, lens)).astype(np.uint64)
    size = lens.astype(np.uint64)
    one = np.add.reduceat(B.mix(hashes + place * _K1), cut) + size
    two = np.add.reduceat(B.mix((hashes ^ _K2) * _K1 + place * _K2), cut) + size
    return B.mix(one).view(np.int64), B.mix(two).view(np.int64)


def _units(every_line: bool):
    """(h1, h2, late, did, tid, number) for each unit of (late, did, tid, text) rows. With every_line, lines of several units too."""

    def run(batches):
        for batch in batches:
            for first, raw, starts, ends, hashes, rows, _ in B.batch_spans(batch.column(3), B.SPACE):
                cut = _cut(raw, starts, ends, rows)
                if not len(cut):
                    continue
                h1, h2 = _digests(hashes, cut)
                row = np.searchsorted(rows, cut, "right") - 1
                number = np.arange(len(cut)) - np.searchsorted(cut, rows[row])
                if every_line:
                    heads = np.flatnonzero(_opens(raw, starts, ends, rows, cut))
                    several = np.diff(np.append(heads, len(cut))) > 1
                    l1, l2 = _digests(hashes, cut[heads])
                    heads = heads[several]
                    h1, h2 = np.concatenate([h1, l1[several]]), np.concatenate([h2, l2[several]])
                    row, number = np.concatenate([row, row[heads]]), np.concatenate([number, number[heads] + LINE])
                at = pa.array(first + row)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), *(batch.column(k).take(at) for k in range(3)), pa.array(number.astype(np.int32))], ["h1", "h2", "late", "did", "tid", "number"])

    return run


def _stretches(flag: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of each run of True."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))


def _removed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, cut: np.ndarray, repeats: np.ndarray, least: int, opens: np.ndarray | None, least_chars: int) -> list[tuple[int, int]]:
    """Byte spans of one text to remove; repeats are numbers of its units and lines, opens the units that begin a line (None: lines don't matter)."""
    flag, line = np.zeros(len(cut), bool), np.zeros(len(cut), bool)
    flag[repeats[repeats < LINE]] = True
    if opens is not None:
        heads = np.flatnonzero(opens)
        size = np.diff(np.append(heads, len(cut)))
        again = np.where(size == 1, flag[heads], np.isin(heads + LINE, repeats))
        line = np.repeat(again, size)
    bounds = np.append(cut, len(starts))
    spans = []
    for a, b in _stretches(flag | line):  # units a to b - 1
        long = bounds[b] - bounds[a] >= least
        if not long and opens is not None:
            long = np.count_nonzero((raw[starts[bounds[a]] : ends[bounds[b] - 1]] & 0xC0) != 0x80) >= least_chars
        spans += [(a, b)] if long else [(a + x, a + y) for x, y in _stretches(line[a:b])]
    out = []
    for a, b in spans:
        lo, hi = int(starts[bounds[a]]), int(ends[bounds[b] - 1])
        head, tail = lo, hi
        while head > 0 and _BLANK[raw[head - 1]]:
            head -= 1
        while tail < len(raw) and _BLANK[raw[tail]]:
            tail += 1
        opens, closes = head == 0 or raw[head - 1] == 0x0A, tail == len(raw) or raw[tail] == 0x0A
        if opens and closes:
            lo, hi = head, min(tail + 1, len(raw))
            if hi == tail and lo > 0 and not (out and out[-1][1] == lo):
                lo -= 1
        elif closes:
            lo, hi = head, tail
        else:
            hi = tail
        out.append((max(lo, out[-1][1]) if out else lo, hi))
    return [(a, b) for a, b in out if a < b]


def _strip(least: int, every_line: bool, least_chars: int, text_at: int, repeats_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            text, lists = batch.column(text_at), batch.column(repeats_at)
            kept = text.to_pylist() if not lists.null_count == batch.num_rows else None
            n_units, n_gone, where = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            for first, raw, starts, ends, _, rows, own in B.batch_spans(text, B.SPACE):
                cut = _cut(raw, starts, ends, rows)
                by = np.searchsorted(cut, rows)
                opens = _opens(raw, starts, ends, rows, cut) if every_line and len(cut) else None
                n_units[first : first + len(rows) - 1] = np.diff(by)
                for k in range(len(rows) - 1):
                    r = first + k
                    repeats = flat[at[r] : at[r + 1]]
                    if not len(repeats):
                        continue
                    part, w0, w1 = raw[own[k] : own[k + 1]], rows[k], rows[k + 1]
                    gone = _removed(part, starts[w0:w1] - own[k], ends[w0:w1] - own[k], cut[by[k] : by[k + 1]] - w0, np.unique(repeats).astype(np.int64), least, opens if opens is None else opens[by[k] : by[k + 1]], least_chars)
                    if not gone:
                        continue
                    chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    where[r] = [{"start": int(chars[a]), "end": int(chars[b])} for a, b in gone]
                    first_byte = starts[cut[by[k] : by[k + 1]]] - own[k]
                    n_gone[r] = sum(int(np.searchsorted(first_byte, b) - np.searchsorted(first_byte, a)) for a, b in gone)
                    bounds = [0, *(x for s in gone for x in s), len(part)]
                    kept[r] = b"".join(part[a:b].tobytes() for a, b in zip(bounds[::2], bounds[1::2], strict=True)).decode()
            new = text if kept is None else pa.array(kept, text.type)
            spans = pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [new if i == text_at else c for i, c in enumerate(batch.columns) if i != repeats_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_units), pa.array(n_gone), spans], names)

    return run


def _meet(units: DataFrame, firsts: DataFrame, hot: int = HOT, most: int = MOST_HOT) -> DataFrame:
    """units with the originals of their digests. Digests of very many units, whose number the count of all units bounds, are sent to where the units are; the others are shuffled."""
    least = max(hot, units.count() // most)
    frequent = firsts.where(F.col("n") > least).drop("n")
    if frequent.isEmpty():
        return units.join(firsts.drop("n"), ["h1", "h2"])
    frequent, rest = F.broadcast(frequent), firsts.where(F.col("n") <= least).drop("n")
    return units.join(frequent, ["h1", "h2"]).unionByName(units.join(frequent, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))


def strip_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, every_line: bool = False, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows of docs with repeats cut out of text, and last of all _units, _removed (units) and _spans (offsets into the original text); with more underscores where docs has such columns."""
    s = Scratch(docs.sparkSession, "substring_dedup")
    late, did, tid, repeats, units_, removed, spans = free(docs, "_late", "_did", "_tid", "_repeats", "_units", "_removed", "_spans")
    text = F.col("text")
    key = [F.col("doc_id").isNull().alias(late), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(1), text)).alias(did), F.xxhash64(text).alias(tid)]
    units = s.table(docs.select(*key, "text").mapInArrow(tidy(_units(every_line)), "h1 long, h2 long, late boolean, did long, tid long, number int"))
    where = F.struct("late", "did", "tid", "number")
    firsts = units.groupBy("h1", "h2").agg(F.min(where).alias("o"), F.max(where).alias("z"), F.count("*").alias("n")).where("o <> z").select("h1", "h2", "o", "n")
    firsts = s.table(firsts)
    again = _meet(units, firsts).where(where != F.col("o"))
    lists = again.groupBy(*(F.col(a).alias(b) for a, b in (("late", late), ("did", did), ("tid", tid)))).agg(F.collect_set("number").alias(repeats))
    lists = s.table(lists)
    s.keep(lists)
    joined = docs.select("*", *key).join(lists, [late, did, tid], "left").select(*own(docs), repeats)
    facts = [F.lit(0).cast("long").alias(units_), F.lit(0).cast("long").alias(removed), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias(spans)]
    schema = docs.select(*own(docs), *facts).schema
    at = docs.columns.index("text")
    return plain(joined).mapInArrow(tidy(_strip(least_words, every_line, least_chars, at, len(docs.columns), schema.names)), schema)


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS, every_line: bool = False, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text without its repeats, n_units, n_removed and the removed spans, for each row of docs."""
    out = strip_repeats(docs.select("doc_id", "text"), least_words, every_line, least_chars)
    return out.select("doc_id", "text", F.col("_units").alias("n_units"), F.col("_removed").alias("n_removed"), F.col("_spans").alias("removed_spans"))


def keep_rest(docs: DataFrame, least_words: int = LEAST_WORDS, every_line: bool = True, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows and columns of docs with repeats cut out of text; n_chars, where there is one, tells the length of a text that was cut."""
    out = strip_repeats(docs, least_words, every_line, least_chars)
    cut = F.col(quoted(out.columns[-2])) > 0
    return out.select(*[F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])
