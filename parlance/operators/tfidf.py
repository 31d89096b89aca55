"""TF-IDF weights of whole tables, with no shuffle of postings.

Texts are dealt to chunks of some CHUNK bytes by hash of their id. A chunk counts its own words, word pairs and characters within
words in numpy, puts its distinct terms in the order of their hashes and sends them once, packed, in ranges of that order, each term with the
number of its texts that hold it. A task with all chunks' terms of a range sums these numbers and answers each chunk with the sums alone,
in the order in which its terms came. The chunk counts its texts again and weighs them in place. What moves is the texts and the
vocabularies of chunks, compressed, never a row for each text and term; a frequent term is there once a chunk. Terms are compared as
they are: hashes only deal them out. Rows that share an id are one text; word pairs don't cross rows. Null texts and ids count for nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.dialect import SPARK
from parlance.session import ship

#: Bytes of text a chunk, and pairs of text and gram that are sorted at a time.
CHUNK, CELLS = 16 << 20, 2_000_000
SIZES = (3, 4, 5)


def _grouped(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there or the sum of its weights. Where both fit, key and weight are sorted as one number, which is far quicker."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    bits = 0 if weight is None else int(weight.max()).bit_length()
    if int(key.max()).bit_length() + bits < 63:
        both = np.sort(key if weight is None else key << bits | weight)
        key, weight = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key)
        key, weight = key[order], None if weight is None else weight[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(weight, first) if bits else np.diff(np.append(first, len(key)))


class Chunk:
    """The texts of a table (id, words joined by blanks), as numbers."""

    def __init__(self, table: pa.Table):
        lists = pc.split_pattern(table.column("words"), " ").combine_chunks()
        self.ids, at = np.unique(table.column("id").to_numpy(), return_inverse=True)
        coded = lists.flatten().dictionary_encode()
        self.words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        self.code, self.doc = code, at[self.row].astype(np.int64)
        self.length = pc.binary_length(self.words).to_numpy()

    def _counted(self, doc: np.ndarray, code: np.ndarray, size: int) -> list:
        key, tf = _grouped(doc * max(1, size) + code)
        return [(key // max(1, size), key % max(1, size), tf)] if len(key) else []

    def term(self, keep=None):
        """(terms, parts): each part (document, term, tf), by document."""
        return self.words, self._counted(self.doc, self.code, len(self.words))

    def word(self, keep=None):
        """Words of two characters or more, and pairs of neighbours among them."""
        long = self.length[self.code] >= 2
        row, code, doc = self.row[long], self.code[long], self.doc[long]
        near = row[1:] == row[:-1]
        v = len(self.words)
        pair, number = np.unique(code[:-1][near] * v + code[1:][near], return_inverse=True)
        pairs = pc.binary_join_element_wise(self.words.take(pa.array(pair // v)), self.words.take(pa.array(pair % v)), " ")
        return pa.concat_arrays([self.words, pairs]), self._counted(np.concatenate([doc, doc[1:][near]]), np.concatenate([code, v + number]), v + len(pair))

    def char(self, keep=None):
        """3 to 5 characters within words padded with a blank, named by their bytes as a number; parts of some CELLS entries. keep: only these."""
        own, key = self._grams()
        names, gram = np.unique(key, return_inverse=True)
        terms = pa.array(names).cast(pa.string())
        order = np.argsort(own, kind="stable")
        gram, count = gram[order], np.bincount(own, minlength=len(self.words))
        first = np.cumsum(count) - count
        return terms, self._parts(gram, first, count, len(names), keep(terms) if keep else None)

    def _grams(self):
        """(word, gram) of every gram of every distinct word."""
        data = np.frombuffer((" " + "  ".join(self.words.to_pylist()) + " ").encode(), np.uint8).astype(np.int64)
        padded = self.length.astype(np.int64) + 2
        end = np.cumsum(padded)
        word = np.repeat(np.arange(len(padded)), padded)
        owns, keys = [], []
        for n in SIZES:
            at = np.flatnonzero(np.arange(len(word)) + n <= end[word])
            key = np.zeros(len(at), np.int64)
            for i in range(n):
                key = key * 256 + data[at + i]
            owns.append(word[at])
            keys.append(key)
        return np.concatenate(owns), np.concatenate(keys)

    def _parts(self, gram, first, count, size, kept):
        """Whole documents, some CELLS of their grams at a time; first and count say where a word's grams lie."""
        for doc, code, tf in self._counted(self.doc, self.code, len(self.words)):
            many = np.cumsum(count[code])
            ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))  # where a document's words end
            a = 0
            while a < len(doc):
                limit = np.searchsorted(many, (many[a - 1] if a else 0) + CELLS, "right")
                b = ends[max(np.searchsorted(ends, limit, "right") - 1, np.searchsorted(ends, a, "right"))]  # a document at least
                n = count[code[a:b]]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[code[a:b]], n)
                g, d, t = gram[at], np.repeat(doc[a:b], n), np.repeat(tf[a:b], n)
                if kept is not None:
                    known = kept[g]
                    g, d, t = g[known], d[known], t[known]
                key, total = _grouped(d * size + g, t)
                yield key // size, key % size, total
                a = b


def _vocabulary(halves: tuple[str, ...], made=Chunk):
    def run(table: pa.Table) -> pa.Table:
        chunk, out = made(table), []
        for half in halves:
            terms, parts = getattr(chunk, half)()
            n = np.zeros(len(terms), np.int64)
            for _, term, _ in parts:
                n += np.bincount(term, minlength=len(terms))
            seen = np.flatnonzero(n)
            out.append(pa.table({"chunk": np.full(len(seen), table.column("chunk")[0].as_py(), np.int32), "half": pa.array([half]).take(pa.array(np.zeros(len(seen), np.int64))), "term": terms.take(pa.array(seen)), "n": n[seen]}))
        return pa.concat_tables(out)

    return run


def _packed(data) -> bytes:
    return pa.Codec("zstd", 3).compress(data, asbytes=True)


def _unpacked(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def _hashed(terms: pa.Array) -> np.ndarray:
    """64 bits for each term, the same wherever it is met."""
    ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    data, out = np.frombuffer(terms.buffers()[2] or b"", np.uint8), np.zeros(len(terms), np.uint64)
    for i in range(0, len(terms), 50_000):
        e = ends[i : i + 50_001]
        power = np.append(np.uint64(1), np.cumprod(np.full(e[-1] - e[0], 0x9E3779B97F4A7C15, np.uint64)))
        back = np.append(np.uint64(1), np.cumprod(np.full(e[-1] - e[0], pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum((data[e[0] : e[-1]].astype(np.uint64) + np.uint64(1)) * power[:-1]))
        out[i : i + 50_000] = (sums[e[1:] - e[0]] - sums[e[:-1] - e[0]]) * back[e[:-1] - e[0]]
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(by)
    return out


def _dealt(terms: pa.Array, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct terms by their hashes, whatever order they come in, and where each of so many ranges begins and ends."""
    h = _hashed(terms)
    order = np.argsort(h)
    if (h[order][1:] == h[order][:-1]).any():
        text = terms.to_pylist()
        order = np.array(sorted(range(len(text)), key=lambda i: (h[i], text[i])))
    return order, np.searchsorted((h[order] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))


def _held(table: pa.Table) -> pa.Table:
    return table.filter(pc.not_equal(table.column("words"), ""))


def _sent(halves: tuple[str, ...], ranges: int):
    """A chunk's terms, packed: a row for each half and range that has some."""

    def run(table: pa.Table) -> pa.Table:
        chunk, out = Chunk(_held(table)), []
        for half in halves:
            terms, parts = getattr(chunk, half)()
            n = np.zeros(len(terms), np.uint32)
            for _, term, _ in parts:
                n += np.bincount(term, minlength=len(terms)).astype(np.uint32)
            order, ends = _dealt(terms, ranges)
            n = n[order]
            lists = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), terms.take(pa.array(order))), "\n")
            for k in np.flatnonzero(ends[1:] > ends[:-1]):
                text = lists[k].as_buffer()
                out.append((int(k), half, table.column("chunk")[0].as_py(), text.size, _packed(text), _packed(n[ends[k] : ends[k + 1]].tobytes()), int(ends[k + 1] - ends[k])))
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((),) * 7, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["range", "half", "chunk", "size", "terms", "n", "many"])

    return run


def _answered(least: dict[str, int]):
    """For the terms of a half and range that each chunk sent, in their order, the number of texts of all chunks; 0 where they are too few."""

    def run(table: pa.Table) -> pa.Table:
        half = table.column("half")[0].as_py()
        rows = table.select(["chunk", "range", "size", "terms", "n", "many"]).to_pylist()
        sent = [pc.split_pattern(pa.array([_unpacked(r["terms"], r["size"]).decode()]), "\n").flatten() for r in rows]
        code = pa.concat_arrays(sent).dictionary_encode().indices.to_numpy()
        n = np.concatenate([np.frombuffer(_unpacked(r["n"], 4 * r["many"]), np.uint32) for r in rows])
        df = np.bincount(code, n).astype(np.uint32)
        df[df < least[half]] = 0
        ends = np.cumsum([r["many"] for r in rows])
        packed = [_packed(df[code[e - r["many"] : e]].tobytes()) for r, e in zip(rows, ends, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "half": table.column("half"), "range": table.column("range"), "many": table.column("many"), "df": pa.array(packed, pa.binary())})

    return run


def _weighed(halves: tuple[str, ...], ranges: int, n: int, emit):
    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        table = _held(table)
        if not table.num_rows:
            return emit.none
        chunk, out = Chunk(table), []
        for half in halves:
            mine = known.filter(pc.equal(known.column("half"), half)).sort_by("range").select(["many", "df"]).to_pylist()
            numbers = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(_unpacked(r["df"], 4 * r["many"]), np.uint32) for r in mine]])
            df = np.zeros(len(numbers), np.int64)

            def met(terms, df=df, numbers=numbers):
                df[_dealt(terms, ranges)[0]] = numbers
                return df > 0

            terms, parts = getattr(chunk, half)(met)
            if half != "char":
                met(terms)
            idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
            for doc, term, tf in parts:
                have = df[term] > 0
                doc, term, tf = doc[have], term[have], tf[have]
                if len(doc):
                    out.append(emit(chunk.ids, half, terms, doc, term, (1.0 + np.log(tf)) * idf[term]))
        return pa.concat_tables(out) if out else emit.none

    return run


class Sums:
    """A row for each document: its terms, the sum and the largest of its weights, scaled to length 1. Parts hold whole documents."""

    schema = "id long, half string, terms long, total double, highest double"
    none = pa.table({"id": pa.array([], pa.int64()), "half": pa.array([], pa.string()), "terms": pa.array([], pa.int64()), "total": pa.array([], pa.float64()), "highest": pa.array([], pa.float64())})

    def __call__(self, ids, half, terms, doc, term, w):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        norm = np.sqrt(np.add.reduceat(w * w, first))
        return pa.table({"id": ids[doc[first]], "half": pa.array([half] * len(first), pa.string()), "terms": np.diff(np.append(first, len(doc))), "total": np.add.reduceat(w, first) / norm, "highest": np.maximum.reduceat(w, first) / norm})


class Weights:
    """A row for each document and term."""

    schema = "id long, term string, weight double"
    none = pa.table({"id": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "weight": pa.array([], pa.float64())})

    def __call__(self, ids, half, terms, doc, term, w):
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        norm = np.sqrt(np.add.reduceat(w * w, first))
        return pa.table({"id": ids[doc], "term": terms.take(pa.array(term)), "weight": w / np.repeat(norm, np.diff(np.append(first, len(doc))))})


def weighed(docs: DataFrame, least: dict[str, int], n: int, emit, words: Column | None = None) -> DataFrame:
    """What emit (Sums or Weights) makes of docs(id, text): of each half named in least (term, word, char) the terms that so many texts hold at least, with (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) as weight. words: of text, joined by blanks."""
    ship(docs.sparkSession)
    halves = tuple(least)
    docs = docs.toDF("id", "text").where("id is not null and text is not null")
    size = docs.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    chunks = max(1, -(-size // CHUNK))
    words = F.array_join(F.expr(T.terms(SPARK, "text")), " ") if words is None else words
    rows = docs.select(F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(chunks)).cast("int").alias("chunk"), F.col("id").cast("long").alias("id"), words.alias("words"))
    own = rows.groupBy("chunk").applyInArrow(_sent(halves, chunks), "range int, half string, chunk int, size long, terms binary, n binary, many long")
    known = own.groupBy("half", "range").applyInArrow(_answered(least), "chunk int, half string, range int, many long, df binary")
    return rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_weighed(halves, chunks, n, emit), emit.schema)
