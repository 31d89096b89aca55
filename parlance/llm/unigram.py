"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

A text is the marker (U+2581) and itself, each blank (U+0020) turned into a marker. Among all ways to spell it with
pieces the one of the greatest sum of log scores is taken; of equal ones, that with the longer piece at the place
where they part last. A character that is no piece costs the least score less PENALTY and is then spelled with byte
pieces. As no piece has a marker after another character (this is checked), the best spelling of a text is that of its
cuts before each run of markers; distinct cuts are spelled once, all at a time: numpy walks the trie for a whole
batch of cuts at each byte. CACHE spelled cuts are remembered at most.

Decoding joins the pieces' bytes, turns markers into blanks and drops the first one. For a text without U+2581 that is
the text itself, which the query reports. Null and empty texts have no pieces, an empty table gives an empty result. Rows stand
alone; further columns pass, and where they have the names of the new ones, those get an underscore before theirs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parlance.llm._cluster import free, plain, release, tidy
from parlance.llm.token_count import groups
from parlance.session import ship

CACHE, PENALTY = 300_000, 10.0
MARK = "▁"
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class DoubleArray:
    """A trie of byte strings: child of state s by byte c is base[s] + c if check there is s."""

    def __init__(self, words: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for word, value in words.items():
            at = 0
            for c in word:
                if c not in tree[at]:
                    tree[at][c] = len(tree)
                    tree.append({})
                at = tree[at][c]
            ends[at] = value
        size = 4 * len(tree) + 2048
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, low, wide, todo = {0: 0}, 257, 1, [0]
        while todo:
            node = todo.pop()
            state, kids = place[node], sorted(tree[node])
            if node in ends:
                self.value[state] = ends[node]
            if not kids:
                continue
            if len(kids) == 1:  # the most common case fills the gaps that the others leave
                while used[low]:
                    low += 1
                b = low - kids[0]
            else:
                b, tries = wide, 0
                while any(used[b + c] for c in kids):
                    b += 1
                    tries += 1
                wide = b if tries > 16 else wide
            if b + 512 > size - 256:
                raise ValueError("the trie outgrew its arrays")
            self.base[state] = b
            for c in kids:
                used[b + c] = 1
                self.check[b + c] = state
                place[tree[node][c]] = b + c
                todo.append(tree[node][c])


class Model:
    """Pieces with log scores from a .model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids, words, self.scores, self.raw = np.zeros(256, np.int32), {}, np.zeros(n), [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in piece.lstrip(MARK):
                    raise ValueError("a piece has a marker after another character")
                words[piece.encode()] = i
                self.scores[i] = sp.get_score(i)
                self.raw[i] = piece.encode()
        self.longest = max(map(len, words))
        self.unknown = min(self.scores[list(words.values())]) - PENALTY
        self.trie = DoubleArray(words)

    def spell(self, cuts: list[bytes]) -> list[np.ndarray]:
        """Piece ids of each cut."""
        out: list = [None] * len(cuts)
        order = sorted(range(len(cuts)), key=lambda k: len(cuts[k]))
        at = 0
        while at < len(order):
            longest = max(8, 1 << (len(cuts[order[at]]) - 1).bit_length() if cuts[order[at]] else 8)
            most = max(1, (1 << 20) // longest)
            end = at
            while end < len(order) and end - at < most and len(cuts[order[end]]) <= longest:
                end += 1
            part = order[at:end]
            for k, ids in zip(part, self._together([cuts[k] for k in part]), strict=True):
                out[k] = ids
            at = end
        return out

    def _together(self, cuts: list[bytes]) -> list[np.ndarray]:
        lens = np.array([len(c) for c in cuts])
        width, n = int(lens.max()), len(cuts)
        text = np.zeros((width, n), np.int64)
        for k, c in enumerate(cuts) if n < 64 else ():
            text[: len(c), k] = np.frombuffer(c, np.uint8)
        if n >= 64:
            flat = np.frombuffer(b"".join(cuts), np.uint8)
            row = np.repeat(np.arange(n), lens)
            text[np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens), row] = flat
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            rows = np.flatnonzero(np.isfinite(best[i]) & (lens > i))
            if not len(rows):
                continue
            start, everyone, lead = best[i, rows], rows, text[i, rows]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            state, which = np.zeros(len(rows), np.int64), np.arange(len(rows))
            for j in range(i, min(width, i + self.longest)):
                live = lens[rows] > j
                rows, state, which = rows[live], state[live], which[live]
                after = base[state] + text[j, rows]
                live = (check[after] == state) & (base[state] > 0)
                rows, state, which = rows[live], after[live], which[live]
                if not len(rows):
                    break
                ids = value[state]
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    r, w, ids = rows[hit], which[hit], ids[hit]
                    single[w[size[w] == j + 1 - i]] = True
                    score = start[w] + self.scores[ids]
                    better = score > best[j + 1, r]
                    r, w = r[better], w[better]
                    best[j + 1, r], back[j + 1, r], piece[j + 1, r] = score[better], i, ids[better]
            for w in np.flatnonzero(~single):
                r, end = everyone[w], min(i + int(size[w]), int(lens[everyone[w]]))
                if start[w] + self.unknown > best[end, r]:
                    best[end, r], back[end, r], piece[end, r] = start[w] + self.unknown, i, -1
        spelled: list[list[int]] = [[] for _ in range(n)]
        at = lens.copy()
        while True:
            rows = np.flatnonzero(at > 0)
            if not len(rows):
                break
            ids, start = piece[at[rows], rows], back[at[rows], rows]
            for r, p, a in zip(rows.tolist(), ids.tolist(), start.tolist(), strict=True):
                if p >= 0:
                    spelled[r].append(p)
                else:
                    spelled[r].extend(self.byte_ids[text[a : at[r], r][::-1]].tolist())
            at[rows] = start
        return [np.array(s[::-1], np.int32) for s in spelled]

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


class Encoder(dict):
    """Numbers of cuts met so far; their pieces lie in one pool."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self):
        self.clear()
        self.waiting: list[bytes] = []
        self.pool, self.at, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, cut: str) -> int:
        self.waiting.append(cut.encode())
        self[cut] = k = len(self)
        return k

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text."""
        if len(self) > CACHE:
            self.reset()
        marks = [np.fromiter(map(self.__getitem__, _CUT.findall(MARK + t.replace(" ", MARK))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if self.waiting:
            new = self.model.spell(self.waiting)
            lens = np.array([len(x) for x in new], np.int64)
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(lens) - lens])
            self.lens, self.pool, self.waiting = np.concatenate([self.lens, lens]), np.concatenate([self.pool, *new]), []
        out = []
        for m in marks:
            n = self.lens[m]
            ends = np.cumsum(n)
            out.append(self.pool[np.repeat(self.at[m] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The rows of docs with piece_ids, n_pieces and decodes (whether decoding gives the text back) for text; path is a .model file that the driver can read."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(path))
    release()
    at = docs.columns.index("text")
    added = free(docs, "piece_ids", "n_pieces", "decodes")
    new = [T.StructField(n, k) for n, k in zip(added, (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType()), strict=True)]
    schema = T.StructType([*docs.schema.fields, *new])
    names = schema.names

    def run(batches):
        encoder = Encoder(model.value)
        for batch in batches:
            row = 0
            for texts in groups(batch.column(at)):
                found = encoder.encode(texts)
                same = [model.value.decode(ids.tolist()) == t for ids, t in zip(found, texts, strict=True)]
                lens = np.array([len(x) for x in found], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(texts)).columns, ids, pa.array(lens), pa.array(same, pa.bool_())], names)
                row += len(texts)

    return plain(docs).mapInArrow(tidy(run), schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """The rows with decoded, the text that piece_ids spell; null ids stay null."""
    ship(rows.sparkSession)
    model = rows.sparkSession.sparkContext.broadcast(Model(path))
    at, names = rows.columns.index("piece_ids"), [*rows.columns, "decoded"]

    def run(batches):
        for batch in batches:
            texts = [None if ids is None else model.value.decode(ids) for ids in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return plain(rows).mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
