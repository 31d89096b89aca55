"""Token counts of a byte-level BPE vocabulary, with a shortcut for whole tokens.

Before any text is read, the merges are run over every vocabulary string alone; those that end as one token are the
whole tokens. A pre-token that is one of them counts 1 at once, and only the rest is merged. A text is first cut
before each run of white space, where pre-tokens never join, and the counts of recent cuts are remembered (CACHE
of them at most, then forgotten), so that each costs one lookup.

Special tokens found in a text count 1 each, as the tokenizers library has it by default. Null counts as an empty
text, of 0 tokens. Very long texts are read piecewise and very long pre-tokens merged with a heap, so neither takes
more than its own length in memory. Rows stand alone: repeated rows, null ids and further columns make no difference.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parlance.llm._cluster import tidy
from parlance.session import ship

CACHE = 400_000
#: Bits of the table of merges; no merge.
SLOTS, NONE = 18, 1 << 30
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Python's \s has four control characters that the pattern's \s lacks.
_CUT = re.compile(r"\s*\S+|\s+")
_CUT_CONTROL = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_CONTROL = re.compile(r"[\x1c-\x1f]")
_LONG = 1 << 20


def byte_of_char() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: visible Latin-1 characters stand for themselves, the rest count up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Merges, whole tokens and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_of_char()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = {raw(t): k for t, k in spec["model"]["vocab"].items() if t not in set(self.special)}
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        self.keys, self.slot_rank = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.int32)
        self.made = np.zeros(len(self.ranks), np.int32)
        for (a, b), k in self.ranks.items():
            self.made[k] = vocab[a + b]
            key = vocab[a] << 20 | vocab[b]
            slot = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - SLOTS
            while self.keys[slot] >= 0:
                slot = slot + 1 & (1 << SLOTS) - 1
            self.keys[slot], self.slot_rank[slot] = key, k
        special = set(self.special)
        strings = [raw(s) for s in spec["model"]["vocab"] if s not in special]
        self.whole = {s for s, n in zip(strings, self.merged_all(strings), strict=True) if n == 1}

    def merged(self, token: bytes) -> int:
        """Tokens left of a pre-token once no merge applies; the lowest rank goes first, the leftmost of equals."""
        return int(self.merged_all([token])[0])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token numbers, NONE where there is no merge."""
        key = a.astype(np.int64) << 20 | b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.slot_rank[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOTS) - 1)
        return out

    def merged_all(self, tokens: list[bytes]) -> np.ndarray:
        """Tokens left of each pre-token; numpy makes one merge in each of them at a time."""
        lens = np.array([len(t) for t in tokens])
        out = np.zeros(len(tokens), np.int64)
        order = np.argsort(lens, kind="stable")
        at = 0
        while at < len(order):
            width = max(8, 1 << int(lens[order[at]] - 1).bit_length())
            if width > 64:
                out[order[at]] = self._merged_long(tokens[order[at]])
                at += 1
                continue
            end = min(int(np.searchsorted(lens[order], width, "right")), at + (1 << 19) // width)
            part = order[at:end]
            out[part] = self._together([tokens[k] for k in part], lens[part], width)
            at = end
        return out

    def _together(self, tokens: list[bytes], lens: np.ndarray, width: int) -> np.ndarray:
        n = len(tokens)
        ids = np.full((n, width), -1, np.int32)
        column = np.arange(width)
        ids[column < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        rank = np.full((n, width), NONE, np.int32)
        pair = column[:-1] < lens[:, None] - 1
        rank[:, :-1][pair] = self._rank(ids[:, :-1][pair], ids[:, 1:][pair])
        left, rows = lens.copy(), np.arange(n)
        while len(rows):
            j = rank.argmin(1)
            low = rank[np.arange(len(rows)), j]
            live = low < NONE
            ids, rank, rows, j, low = ids[live], rank[live], rows[live], j[live], low[live]
            if not len(rows):
                break
            shift = np.minimum(column + (column > j[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, shift, 1), np.take_along_axis(rank, shift, 1)
            k = np.arange(len(rows))
            ids[k, j] = self.made[low]
            left[rows] -= 1
            rank[:, -1] = NONE
            for side in (j - 1, j):
                has = (side >= 0) & (side + 1 < left[rows])
                rank[k[(side >= 0) & ~has], side[(side >= 0) & ~has]] = NONE
                rank[k[has], side[has]] = self._rank(ids[k[has], side[has]], ids[k[has], side[has] + 1])
        return left

    def _merged_long(self, token: bytes) -> int:
        n = len(token)
        parts = [token[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or len(parts[i]) + len(parts[j]) != size or (parts[i], parts[j]) not in self.ranks:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            left -= 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return left


class Counter(dict):
    """Numbers of cuts met so far, and their counts."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        super().__init__()
        self.v, self.split = vocabulary, regex.compile(PATTERN).findall
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.forget()

    def forget(self):
        self.clear()
        self.waiting: list[str] = []
        self.n = np.zeros(0, np.int64)
        self.tokens: dict[bytes, int] = {}

    def __missing__(self, cut: str) -> int:
        self.waiting.append(cut)
        self[cut] = k = len(self)
        return k

    def settle(self):
        """Count the cuts that wait: whole tokens at once, the rest by merging each distinct one."""
        counts, at, rest, where = np.zeros(len(self.waiting), np.int64), [], [], {}
        whole, known = self.v.whole, self.tokens
        for k, cut in enumerate(self.waiting):
            for token in self.split(cut):
                raw = token.encode()
                if raw in whole:
                    counts[k] += 1
                elif (n := known.get(raw)) is not None:
                    counts[k] += n
                else:
                    if raw not in where:
                        where[raw] = len(rest)
                        rest.append(raw)
                    at.append((k, where[raw]))
        if rest:
            n = self.v.merged_all(rest)
            pairs = np.array(at)
            counts += np.bincount(pairs[:, 0], n[pairs[:, 1]], len(counts)).astype(np.int64)
            known.update(zip(rest, n.tolist(), strict=True))
        self.n, self.waiting = np.concatenate([self.n, counts]), []

    def marks(self, text: str) -> np.ndarray:
        """The numbers of a text's cuts."""
        pattern = _CUT_CONTROL if _CONTROL.search(text) else _CUT
        cuts = pattern.findall(text) if len(text) < _LONG else (m[0] for m in pattern.finditer(text))
        return np.fromiter(map(self.__getitem__, cuts), np.int64)

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self) > CACHE or len(self.tokens) > CACHE:
            self.forget()
        out = []
        for text in texts:
            has = self.special and self.special.search(text)
            parts = self.special.split(text) if has else [text]
            out.append((len(parts) - 1, [self.marks(p) for p in parts]))
        self.settle()
        return [n + int(sum(self.n[m].sum() for m in marks)) for n, marks in out]

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


def groups(column: pa.Array, most: int = 1 << 21):
    """Lists of neighbouring texts of some million characters in all; null counts as empty."""
    now, size = [], 0
    for x in column:
        t = x.as_py() or ""
        now.append(t)
        size += len(t)
        if size > most:
            yield now
            now, size = [], 0
    if now:
        yield now


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; path is a tokenizer file that the driver can read."""
    ship(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        counter = Counter(vocabulary.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for texts in groups(batch.column(1)):
                n_bytes += [len(t.encode()) for t in texts]
                n_tokens += counter.count_all(texts)
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), n, pa.array([x > limit for x in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), T.StructType([*docs.select("doc_id").schema.fields, *new]))
