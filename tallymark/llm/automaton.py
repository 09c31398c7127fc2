"""BPE encoding and decoding by an automaton that is compiled from the merges.

One state with an arc for every byte accepts all texts spelled in bytes. Merge number k, of u and v, puts a gadget in:
the state that u leads to is copied without its arc v, u is led to the copy, and an arc uv is set beside every arc u,
leading where v led. After all merges exactly the correct token sequences are accepted. All arcs of one label lead to
one state, so the states are the tokens' targets. The gadgets of the first ``TABLED`` merges are put into a bit table of
states and arcs one after the other when the file is opened, once for all tasks; arcs of rarer tokens are told from the
gadgets that made their states (the copies, newest first) and then remembered. A word is read once from left to right:
for every prefix the one arc that can end it is the longest token ending there whose arc leaves the state the rest of
the prefix has reached. Words read before are remembered in two generations, so that frequent ones stay. Decoding emits
the labels of the arcs and joins them; it reads the ids alone.

Defined results: a null text is empty; an empty text has no tokens; strings of added tokens inside a text are those
tokens, as the tokenizers library reads them; bytes that are no UTF-8 after decoding become U+FFFD; repeated rows,
very long texts and very long words are encoded like any others; other columns stay as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallymark.llm.tokenizer import ByteBpe, parse, read

#: Words in one generation of a task's memory: when it is full, it becomes the old one and words still met move on.
REMEMBERED = 400_000
#: Words longer than this many bytes are read one by one.
LONG = 48
CHUNK = 50_000
ARCS = 1 << 20
#: Tokens whose arcs are in the bit table (8 MB); merges are made in this order.
TABLED = 8192
#: The pattern of words, its commonest case first; where two cases could match, their order is the file's.
WORDS = regex.compile(
    r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def arc_table(merges: list[tuple[int, int, int]], letters: np.ndarray, size: int) -> np.ndarray:
    """Bits of the arcs t that leave the state u leads to, for tokens below ``size``: the gadgets, one after the other."""
    bits = np.zeros((size, (size + 7) // 8), np.uint8)
    for t in letters.tolist():
        bits[letters, t >> 3] |= np.uint8(1 << (t & 7))
    for u, v, uv in merges:
        if max(u, v) >= size:
            continue
        if uv < size:
            bits[uv] = bits[v]  # uv leads where v leads
        bits[u, v >> 3] &= np.uint8(255 ^ (1 << (v & 7)))  # the copy that u leads to has no arc v
        if uv < size:
            beside = (bits[:, u >> 3] >> (u & 7)) & 1  # arc uv beside every arc u
            bits[:, uv >> 3] |= beside << (uv & 7)
    return bits


class Words:
    """Ids of words already read: a word has a number, a number a stretch of one flat array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.start, self.size, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.used = 0

    def add(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        """New words and their ids, one after the other."""
        n, m = len(self.number), len(words)
        if n + m > len(self.start):
            grown = max(n + m, 2 * len(self.start))
            self.start, self.size = (np.concatenate([x[:n], np.zeros(grown - n, np.int64)]) for x in (self.start, self.size))
        if self.used + len(flat) > len(self.flat):
            grown = max(self.used + len(flat), 2 * len(self.flat))
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(grown - self.used, np.int32)])
        self.flat[self.used: self.used + len(flat)] = flat
        self.size[n: n + m] = size
        self.start[n: n + m] = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.number.update(zip(words, range(n, n + m)))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        return gathered(self.flat, self.start[numbers], size), size


class Automaton:
    def __init__(self, bpe: ByteBpe):
        self.bpe, size = bpe, len(bpe.labels)
        self.labels = bpe.labels
        self.length = np.array([len(x) for x in bpe.labels], np.int32)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.born = np.zeros(size, np.int64)
        for k, (u, v, uv) in enumerate(bpe.merges, 1):
            self.left[uv], self.right[uv], self.born[uv] = u, v, k
        keys = np.array([u * size + v for u, v, _ in bpe.merges], np.int64)
        order = np.argsort(keys)
        self.gadgets, self.rank = keys[order], order + 1
        self.known = np.full(ARCS, -1, np.int64)  # arcs looked up so far: 2 * (state, label) + allowed
        made = set(uv for _, _, uv in bpe.merges) | set(bpe.added.values())
        self.tabled = min(TABLED, size)
        letters = np.array([k for k in range(self.tabled) if k not in made and self.labels[k]], np.int64)
        self.table = arc_table(bpe.merges, letters, self.tabled)
        self._spell()
        self.young, self.old = Words(), Words()
        self.split, self.added = WORDS.findall, set(bpe.added.values())
        self.spelled = np.frombuffer(b"".join(self.labels), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)[:-1]])

    def _spell(self) -> None:
        """Byte transitions that keep the longest ending of the text read which begins a token."""
        tokens = [k for k in range(len(self.labels)) if k not in set(self.bpe.added.values()) and self.labels[k]]
        child: list[dict[int, int]] = [{}]
        depth, ends = [0], {}
        for k in tokens:
            node = 0
            for b in self.labels[k]:
                if b not in child[node]:
                    child[node][b] = len(child)
                    child.append({})
                    depth.append(depth[node] + 1)
                node = child[node][b]
            ends[node] = k
        n = len(child)
        go, back = np.zeros((n, 256), np.int32), np.zeros(n, np.int32)
        longest = np.full(n, -1, np.int32)
        layer = [0]
        while layer:
            following = []
            for node in layer:
                if node:
                    go[node] = go[back[node]]
                    longest[node] = ends.get(node, longest[back[node]])
                for b, to in child[node].items():
                    back[to] = go[node, b]
                    go[node, b] = to
                    following.append(to)
            layer = following
        # A node without children goes on like the node it falls back to, so it needs no row of its own.
        inner = np.array([bool(c) for c in child])
        inner[0] = True
        row = np.cumsum(inner).astype(np.int32) - 1
        for node in np.argsort(depth, kind="stable").tolist():
            if not inner[node]:
                row[node] = row[back[node]]
        self.go, self.row, self.longest = go[inner], row, longest
        self.shorter = np.full(len(self.labels), -1, np.int32)
        for node, k in ends.items():
            self.shorter[k] = longest[back[node]]

    def _arc_by_gadgets(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether an arc t leaves the state that u leads to.

        The state's copies are undone newest first: one made for u (or, further back, for the right parts of u) after t
        came to be may have dropped t; before t came to be, t stood beside the arc of its left part.
        """
        x, y, size = u.copy(), t.copy(), len(self.labels)
        limit = np.full(len(x), np.iinfo(np.int64).max)
        out, todo = np.ones(len(x), bool), np.arange(len(x))
        while len(todo):
            a, b = x[todo], y[todo]
            key = a * size + b
            at = np.minimum(np.searchsorted(self.gadgets, key), len(self.gadgets) - 1)
            dropped = (self.gadgets[at] == key) & (self.rank[at] < limit[todo])
            out[todo[dropped]] = False
            ka, kb = self.born[a], self.born[b]
            on_left = kb > ka
            limit[todo] = np.minimum(limit[todo], np.where(on_left, kb + 1, ka))
            y[todo] = np.where(on_left, self.left[b], b)
            x[todo] = np.where(on_left, a, self.right[a])
            todo = todo[~dropped & ((ka > 0) | (kb > 0))]
        return out

    def arcs(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The same from the tables. From the start (u < 0) all arcs leave."""
        far = np.maximum(u, t) >= self.tabled
        a, b = np.where(far | (u < 0), 0, u), np.where(far, 0, t)
        out = ((self.table[a, b >> 3] >> (b & 7)) & 1).astype(bool)
        out[u < 0] = True
        rest = np.flatnonzero(far & (u >= 0))
        if len(rest):
            out[rest] = self._remembered_arcs(u[rest].astype(np.int64), t[rest])
        return out

    def _remembered_arcs(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        key = u * len(self.labels) + t
        slot = (key * 0x9E3779B1 >> 7) & (ARCS - 1)
        entry = self.known[slot]
        out = (entry & 1).astype(bool)
        miss = np.flatnonzero(entry >> 1 != key)
        if len(miss):
            pairs, where = np.unique(key[miss], return_inverse=True)
            found = self._arc_by_gadgets(pairs // len(self.labels), pairs % len(self.labels))
            out[miss] = found[where]
            self.known[slot[miss]] = 2 * key[miss] + out[miss]
        return out

    def arc(self, u: int, t: int) -> bool:
        """The same for one arc, in plain integers."""
        if u < 0:
            return True
        if max(u, t) < self.tabled:
            return bool(self.table[u, t >> 3] >> (t & 7) & 1)
        return bool(self._remembered_arcs(np.array([u]), np.array([t]))[0])

    def read_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at most ``LONG`` bytes, longest first, all read side by side: one after the other, and counts."""
        size = np.array([len(w) for w in words], np.int64)
        width, n = int(size[0]), len(words)
        text = np.zeros((width, n), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        rows = np.repeat(np.arange(n), size)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), rows] = flat
        last = np.full((width + 1, n), -1, np.int32)
        node = np.zeros(n, np.int32)
        for i in range(1, width + 1):
            m = int(np.searchsorted(-size, -i, side="right"))
            node = self.go[self.row[node[:m]], text[i - 1, :m]]
            pending, t = np.arange(m), self.longest[node].astype(np.int64)
            while len(pending):
                ok = self.arcs(last[i - self.length[t], pending], t)
                last[i, pending[ok]] = t[ok]
                pending, t = pending[~ok], self.shorter[t[~ok]].astype(np.int64)
        out, count, at = np.zeros((n, width), np.int32), np.zeros(n, np.int64), size.copy()
        todo = np.arange(n)
        while len(todo):
            t = last[at[todo], todo]
            count[todo] += 1
            out[todo, width - count[todo]] = t
            at[todo] -= self.length[t]
            todo = todo[at[todo] > 0]
        return out[np.arange(width)[None, :] >= (width - count)[:, None]], count

    def read_long(self, word: bytes) -> list[int]:
        """A step a byte in plain integers; the arcs themselves are told by the same tables."""
        last, node = [-1], 0
        go, row, longest, shorter = self.go, self.row, self.longest, self.shorter
        length = self.length
        for i, b in enumerate(word, 1):
            node = go[row[node], b]
            t = int(longest[node])
            while not self.arc(last[i - int(length[t])], t):
                t = int(shorter[t])
            last.append(t)
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= int(length[last[at]])
        return ids[::-1]

    def learn(self, words: set[str]) -> None:
        """All ``words`` are in the young generation afterwards."""
        if len(self.young.number) > REMEMBERED:
            self.young, self.old = Words(), self.young
        new = words - self.young.number.keys()
        known = list(new & self.old.number.keys())
        if known:
            self.young.add(known, *self.old.ids(np.fromiter(map(self.old.number.__getitem__, known), np.int64, len(known))))
            new.difference_update(known)
        spelled = sorted(((w.encode(), w) for w in new), key=lambda x: -len(x[0]))
        long = sum(len(b) > LONG for b, _ in spelled)
        for b, w in spelled[:long]:
            ids = np.array(self.read_long(b), np.int32)
            self.young.add([w], ids, np.array([len(ids)]))
        for at in range(long, len(spelled), CHUNK):
            part = spelled[at: at + CHUNK]
            self.young.add([w for _, w in part], *self.read_words([b for b, _ in part]))

    def pieces(self, text: str) -> list:
        """The words of a text; an added token stands as its number."""
        if self.bpe.added_pattern is None or not self.bpe.added_pattern.search(text):
            return self.split(text)
        out, at = [], 0
        for m in self.bpe.added_pattern.finditer(text):
            out += [*self.split(text[at: m.start()]), self.bpe.added[m[0]]]
            at = m.end()
        return out + self.split(text[at:])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        cut = [self.pieces(t) if t else [] for t in texts]
        seen = set().union(*cut)
        added = seen & self.added
        self.learn(seen - added)
        new = [k for k in added if k not in self.young.number]
        self.young.add(new, np.array(new, np.int32), np.ones(len(new), np.int64))
        parts = np.cumsum([0, *map(len, cut)])
        numbers = np.fromiter(map(self.young.number.__getitem__, chain.from_iterable(cut)), np.int64, int(parts[-1]))
        flat, size = self.young.ids(numbers)
        return flat, np.diff(np.concatenate([[0], np.cumsum(size)])[parts])

    def spell(self, flat: np.ndarray, size: np.ndarray) -> list[str]:
        """The texts that the labels of the arcs spell, ``size`` ids each."""
        long = self.length[flat].astype(np.int64)
        spelled = gathered(self.spelled, self.spelled_at[flat], long).tobytes()
        ends = np.concatenate([[0], np.cumsum(long)])[np.cumsum([0, *size.tolist()])].tolist()
        return [spelled[a:b].decode("utf-8", errors="replace") for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=1)
def compiled(content: str) -> Automaton:
    """One automaton for all tasks of a worker process."""
    return Automaton(parse(content))


def _added(schema: StructType, field: StructField) -> StructType:
    return StructType([f for f in schema if f.name != field.name] + [field])


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [k for k, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(k) for k in kept], column], names=[*[batch.schema.names[k] for k in kept], name])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.ListArray:
    starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))


def _opened(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists and the lengths of the lists; a null list is empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), size.astype(np.int64)


def encode(df: DataFrame, tokenizer: str, text: str = "text", to: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the token ids of its texts in ``to`` (a column of that name is replaced).

    With ``decoded`` the text that these ids spell is added under that name in the same pass; it is made of the ids alone.
    """
    content = df.sparkSession.sparkContext.broadcast(read(tokenizer))

    def run(batches):
        automaton = compiled(content.value)
        for batch in _slices(batches):
            ids = _lists(*automaton.encode_batch(batch.column(text).to_pylist()))
            batch = _with(batch, to, ids)
            yield batch if decoded is None else _with(batch, decoded, pa.array(automaton.spell(*_opened(ids)), pa.string()))

    schema = _added(df.schema, StructField(to, ArrayType(IntegerType())))
    return df.mapInArrow(run, schema if decoded is None else _added(schema, StructField(decoded, StringType())))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids spell in ``to``; null ids are empty."""
    content = df.sparkSession.sparkContext.broadcast(read(tokenizer))

    def run(batches):
        automaton = compiled(content.value)
        for batch in _slices(batches):
            yield _with(batch, to, pa.array(automaton.spell(*_opened(batch.column(ids))), pa.string()))

    return df.mapInArrow(run, _added(df.schema, StructField(to, StringType())))
