"""Byte-pair encoding with forced boundaries, and its decoding.

Method. A pair of neighbouring bytes that stands inside no vocabulary token can never be joined
by a merge: the cut between them is certain. Texts are first cut as the tokenizer cuts them
(special tokens, then runs of letters, digits, other signs and white space), then at every
certain cut inside those pieces. Each fragment is encoded on its own and the ids are
concatenated; equal fragments of a batch are encoded once. Equal fragments are found by a hash
and compared byte by byte, so no two different ones share their ids.

Texts: null counts as empty; an empty text has no ids. Special token strings in a text give
their special id, as the tokenizer does by default, or count as plain text if so asked.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from structpeak.llm.textbuf import blocks, column_bytes, mix, prefix_hash, span_hash, spans

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: Endings that the tokenizer splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Known fragments, and bytes of them, kept per worker; beyond it the table starts anew.
CACHE_FRAGMENTS, CACHE_BYTES = 600_000, 64_000_000
#: Longer fragments are merged one by one with a heap.
LONG_FRAGMENT = 64


def _byte_letters() -> dict[str, int]:
    """Byte value of each letter of the byte-level alphabet: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
        for m in regex.finditer(kind, text):
            lo, hi = (p if p < 0xD800 else p + 0x800 for p in m.span())
            out[lo:hi] = name
    return out


class Table:
    """Open-addressing map from 64-bit keys to non-negative numbers, read and filled by whole arrays."""

    def __init__(self, bits: int):
        self.size = 0
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every key and whether the key is there; else the slot is the first free one."""
        mask = np.int64(len(self.key) - 1)
        slot = (keys >> np.uint64(20)).astype(np.int64) & mask
        found = self.key[slot] == keys
        free = self.value[slot] < 0
        found &= ~free
        open_ = np.flatnonzero(~found & ~free)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            free[open_] = self.value[slot[open_]] < 0
            found[open_] = ~free[open_] & (self.key[slot[open_]] == keys[open_])
            open_ = open_[~found[open_] & ~free[open_]]
        return slot, found

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot, found = self._probe(keys)
        return np.where(found, self.value[slot], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        if 2 * (self.size + len(keys)) > len(self.key):
            old = self.value >= 0
            held, kept = self.key[old], self.value[old]
            self.__init__((2 * (self.size + len(keys))).bit_length())
            self.put(held, kept)
        self.size += len(keys)
        while len(keys):
            slot, _ = self._probe(keys)
            _, won = np.unique(slot, return_index=True)  # two keys may ask for one free slot
            self.key[slot[won]], self.value[slot[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values = keys[rest], values[rest]


def merge_long(symbols: list[int], joined: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merges one long fragment with a heap over a linked list, lowest rank first and leftmost first."""
    from heapq import heapify, heappop, heappush

    n, symbol = len(symbols), list(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def entry(i: int):
        j = after[i]
        hit = joined.get((symbol[i], symbol[j])) if j < n else None
        return hit and (hit[0], i, symbol[i], symbol[j], hit[1])

    heap = [e for e in map(entry, range(n)) if e]
    heapify(heap)
    while heap:
        _, i, left, right, new = heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or symbol[i] != left or symbol[j] != right:
            continue
        alive[j], symbol[i], after[i] = False, new, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (i, before[i]):
            if k >= 0 and (e := entry(k)):
                heappush(heap, e)
    return [symbol[i] for i in range(n) if alive[i]]


class Encoder:
    """Tables of one tokenizer file and the fragments seen so far."""

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocabulary = spec["model"]["vocab"]
        added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.special = added if special else {}
        special_ids = set(added.values())
        token = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if i not in special_ids}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        name = {b: i for i, b in token.items() if len(b) == 1}
        self.single = np.array([name[bytes([b])] for b in range(256)], np.int64)
        self.joined = {(vocabulary[x], vocabulary[y]): (k, vocabulary[x + y]) for k, (x, y) in enumerate(pairs)}
        self.rank_of = Table(17)
        self.rank_of.put(mix(np.array([x << 32 | y for x, y in self.joined], np.uint64)), np.arange(len(self.joined)))
        self.result = np.array([new for _, new in self.joined.values()], np.int64)
        joins = np.zeros((256, 256), bool)
        for t in token.values():
            if len(t) > 1:
                a = np.frombuffer(t, np.uint8)
                joins[a[:-1], a[1:]] = True
        self.joins = joins.ravel()
        token |= {i: t for t, i in added.items()}
        size = max(token) + 1
        self.length = np.array([len(token.get(i, b"")) for i in range(size)], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token.get(i, b"") for i in range(size)), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known = Table(18)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = self.held = 0
        self.text = np.zeros(1 << 18, np.uint8)  # bytes of the known fragments
        self.offset, self.count, self.text_at, self.text_size = (np.zeros(1 << 16, np.int64) for _ in range(4))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.rank_of.get(mix(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)))

    def merge_all(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments that stand one after another in ``data``, and how many each has.

        All fragments take one merge a round: their pair of lowest rank, leftmost first.
        """
        n, total = len(lengths), len(data)
        none = np.int64(1) << 40
        symbol, alive = self.single[data], np.ones(total, bool)
        owner = np.repeat(np.arange(n), lengths)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        rank = np.full(total, none)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        found = self._rank(symbol[inner], symbol[inner + 1])
        rank[inner] = np.where(found >= 0, found, none)
        stop = np.append(owner, n)
        live = np.arange(total)
        while len(live):
            keep = np.flatnonzero(np.concatenate(([True], owner[live][1:] != owner[live][:-1])))
            best = np.minimum.reduceat(rank[live] << 20 | np.minimum(spans(np.diff(np.append(keep, len(live)))), (1 << 20) - 1), keep)
            some = best < none << 20
            if not some.any():
                break
            at = live[keep[some] + (best[some] & ((1 << 20) - 1))]
            gone = after[at]
            symbol[at] = self.result[best[some] >> 20]
            alive[gone] = False
            nxt = after[gone]
            after[at] = nxt
            inside = nxt < total
            before[nxt[inside]] = at[inside]
            rank[gone] = none
            for i, ok in ((at, stop[np.minimum(nxt, total)] == owner[at]), (before[at], None)):
                if ok is None:
                    ok = i >= 0
                    ok[ok] = owner[i[ok]] == owner[at[ok]]
                    i, j = i[ok], at[ok]
                    hit = self._rank(symbol[i], symbol[j])
                    rank[i] = np.where(hit >= 0, hit, none)
                else:
                    rank[i[~ok]] = none
                    hit = self._rank(symbol[i[ok]], symbol[nxt[ok]])
                    rank[i[ok]] = np.where(hit >= 0, hit, none)
            busy = np.zeros(n, bool)
            busy[owner[at]] = True
            live = live[alive[live] & busy[owner[live]]]
        return symbol[alive], np.bincount(owner[alive], minlength=n)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes new fragments and returns their slots in the flat id table."""
        lengths = ends - starts
        short = lengths <= LONG_FRAGMENT
        size = lengths[short]
        ids, count = self.merge_all(data[np.repeat(starts[short], size) + spans(size)], size)
        counts = np.zeros(len(starts), np.int64)
        counts[short] = count
        long = {}
        for k in np.flatnonzero(~short).tolist():
            long[k] = merge_long(self.single[data[starts[k]:ends[k]]].tolist(), self.joined)
            counts[k] = len(long[k])
        if self.special:
            widths = {len(s) for s in self.special}
            for k in np.flatnonzero(np.isin(lengths, list(widths))).tolist():
                name = data[starts[k]:ends[k]].tobytes()
                if name in self.special:  # its merges are put aside
                    long[k], counts[k] = [self.special[name]], -counts[k] if short[k] else 1
        kept = np.abs(counts)
        own = np.repeat(np.flatnonzero(short), kept[short])
        total = np.where(counts < 0, 1, counts)
        slot, first = self.known.size, self.used + np.cumsum(total) - total
        while self.used + int(total.sum()) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while slot + len(starts) > len(self.offset):
            self.offset, self.count, self.text_at, self.text_size = (np.concatenate((a, np.zeros_like(a))) for a in (self.offset, self.count, self.text_at, self.text_size))
        while self.held + int(lengths.sum()) > len(self.text):
            self.text = np.concatenate((self.text, np.zeros_like(self.text)))
        new = slice(slot, slot + len(starts))
        self.text_at[new], self.text_size[new] = self.held + np.cumsum(lengths) - lengths, lengths
        self.text[self.held:self.held + int(lengths.sum())] = data[np.repeat(starts, lengths) + spans(lengths)]
        self.held += int(lengths.sum())
        plain = counts[own] >= 0
        self.flat[first[own[plain]] + spans(kept[short])[plain]] = ids[plain]
        for k, found in long.items():
            self.flat[first[k]:first[k] + len(found)] = found
        self.offset[slot:slot + len(starts)], self.count[slot:slot + len(starts)] = first, total
        self.used += int(total.sum())
        return np.arange(slot, slot + len(starts))

    def fragment_starts(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """First byte of every fragment: the tokenizer's own pieces, cut again where no token can join two bytes."""
        raw = data.tobytes()
        point = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        at = np.cumsum(width) - width  # byte of each character
        n = len(point)
        kind = _classes()[point]
        edge = np.zeros(n + 1, bool)  # a document, or a special token, begins here
        edge[np.searchsorted(at, borders)] = True
        whole = np.zeros(n, bool)
        for s in self.special:
            taken = -1
            here = raw.find(s)
            while here >= 0:
                i, j = np.searchsorted(at, here), np.searchsorted(at, here + len(s))
                crosses = np.searchsorted(borders, here, "right") != np.searchsorted(borders, here + len(s), "left")
                if here >= taken and not crosses:
                    edge[i] = edge[j] = whole[i:j] = True
                    taken = here + len(s)
                here = raw.find(s, here + 1)
        start = edge.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        start[n] = True
        space, blank = kind == SPACE, point == 0x20
        last = space.copy()  # the last white space before something else in the same text
        last[:-1] &= ~space[1:]
        last &= ~edge[1:]
        start[:-1] |= last  # parts from the white space before it ...
        joined = np.flatnonzero(last & blank) + 1
        start[joined] = False  # ... and a blank goes with what follows
        mark = np.flatnonzero((point == 0x27) & start[:-1])
        if len(mark):
            mark = mark[(mark + 1 < n)]
            mark = mark[~edge[mark + 1] & (kind[mark + 1] == LETTER)]
            for ending in ENDINGS:
                hit = mark[mark + len(ending) < n]
                for k, c in enumerate(ending, 1):
                    hit = hit[point[hit + k] == ord(c)]
                    hit = hit[~edge[hit + k]]
                start[hit + 1] = False
                start[hit + 1 + len(ending)] = True
        out = np.zeros(len(data) + 1, bool)
        out[at[start[:-1]]] = True
        out[1:-1] |= ~self.joins[data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]]
        if whole.any():  # the inside of a special token stays together
            inner = np.flatnonzero(np.repeat(whole, width))
            begins = np.zeros(len(data) + 1, bool)
            begins[at[edge[:-1] & whole]] = True
            out[inner] = begins[inner]
        return np.flatnonzero(out[:-1])

    def encode(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and the borders of each document's ids."""
        n = len(borders) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        starts = self.fragment_starts(data, borders)
        ends = np.append(starts[1:], len(data))
        key = mix(span_hash(prefix_hash(data), starts, ends)) ^ (ends - starts).astype(np.uint64)
        if self.known.size > CACHE_FRAGMENTS or self.held > CACHE_BYTES:
            self._reset()
        slot = self.known.get(key)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first, which = np.unique(key[missing], return_index=True, return_inverse=True)
            first = missing[first]
            got = self._learn(data, starts[first], ends[first])
            self.known.put(new, got)
            slot[missing] = got[which]
        count = self.count[slot]
        other = self._differs(data, starts, ends, slot)
        own = {k: merge_long(self.single[data[starts[k]:ends[k]]].tolist(), self.joined) for k in other.tolist()}
        count[other] = [len(i) for i in own.values()]
        from_table = np.repeat(self.offset[slot], count) + spans(count)
        first = np.cumsum(count) - count
        for k, found in own.items():
            from_table[first[k]:first[k] + len(found)] = 0
        ids = self.flat[from_table]
        for k, found in own.items():
            ids[first[k]:first[k] + len(found)] = found
        total = np.concatenate(([0], np.cumsum(count)))
        return ids, total[np.searchsorted(starts, borders)]

    def _differs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Fragments (they follow one another and fill ``data``) whose hash is that of a known fragment with other bytes."""
        size = ends - starts
        odd = self.text_size[slot] != size
        base = np.where(odd, 0, self.text_at[slot])
        other = np.zeros(len(starts), bool)
        same = self.text[np.where(np.repeat(odd, size), 0, np.repeat(base - starts, size) + np.arange(len(data)))] == data
        other[np.searchsorted(starts, np.flatnonzero(~same), "right") - 1] = True
        return np.flatnonzero(other | odd)

    def decode(self, ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents and the borders of each, from their ids."""
        length = self.length[ids]
        out = self.bytes[np.repeat(self.first[ids], length) + spans(length)]
        return out, np.concatenate(([0], np.cumsum(length)))[borders]


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path, special)


def _texts(data: np.ndarray, borders: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` (array of int) and ``decoded`` (text rebuilt from the ids) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(1))
            for lo, hi, part, local in blocks(data, borders):
                ids, cut = coder.encode(part, local)
                back, own = coder.decode(ids, cut)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)),
                    pa.array(_texts(back, own), pa.string()),
                ], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
