"""Alignment of two tokenizers over one text: groups between common token ends, and which ids overlap.

Both tokenizers cut the same bytes (a blank and the text). Their token ends are two rising lists. The
shorter one drives: each of its ends gallops into the longer list, by steps that double until they
pass it and a binary search in the last step. Ends that both hold cut the tokens into groups; the
difference of the ranks of a token's two ends is the range of tokens of the other side that it overlaps.

How often two ids overlap is counted over the corpus. A task works on blocks of whole documents and
writes for each block its documents' links as numbers into the block's own list of distinct pairs. Only
these lists are exploded, counted and joined with the counts; a block then gets its list back,
with counts, and sums them by document. Nothing is collected, no pair is dropped, and a pair that
stands in every document is one row a block.

Texts that are null, empty, or whose joined tokens are other bytes than a blank and the text have no
tokens: zeros, and an empty digest. Special token strings are plain text. Keys may be null or
repeated; very long texts make a block of their own; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.llm.byte_pairs import Encoder
from structpeak.llm.pieces import PieceEncoder, text_list
from structpeak.llm.storage import saved
from structpeak.llm.textbuf import blocks, column_bytes, spans

#: Bytes of text in a block.
BLOCK = 300_000
#: Every 64th end of the driving list is sought first, then every 16th and so on; each starts where the one sought before it ended.
STRIDES = (64, 16, 4, 1)


def first_not_below(wanted: np.ndarray, start: np.ndarray, values: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each number wanted, the first place from ``start`` and before ``stop`` in the rising ``values`` that isn't below it, else ``stop``."""
    low, high = start.copy(), stop.copy()
    open_, step = np.flatnonzero(start < stop), 1
    while len(open_):
        probe = np.minimum(start[open_] + step - 1, stop[open_] - 1)
        below = values[probe] < wanted[open_]
        low[open_[below]] = probe[below] + 1
        high[open_[~below]] = probe[~below]
        open_ = open_[below & (probe < stop[open_] - 1)]
        step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = values[middle] < wanted[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def galloped(ends: np.ndarray, index: np.ndarray, document: np.ndarray, cut: np.ndarray, others: np.ndarray, other_cut: np.ndarray) -> np.ndarray:
    """Rank among ``others`` of the ends named by ``index``, each inside its own document."""
    begin, stop = other_cut[document], other_cut[document + 1]
    place = index - cut[document]
    rank = begin.copy()
    known = np.zeros(len(index), bool)
    for stride in STRIDES:
        now = ~known & (place % stride == 0)
        from_ = np.maximum.accumulate(np.where(known, np.arange(len(index)), 0))[now]  # the places of one document stand together
        from_ = np.where(known[from_] & (document[from_] == document[now]), rank[from_], begin[now])
        rank[now] = first_not_below(ends[index[now]], from_, others, stop[now])
        known |= now
    return rank


@lru_cache(maxsize=1)
def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to ``most``, each followed by a comma up to one width, and how many there are."""
    text = [str(k).encode() for k in range(most + 1)]
    width = len(text[-1])
    return np.frombuffer(b"".join(t.ljust(width, b",") for t in text), np.uint8).reshape(-1, width), np.array([len(t) for t in text])


class Aligned:
    """The two token lists of a block's documents, where they meet and where they overlap."""

    def __init__(self, a: tuple, b: tuple):
        (self.a_ids, a_length, self.a_cut), (self.b_ids, b_length, self.b_cut) = a, b
        a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
        n_a, n_b = np.diff(self.a_cut), np.diff(self.b_cut)
        a_drives = n_a <= n_b
        links, self.meets = [], []
        for drives, n, end, cut, other_end, other_cut in ((a_drives, n_a, a_end, self.a_cut, b_end, self.b_cut), (~a_drives, n_b, b_end, self.b_cut, a_end, self.a_cut)):
            document = np.repeat(np.flatnonzero(drives), n[drives])
            index = np.repeat(cut[:-1][drives], n[drives]) + spans(n[drives])
            rank = galloped(end, index, document, cut, other_end, other_cut)
            common = other_end[rank] == end[index] if len(index) else np.zeros(0, bool)
            lowest = np.empty(len(index), np.int64)  # the first of the other side that reaches beyond this token's start
            lowest[1:] = (rank + common)[:-1]
            opens = index == cut[document]
            lowest[opens] = other_cut[document[opens]]
            count = rank - lowest + 1
            own, other = np.repeat(index, count), np.repeat(lowest, count) + spans(count)
            links.append((own, other, np.repeat(document, count)))
            self.meets.append((index[common], rank[common], document[common]))
        (a1, b1, d1), (b2, a2, d2) = links
        order = np.argsort(np.concatenate((d1, d2)), kind="stable")
        self.link_a, self.link_b = np.concatenate((a1, a2))[order], np.concatenate((b1, b2))[order]
        self.link_cut = np.searchsorted(np.concatenate((d1, d2))[order], np.arange(len(n_a) + 1))
        (a1, b1, d1), (b2, a2, d2) = self.meets
        order = np.argsort(np.concatenate((a1, a2)), kind="stable")
        #: Token after the last of each group, on either side, and the borders of each document's groups.
        self.group_a, self.group_b = np.concatenate((a1, a2))[order] + 1, np.concatenate((b1, b2))[order] + 1
        self.group_cut = np.searchsorted(np.concatenate((d1, d2))[order], np.arange(len(n_a) + 1))

    def group_texts(self) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of every document, as bytes with borders."""
        n_a, n_b = len(self.a_ids), len(self.b_ids)
        size_a, size_b = np.diff(self.group_a, prepend=0), np.diff(self.group_b, prepend=0)
        at_a = np.arange(n_a) + np.repeat(self.group_b - size_b, size_a)
        at_b = np.arange(n_b) + np.repeat(self.group_a, size_b)
        value = np.zeros(n_a + n_b, np.int64)
        value[at_a], value[at_b] = self.a_ids, self.b_ids
        name, length = decimals(max(int(value.max(initial=0)), 1 << 16))
        sign = np.full((n_a + n_b, name.shape[1] + 1), ord(","), np.uint8)
        sign[:, :-1] = name[value]
        length = length[value]
        sign[at_a[self.group_a - 1], length[at_a[self.group_a - 1]]] = ord("|")
        sign[at_b[self.group_b - 1], length[at_b[self.group_b - 1]]] = ord(";")
        shown = np.arange(sign.shape[1]) <= length[:, None]
        own = self.a_cut + self.b_cut
        last = own[1:][np.diff(own) > 0] - 1
        shown[last, length[last]] = False
        length += 1
        length[last] -= 1
        return sign[shown], np.concatenate(([0], np.cumsum(length)))[own]


class Aligner:
    """Both encoders of a worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Encoder(a_path, special=False), PieceEncoder(b_path, decodes=False)
        self.b_size = len(self.b.length)

    def align(self, data: np.ndarray, borders: np.ndarray) -> Aligned:
        """Documents without tokens keep their place, with empty lists."""
        n, size = len(borders) - 1, np.diff(borders)
        some = np.flatnonzero(size)
        edge = np.concatenate(([0], np.cumsum(size[some] + 1)))
        spaced = np.full(edge[-1], 0x20, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(np.arange(1, len(some) + 1), size[some])] = data
        a_ids, a_cut = self.a.encode(spaced, edge)
        b_ids, b_cut = self.b.ids_of(*self.b.slots(text_list(data, np.append(borders[some], borders[-1]))))
        sound = np.ones(len(some), bool)
        for coder, ids, cut in ((self.a, a_ids, a_cut), (self.b, b_ids, b_cut)):
            length = coder.length[ids]
            joined = coder.bytes[np.repeat(coder.first[ids], length) + spans(length)]
            own = np.concatenate(([0], np.cumsum(length)))[cut]
            sound &= np.array([np.array_equal(joined[own[k]:own[k + 1]], spaced[edge[k]:edge[k + 1]]) for k in range(len(some))], bool)
        sides = []
        for coder, ids, cut in ((self.a, a_ids, a_cut), (self.b, b_ids, b_cut)):
            count = np.zeros(n, np.int64)
            count[some] = np.where(sound, np.diff(cut), 0)
            kept = ids[np.repeat(sound, np.diff(cut))]
            sides.append((kept, coder.length[kept], np.concatenate(([0], np.cumsum(count)))))
        return Aligned(*sides)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One pair of encoders per worker."""
    return Aligner(a_path, b_path)


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def _one(values) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _aligned_blocks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple]:
    both = aligner(a_path, b_path)
    for batch in batches:
        data, borders, _ = column_bytes(batch.column(1))
        for lo, hi, part, local in blocks(data, borders, BLOCK):
            yield batch.column(0).slice(lo, hi - lo), both.align(part, local)


def token_groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the ids of either side and, for each group, the place after its last token on either side (``group_a``, ``group_b``, from the document's start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in _aligned_blocks(batches, a_path, b_path):
            groups = np.diff(found.group_cut)
            yield pa.RecordBatch.from_arrays([
                keys, _lists(found.a_ids.astype(np.int32), found.a_cut), _lists(found.b_ids.astype(np.int32), found.b_cut),
                _lists((found.group_a - np.repeat(found.a_cut[:-1], groups)).astype(np.int32), found.group_cut),
                _lists((found.group_b - np.repeat(found.b_cut[:-1], groups)).astype(np.int32), found.group_cut),
            ], ["key", "a_ids", "b_ids", "group_a", "group_b"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>").withColumnRenamed("key", key)


def link_blocks(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a block: its documents' measures, its distinct id pairs with their counts, and each link as a place in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        size = aligner(a_path, b_path).b_size
        for keys, found in _aligned_blocks(batches, a_path, b_path):
            pair, place, n = np.unique(found.a_ids[found.link_a].astype(np.int64) * size + found.b_ids[found.link_b], return_inverse=True, return_counts=True)
            flat, own = found.group_texts()
            digest = [hashlib.sha256(flat[x:y]).hexdigest() if y > x else "" for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([task << 32 | number]), _one(keys), _one(np.diff(found.a_cut)), _one(np.diff(found.b_cut)), _one(np.diff(found.group_cut)), _one(pa.array(digest, pa.string())),
                _one(found.link_cut.astype(np.int64)), pa.array([place.astype("<u2" if len(pair) < 1 << 16 else "<u4").tobytes()]), _one(pair), _one(n.astype(np.int64)),
            ], ["block", "keys", "n_a", "n_b", "n_groups", "digest", "cut", "link", "pair", "n"])
            number += 1

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, (
        f"block long, keys array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, digest array<string>, cut array<long>, link binary, pair array<long>, n array<long>"
    ))


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """``pair, count, best`` over the corpus: the links of every id pair, and whether it is the most frequent of its B id."""
    counts = found.select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.col("pair") % b_size).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    found = saved(link_blocks(docs, a_path, b_path, text, key), "links")
    counts = saved(pair_counts(found, aligner(a_path, b_path).b_size), "pairs")
    listed = found.select("block", F.explode("pair").alias("pair")).join(counts, "pair")
    lists = listed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("list"))  # in the order of the links' places
    joined = found.drop("pair", "n").join(lists, "block", "left").select(
        "keys", "n_a", "n_b", "n_groups", "digest", "cut", "link",
        F.coalesce("list.count", F.array().cast("array<long>")).alias("count"), F.coalesce("list.best", F.array().cast("array<boolean>")).alias("best"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = {name: batch.column(name)[row].values for name in batch.schema.names if name != "link"}
                cut, count, best = (np.asarray(of[name]) for name in ("cut", "count", "best"))
                link = np.frombuffer(batch.column("link")[row].as_buffer(), "<u2" if len(count) < 1 << 16 else "<u4")
                n_best, total = (np.diff(np.concatenate(([0], np.cumsum(each[link], dtype=np.int64)))[cut]) for each in (best.astype(np.int64), count))
                yield pa.RecordBatch.from_arrays([
                    of["keys"], of["n_a"], of["n_b"], of["n_groups"], pa.array(np.diff(cut)), pa.array(n_best), pa.array(total), of["digest"],
                ], ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = joined.mapInArrow(run, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("key", key)
