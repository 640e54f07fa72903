"""Exact substring deduplication by a suffix sort with hash comparisons.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes. Matches never
cross documents and are judged on the input.

Sorting all suffixes of a large corpus in one place is out of reach, so the sort is dealt out by content. Each
window of ``LENGTH`` bytes names its anchor: the run of ``GRAM`` bytes inside it with the smallest
hash, leftmost first. Equal windows have equal anchors at equal offsets, so a window can only
repeat where its anchor does. Neighbouring windows with one anchor make a unit (about
eighty windows). Units whose anchor is unique are done; units of one anchor with one content are whole
repeats. For the rest, the distinct contexts of an anchor meet in one task, which sorts the suffixes that
begin at their windows: a merge sort whose comparisons find the common extension by
binary search over prefix polynomial hashes. Neighbours in the order that agree over ``LENGTH`` bytes
are compared byte by byte. An anchor with more than ``HOT`` distinct contexts is spread by the hashes of
its single windows instead, so no task holds an unbounded group.

Null texts are empty; texts shorter than ``LENGTH`` bytes lose nothing. Rows may repeat: copies count as
other places, so both lose what they share. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.llm.storage import saved
from structpeak.llm.textbuf import blocks, column_bytes, mix, powers, prefix_hash, runs_of, span_hash, spans

LENGTH, GRAM = 200, 40
HOT = 4096
#: Bytes of contexts that are sorted together; anchors are never cut apart.
SORT_BYTES = 1_000_000


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` neighbours."""
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def units_of(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, first and last window, anchor hash and content hash of every unit."""
    count = np.maximum(np.diff(borders) - LENGTH + 1, 0)
    if not count.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hash(data)
    gram = np.arange(len(data) - GRAM + 1)
    hashed = mix(span_hash(prefix, gram, gram + GRAM))
    least = _sliding_least((hashed & np.uint64(0xFFFFFFFF00000000)) | gram.astype(np.uint64), LENGTH - GRAM + 1)
    document = np.repeat(np.arange(len(count)), count)
    window = np.repeat(borders[:-1], count) + spans(count)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1]))))
    first, last = window[head], window[np.append(head[1:], len(window)) - 1]
    at = anchor[head]
    content = mix(span_hash(prefix, first, last + LENGTH)) + mix((at - first).astype(np.uint64))
    return document[head], first, last, hashed[at], content


def _keyed(docs: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """Rows with two hashes that name them; null keys and repeated keys are fine."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(key, body).alias("k1"), F.hash(body, key).alias("k2"), F.col(key).alias("key"), body.alias("text"), F.struct(*carry, F.lit(0).alias("_")).alias("rest"))


def _units(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(2))
            for lo, hi, part, local in blocks(data, borders):
                document, first, last, anchor, content = units_of(part, local)
                at = pa.array(lo + document)
                base = local[document] if len(document) else document
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at),
                    pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)),
                ], ["anchor", "content", "k1", "k2", "first", "last"])

    return rows.select("k1", "k2", "text").mapInArrow(run, "anchor long, content long, k1 long, k2 int, first int, last int")


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Length of the common beginning of the suffixes at x and y, up to ``limit``, by binary search over hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), limit, np.int64)
    down = powers(len(prefix), "down")
    from_x, from_y, scale_x, scale_y = prefix[x], prefix[y], down[x], down[y]
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = (prefix[x + middle] - from_x) * scale_x == (prefix[y + middle] - from_y) * scale_y
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    return low


def suffix_order(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``start`` by their first ``LENGTH`` bytes, inside each segment; segments stand together.

    A bottom-up merge sort of all segments at once: each element finds its place in the run beside its own by
    binary search, so a merge is a handful of array steps.
    """
    n = len(start)
    order = np.arange(n)
    head = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    base = np.repeat(head, np.diff(np.append(head, n)))
    stop = np.repeat(np.append(head[1:], n), np.diff(np.append(head, n)))
    place = np.arange(n)
    width, longest = 1, int((stop - base).max(initial=1))
    while width < longest:
        local = place - base
        own = local // width
        right = own % 2 == 1
        low = base + (own + np.where(right, -1, 1)) * width
        high = np.minimum(low + width, stop)
        low = np.minimum(low, stop)
        begin = low.copy()
        at = np.flatnonzero(low < high)
        while len(at):
            middle = (low[at] + high[at]) >> 1
            x, y = start[order[at]], start[order[middle]]
            same = common_extension(prefix, x, y)
            inside = same < LENGTH
            reach = np.minimum(same, LENGTH - 1)
            less = inside & (data[y + reach] < data[x + reach])  # the other stands before
            less |= ~inside & right[at]  # equal ones of the left run stand before
            low[at] = np.where(less, middle + 1, low[at])
            high[at] = np.where(less, high[at], middle)
            at = at[low[at] < high[at]]
        first_of_pair = base + (own - right) * width
        target = first_of_pair + (local - own * width) + (low - begin)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order = merged
        width *= 2
    return order


def repeated_windows(data: np.ndarray, borders: np.ndarray, anchor: np.ndarray, offset: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Flags of all windows of contexts (one after another) that another context, or a copy, has too.

    ``anchor`` numbers each context's anchor, ``offset`` says where the anchor stands in it, ``copies`` how often the
    context occurs.
    """
    count = np.diff(borders) - LENGTH + 1
    context = np.repeat(np.arange(len(count)), count)
    start = borders[context] + spans(count)
    distance = offset[context] - (start - borders[context])  # equal windows stand equally far before the anchor
    segment = anchor[context] * np.int64(2 * LENGTH) + distance
    by = np.argsort(segment, kind="stable")
    start, segment, context = start[by], segment[by], context[by]
    prefix = prefix_hash(data)
    order = suffix_order(data, prefix, start, segment)
    start, context = start[order], context[order]
    pair = np.flatnonzero(segment[1:] == segment[:-1])
    pair = pair[common_extension(prefix, start[pair], start[pair + 1]) == LENGTH]
    true = np.ones(len(pair), bool)  # hashes agree; do the bytes?
    for lo in range(0, len(pair), 20_000):
        p = pair[lo:lo + 20_000]
        step = np.arange(LENGTH)
        true[lo:lo + 20_000] = (data[start[p][:, None] + step] == data[start[p + 1][:, None] + step]).all(axis=1)
    flag = np.zeros(len(start), bool)
    flag[pair[true]] = True
    flag[pair[true] + 1] = True
    for s in np.unique(segment[pair[~true]]).tolist():  # a collision: this segment again, by its bytes
        inside = np.flatnonzero(segment == s)
        seen: dict[bytes, list[int]] = {}
        for i in inside.tolist():
            seen.setdefault(data[start[i]:start[i] + LENGTH].tobytes(), []).append(i)
        for group in seen.values():
            flag[group] = len(group) > 1
    out = np.zeros(len(start), bool)
    out[by[order]] = flag | (copies[context] > 1)
    return out


def _flag_runs(flag: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first and last index (from 0 in the owner) of the runs of set flags."""
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    at = np.flatnonzero(flag)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(at)) - 1
    who = owner[at[head]] if len(at) else at
    return who, at[head] - cut[who], at[tail] - cut[who] if len(at) else at


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of windows of each (anchor, content); rows come ordered by anchor."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        data, borders, _ = column_bytes(rows.column("context"))
        anchor, number = np.unique(np.asarray(rows.column("anchor")), return_inverse=True)
        flags = repeated_windows(data, borders, number, np.asarray(rows.column("offset")).astype(np.int64), np.asarray(rows.column("copies")))
        cut = np.concatenate(([0], np.cumsum(np.diff(borders) - LENGTH + 1)))
        who, first, last = _flag_runs(flags, cut)
        take = pa.array(who)
        return pa.RecordBatch.from_arrays([rows.column("anchor").take(take), rows.column("content").take(take), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["anchor", "content", "from", "to"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            anchors = np.asarray(batch.column(0))
            if size >= SORT_BYTES:  # go on to the end of the anchor
                end = int(np.searchsorted(anchors != np.asarray(held[-1].column(0))[-1], True))
                if end:
                    held.append(batch.slice(0, end))
                if end == batch.num_rows:
                    break
                yield flush(held)
                held, size = [], 0
                batch = batch.slice(end)
                continue
            width = np.cumsum(np.diff(column_bytes(batch.column("context"))[1]))
            end = int(np.searchsorted(width, SORT_BYTES - size)) + 1
            held.append(batch.slice(0, end))
            size += int(width[min(end, len(width)) - 1])
            batch = batch.slice(end)
    if held:
        yield flush(held)


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of every window of hot anchors' contexts."""
    for batch in batches:
        data, borders, _ = column_bytes(batch.column("context"))
        for lo, _, part, local in blocks(data, borders, SORT_BYTES):
            count = np.diff(local) - LENGTH + 1
            context = np.repeat(np.arange(len(count)), count)
            at = local[context] + spans(count)
            prefix, other = prefix_hash(part), prefix_hash(part ^ np.uint8(0xA5))
            take = pa.array(lo + context)
            yield pa.RecordBatch.from_arrays([
                batch.column("anchor").take(take), batch.column("content").take(take), batch.column("copies").take(take), pa.array(spans(count).astype(np.int32)),
                pa.array(mix(span_hash(prefix, at, at + LENGTH)).view(np.int64)), pa.array(mix(span_hash(other, at, at + LENGTH)).view(np.int64)),
            ], ["anchor", "content", "copies", "at", "w1", "w2"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted units of each row's text; ``offset`` is where the anchor stands in them."""
    names = ["anchor", "content", "copies", "hot", "offset", "context"]
    for batch in batches:
        text, wanted = batch.column("text"), batch.column("wanted")
        for i in np.flatnonzero(np.asarray(wanted.is_valid())).tolist():
            data, _, _ = column_bytes(text.slice(i, 1))
            unit = wanted[i].values
            first, last = np.asarray(unit.field("first")), np.asarray(unit.field("last"))
            own = np.concatenate(([0], np.cumsum(last - first + LENGTH)))
            flat = data[np.repeat(first - own[:-1], np.diff(own)) + np.arange(own[-1])]
            context = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(own.astype(np.int32)), pa.py_buffer(flat)])
            prefix = prefix_hash(data[int(first.min()):int(last.max()) + LENGTH])
            base = int(first.min())
            # the anchor is the first gram of its hash among those every window of the unit holds
            room = np.maximum(LENGTH - GRAM + 1 - (last - first), 1)
            owner, gram = np.repeat(np.arange(len(first)), room), np.repeat(last - base, room) + spans(room)
            hit = mix(span_hash(prefix, gram, gram + GRAM)).view(np.int64) == np.asarray(unit.field("anchor"))[owner]
            found = np.flatnonzero(hit)
            _, at = np.unique(owner[found], return_index=True)
            offset = gram[found[at]] + base - first
            yield pa.RecordBatch.from_arrays([unit.field("anchor"), unit.field("content"), unit.field("copies"), unit.field("hot"), pa.array(offset.astype(np.int32)), context], names)


def _cut_out(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(1))
            for lo, hi, part, local in blocks(data, borders):
                gone = batch.column(2).slice(lo, hi - lo)
                unit = gone.flatten()
                owner = np.repeat(np.arange(hi - lo), np.asarray(gone.value_lengths().fill_null(0)))
                mark = np.zeros(len(part) + 1, np.int64)
                np.add.at(mark, local[owner] + np.asarray(unit.field("first")), 1)
                np.add.at(mark, local[owner] + np.asarray(unit.field("end")), -1)
                removed = np.cumsum(mark)[:-1] > 0
                total = np.concatenate(([0], np.cumsum(removed)))
                edge = removed.copy()
                edge[1:] &= ~removed[:-1]
                begins = local[:-1][np.diff(local) > 0]
                edge[begins] = removed[begins]
                span = np.concatenate(([0], np.cumsum(edge)))
                n_removed = total[local[1:]] - total[local[:-1]]
                kept, own = part[~removed], local - total[local]
                if as_text:
                    raw = kept.tobytes()
                    body = pa.array([raw[a:b].decode("utf-8", "ignore") for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)], pa.string())
                else:
                    body = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(own.astype(np.int32)), pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), pa.array(np.diff(local)), pa.array(n_removed), pa.array(span[local[1:]] - span[local[:-1]]), body], ["key", "rest", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", as_text: bool = False, hot: int = HOT, carry: list[str] | None = None) -> DataFrame:
    """``key``, the columns named in ``carry``, ``n_bytes, n_removed, n_spans, kept`` for every row.

    ``kept`` holds the bytes left; with ``as_text`` it is a string, without characters that lost some of their bytes.
    """
    rows = _keyed(docs, key, text, carry or [])
    units = _units(rows)
    often = units.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1")
    often = saved(often.select("anchor", (F.col("low") != F.col("high")).alias("mixed")), "anchors")  # so that the join may split what an often seen anchor brings
    candidates = saved(units.join(often, "anchor"), "units")
    mixed = candidates.where("mixed")
    one = mixed.groupBy("anchor", "content").agg(F.min(F.struct("k1", "k2", "first", "last")).alias("at"), F.count(F.lit(1)).alias("copies"))
    one = saved(one, "contents")
    crowded = one.groupBy("anchor").agg((F.count(F.lit(1)) > hot).alias("hot"))
    wanted = one.join(crowded, "anchor").groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("anchor", "content", "copies", "hot", "at.first", "at.last")).alias("wanted"))  # units of one text
    found = rows.join(wanted, ["k1", "k2"], "left").select("text", "wanted").mapInArrow(_contexts, "anchor long, content long, copies long, hot boolean, offset int, context binary")
    found = saved(found.dropDuplicates(["anchor", "content"]), "contexts")
    sort = found.where("not hot").select("anchor", "content", "copies", "offset", "context").repartition("anchor").sortWithinPartitions("anchor")
    runs = sort.mapInArrow(_sorted_repeats, "anchor long, content long, `from` int, `to` int")
    single = found.where("hot").select("anchor", "content", "copies", "context").mapInArrow(_window_hashes, "anchor long, content long, copies long, at int, w1 long, w2 long")
    twice = single.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1").select("w1", "w2")
    spread = single.join(twice, ["w1", "w2"], "left_semi").select("anchor", "content", F.col("at").alias("from"), F.col("at").alias("to"))
    hits = mixed.join(runs.union(spread), ["anchor", "content"]).select("k1", "k2", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to") + LENGTH).alias("end"))
    whole = candidates.where("not mixed").select("k1", "k2", "first", (F.col("last") + LENGTH).alias("end"))
    gone = whole.union(hits).groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "end")).alias("gone"))  # spans of one text
    out = rows.join(gone, ["k1", "k2"], "left").select("key", "text", "gone", "rest")
    kind, rest = (out.schema[c].dataType.simpleString() for c in ("key", "rest"))
    out = out.mapInArrow(_cut_out(as_text), f"key {kind}, rest {rest}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")
    return out.select(F.col("key").alias(key), *(f"rest.{c}" for c in carry or []), "n_bytes", "n_removed", "n_spans", "kept")
