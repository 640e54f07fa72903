"""Best-two-fit packing of documents into token sequences of bounded length.

A document is its token ids and one end id. Documents longer than a sequence are cut into full
pieces behind a shorter first piece. Full pieces fill sequences alone; all others are packed by
best-two-fit: a sequence is filled greedily, largest piece that fits first; then its smallest
piece is replaced by the two unpacked pieces that fill the gap it leaves most tightly, if they
fill it better.

Sizes are whole numbers up to ``capacity``, so the plan depends on nothing but how many pieces
have each size: the driver sees at most ``capacity`` counts and makes at most a few thousand
sequence patterns, each with a repeat count, whatever the number of documents. A piece finds its place
from its rank among the pieces of its size. Ranks come from hashed buckets inside a size, so a
size that holds most of the pieces is still ranked by many tasks.

Null and empty texts are one piece of the end id alone. Rows may repeat: equal keys get
places of their own. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structpeak.llm.byte_pairs import encoder
from structpeak.llm.storage import saved
from structpeak.llm.textbuf import blocks, column_bytes, spans

#: Pieces of one size that one task ranks, on average.
RANK_ROWS = 200_000


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text", summarise=None) -> DataFrame:
    """Pieces of every document: ``key, piece, start, length, ids`` (little-endian unsigned 32-bit ids).

    ``summarise`` maps the ids column to other columns when the ids themselves are not wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(1))
            for lo, hi, part, local in blocks(data, borders):
                ids, cut = coder.encode(part, local)
                size = np.diff(cut) + 1
                flat = np.full(int(size.sum()), end_id, "<u4")
                first = np.cumsum(size) - size
                flat[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), np.diff(cut))] = ids
                count = -(-size // capacity)
                head = size - (count - 1) * capacity
                document, piece = np.repeat(np.arange(hi - lo), count), spans(count)
                start = np.where(piece == 0, 0, head[document] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[document], capacity)
                edge = np.append(first[document] + start, len(flat)) * 4
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(lo + document)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.Array.from_buffers(pa.binary(), len(document), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(flat)]),
                ], ["key", "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids binary")
    if summarise is not None:
        out = out.select("key", "piece", "start", "length", *summarise(F.col("ids")))
    return out.withColumnRenamed("key", key)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Sequence patterns (sizes in order of place) and how many sequences follow each."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    sizes = np.arange(capacity + 1)
    out = []
    while left.any():
        gap, bin_ = capacity, []
        while gap and (fits := np.flatnonzero(left[1:gap + 1])).size:
            size = int(fits[-1]) + 1
            bin_.append(size)
            left[size] -= 1
            gap -= size
        if gap and len(bin_) > 1:
            room = gap + bin_[-1]
            have = np.flatnonzero(left[:room])
            have = have[have > 0]
            best, pair = bin_[-1], None
            present = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # largest size left up to each size
            if have.size:
                other = present[room - have]
                alone = (other == have) & (left[have] < 2)  # the only piece of its size is no pair
                other[alone] = present[have[alone] - 1]
                total = np.where(other > 0, have + other, 0)
                k = int(np.argmax(total))
                if total[k] > best:
                    pair = [int(have[k]), int(other[k])]
            if pair:
                left[bin_.pop()] += 1
                for size in pair:
                    left[size] -= 1
                bin_ += sorted(pair, reverse=True)
        used, need = np.unique(bin_, return_counts=True)
        repeat = 1 + int((left[used] // need).min())
        left[used] -= need * (repeat - 1)
        out.append((bin_, repeat))
    return out


def slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each size and pattern: the first rank it takes, pieces a sequence, first sequence, first place."""
    rows, taken, sequence = [], {}, 0
    for number, (bin_, repeat) in enumerate(plan):
        for size in dict.fromkeys(bin_):  # equal sizes stand side by side
            each = bin_.count(size)
            rows.append((size, taken.get(size, 0), each, sequence, sum(s for s in bin_[:bin_.index(size)])))
            taken[size] = taken.get(size, 0) + each * repeat
        sequence += repeat
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("size", "rank", "each", "sequence", "place"), table.T, strict=True))


def pack(pieces: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every piece; ``pieces`` needs ``key, piece, length``."""
    pieces = saved(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = slots(patterns(counts, capacity))
    buckets = 1 + max(counts.values(), default=0) // RANK_ROWS
    own = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    before = (
        own.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    )
    inside = Window.partitionBy("length", "_bucket").orderBy(key, "piece")
    ranked = own.withColumn("_in", F.row_number().over(inside) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_in"))

    span = np.int64(1) << 40
    line = table["size"] * span + table["rank"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(line, size * span + rank, "right") - 1
        inner = rank - table["rank"][at]
        each = table["each"][at]
        return pd.DataFrame({"sequence_id": table["sequence"][at] + inner // each, "offset": table["place"][at] + inner % each * size})

    return ranked.withColumn("_at", place("length", "_rank")).select(*pieces.columns, "_at.sequence_id", "_at.offset")
