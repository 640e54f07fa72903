"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct runs of five words, lower-cased in A-Z (a shorter text is one run). 192
registers keep, for the smallest hash of their bucket, the number of leading zeros and ten
mantissa bits: sixteen bits each. Texts of at most ``SMALL`` runs would leave buckets empty, so
they take every register over their whole set with a hash of its own; larger ones use each hash in one
bucket, and an empty bucket takes its right neighbour's. Texts between the two get both kinds, so that any
similar pair shares a kind. Forty-eight bands of four registers give candidates (a link of
similarity 0.75 is missed with a chance near 1e-8). Members of a band that its smallest member doesn't link
are compared block by block: the Jaccard similarity estimated from the registers, corrected for
chance collisions, rules out far pairs (a link of 0.75 with a chance of 1e-6). Links are confirmed on the full sets.

Equal sets are collapsed to one before banding, and a set is named by 128 bits of its own hashes, never by
a document's key: keys may have any type that can be ordered, may repeat and may be null. A component's id is its smallest key that is not
null (null if it has none), and a row is kept if that is its key, so rows that share this key are all kept; ``lead`` marks one row of
each component (the first by key, nulls last, then by the row's names ``r1, r2``; rows equal in key and text go together). Texts that are null or
without words have empty sets: each is its own component, kept and lead. Texts may have any length. An empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structpeak.llm.links import LEAST, candidate_groups, linked
from structpeak.llm.storage import saved
from structpeak.llm.textbuf import BASE, LOWER, blocks, column_bytes, mix, runs_of, span_keys, windows, words

RUN, REGISTERS, BAND = 5, 192, 4
BANDS = REGISTERS // BAND
MANTISSA = 10
SMALL = 400
OVERLAP = SMALL * LEAST[1] // LEAST[0]
#: Estimated similarity below which no pair of 0.75 lies: about five standard errors.
FAR = 0.6
#: Members of a group that are compared with as many others at a time.
BLOCK = 64
#: Bytes of a set's name.
NAME = 16
_odd = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * BASE) | np.uint64(1)
_add = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) + BASE)


def shingle_sets(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of all documents, sorted inside each, and their borders."""
    n = len(borders) - 1
    low = LOWER[data]
    start, end, document = words(data, borders)
    word = span_keys(low, start, end)
    hashed, at = windows(word, document, RUN)
    owner = document[at]
    count = np.bincount(document, minlength=n)
    first = np.searchsorted(document, np.arange(n))
    short = np.flatnonzero((count > 0) & (count < RUN))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(RUN - 1):
            there = count[short] > k
            whole[there] = whole[there] * BASE + word[first[short[there]] + k]
        hashed, owner = np.concatenate((hashed, mix(whole + count[short].astype(np.uint64)))), np.concatenate((owner, short))
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    hashed, owner = hashed[fresh], owner[fresh]
    return hashed, runs_of(owner, n)


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each value, in sixteen bits."""
    high = (least >> np.uint64(12)).astype(np.float64)  # 52 bits: exact
    fraction, exponent = np.frexp(high)
    zeros = np.where(high > 0, 52 - exponent, 52)
    mantissa = np.where(high > 0, (fraction - 0.5) * 2 * (1 << MANTISSA), 0)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)


def whole_registers(hashed: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Every register over the whole set; sets must not be empty."""
    out = np.empty((len(cut) - 1, REGISTERS), np.uint64)
    for k in range(REGISTERS):
        out[:, k] = np.minimum.reduceat(hashed * _odd[k] + _add[k], cut[:-1])
    return compressed(out)


def bucket_registers(hashed: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Each hash in one bucket; empty buckets take the next one that isn't, going round."""
    n = len(cut) - 1
    owner = np.repeat(np.arange(n), np.diff(cut))
    bucket = ((hashed >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)  # rises with the hash
    cell = owner * REGISTERS + bucket
    value = mix(hashed + BASE)
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    least = np.full(n * REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    filled = np.zeros(n * REGISTERS, bool)
    least[cell[head]] = np.minimum.reduceat(value, head)
    filled[cell[head]] = True
    out, filled = compressed(least).reshape(n, REGISTERS), filled.reshape(n, REGISTERS)
    at = np.where(np.concatenate((filled, filled), axis=1), np.arange(2 * REGISTERS), 4 * REGISTERS)
    nearest = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS] % REGISTERS
    return np.take_along_axis(out, nearest, axis=1)


def band_values(registers: np.ndarray, kind: int) -> np.ndarray:
    """One 64-bit value for each band of registers that stand far from each other; its last bit is the kind."""
    r = registers.reshape(len(registers), BAND, BANDS).astype(np.uint64)
    value = r[:, 0]
    for k in range(1, BAND):
        value = value << np.uint64(16) | r[:, k]
    value = mix(value ^ mix(np.arange(BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(kind + 1)))
    return value & ~np.uint64(1) | np.uint64(kind)


def estimates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, load: float) -> np.ndarray:
    """Jaccard similarity of every a with every b from registers of one kind, less the matches expected by chance.

    ``load`` is the share of a set that one register sees.
    """
    zeros = np.arange(0, 53)
    p = []
    for size in (size_a, size_b):
        seen = np.maximum(size * load, 1)[:, None]
        p.append((1 - 0.5 ** (zeros + 1)) ** seen - np.where(zeros > 0, (1 - 0.5**zeros) ** seen, 0))
    chance = np.abs(p[0]) @ np.abs(p[1]).T / (1 << MANTISSA)
    match = (a[:, None, :] == b[None, :, :]).mean(axis=2)
    return np.maximum((match - chance) / (1 - chance), 0.0)


def row_names(key: str, text: str) -> list[Column]:
    """Two hashes ``r1, r2`` that name equal rows, whatever the key."""
    return [F.xxhash64(key, text).alias("r1"), F.hash(text, key).alias("r2")]


def set_names(hashed: np.ndarray, cut: np.ndarray) -> pa.Array:
    """An order-free 128-bit digest of every set; zeros for the empty one."""
    some = np.flatnonzero(np.diff(cut))
    digest = np.zeros((len(cut) - 1, 2), np.uint64)
    if len(some):
        digest[some, 0] = np.add.reduceat(mix(hashed ^ BASE), cut[:-1][some])
        digest[some, 1] = np.bitwise_xor.reduceat(mix(hashed + BASE), cut[:-1][some])
    return pa.Array.from_buffers(pa.binary(), len(digest), [None, pa.py_buffer((np.arange(len(cut)) * NAME).astype(np.int32)), pa.py_buffer(digest)])


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, r1, r2, n_shingles``, the set's name ``id``, its ``bands`` and the ``registers`` of either kind (or null), a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(3))
            for lo, hi, part, local in blocks(data, borders):
                hashed, cut = shingle_sets(part, local)
                size = np.diff(cut)
                bands = np.zeros((hi - lo, 2, BANDS), np.uint64)
                own_registers = [[None, None] for _ in range(hi - lo)]
                for kind, chosen, registers in ((0, np.flatnonzero(size > SMALL), bucket_registers), (1, np.flatnonzero((size > 0) & (size <= OVERLAP)), whole_registers)):
                    if len(chosen):
                        part_size = size[chosen]
                        own = np.concatenate(([0], np.cumsum(part_size)))
                        inside = np.repeat(cut[chosen] - own[:-1], part_size) + np.arange(own[-1])
                        found = registers(hashed[inside], own)
                        bands[chosen, kind] = band_values(found, kind)
                        for i, r in zip(chosen.tolist(), found, strict=True):
                            own_registers[i][kind] = r.tobytes()
                kinds = np.stack([size > SMALL, (size > 0) & (size <= OVERLAP)], axis=1)
                flat = bands.reshape(-1, BANDS)[kinds.ravel()].ravel().view(np.int64)
                count = np.concatenate(([0], np.cumsum(kinds.sum(axis=1) * BANDS))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(size), set_names(hashed, cut),
                    pa.ListArray.from_arrays(pa.array(count), pa.array(flat)), pa.array(own_registers, pa.list_(pa.binary())),
                ], ["key", "r1", "r2", "n_shingles", "id", "bands", "registers"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), *row_names(key, text), docs[text].alias("text"))
    return rows.mapInArrow(run, f"key {kind}, r1 long, r2 int, n_shingles long, id binary, bands array<long>, registers array<binary>")


def full_sets(docs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """``id, run_set`` (sorted 64-bit hashes) of the sets of the documents that ``rows`` has by ``r1, r2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(0))
            for lo, hi, part, local in blocks(data, borders):
                hashed, cut = shingle_sets(part, local)
                sets = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(hashed)])
                yield pa.RecordBatch.from_arrays([set_names(hashed, cut), sets], ["id", "run_set"])

    chosen = docs.select(*row_names(key, text), docs[text].alias("text")).join(rows, ["r1", "r2"], "left_semi")
    return chosen.select("text").mapInArrow(run, "id binary, run_set binary").dropDuplicates(["id"])


def _similar(p: np.ndarray, q: np.ndarray) -> bool:
    """The exact condition on two full sets."""
    small, large = min(len(p), len(q)), max(len(p), len(q))
    if small * LEAST[1] < large * LEAST[0]:
        return False
    both = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
    return both * LEAST[1] >= (len(p) + len(q) - both) * LEAST[0]


def true_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("run_set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("run_set").alias("set_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            keep = [i for i, (x, y) in enumerate(both) if _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))]
            chosen = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], ["a", "b"])

    return joined.mapInArrow(run, "a binary, b binary")


def near_links(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Links between different components, from groups that the first round left in several.

    Members outside a group's largest component are laid in blocks, and so are all members; every block of the
    first meets every block of the second of its group, so a large group is work for many tasks and
    no pair is ever a row. A pair is judged in the first band it shares: estimated from the
    registers, then confirmed on the full sets. Of the links from one member to one component a block
    gives one. ``members`` has ``id, registers, run_set``.
    """
    one = F.struct("id", "component", (F.col("component") == F.col("main")).alias("inner"), F.get("registers", F.col("band").bitwiseAND(1).cast("int")).alias("r"), "run_set")
    full = rows.join(members, "id").select("band", one.alias("m"))
    count = rows.groupBy("band").agg(F.count_if(F.col("component") != F.col("main")).alias("n_l"), F.count(F.lit(1)).alias("n_r"))
    full = full.join(count, "band")

    def laid(side: DataFrame, n: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("m.id"), F.ceil(F.col(n) / BLOCK))
        return side.groupBy("band", block.alias("block")).agg(F.collect_list("m").alias(name)).drop("block")  # about BLOCK members

    meeting = laid(full.where(~F.col("m.inner")), "n_l", "l").join(laid(full, "n_r", "r"), "band")

    def side(values: pa.StructArray):
        part = {k: column_bytes(values.field(k))[0].reshape(-1, NAME).view(np.uint64) for k in ("id", "component")}
        part["inner"] = np.asarray(values.field("inner"))
        data, cut, _ = column_bytes(values.field("run_set"))
        sets = [np.frombuffer(data[i:j].tobytes(), np.uint64) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return part, np.frombuffer(column_bytes(values.field("r"))[0].tobytes(), np.uint16).reshape(len(values), REGISTERS), sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band = np.int64(batch.column(0)[i].as_py()).astype(np.uint64)
                kind_of = int(band & np.uint64(1))
                (x, a, x_sets), (y, b, y_sets) = side(batch.column(1)[i].values), side(batch.column(2)[i].values)
                size_x, size_y = np.array(list(map(len, x_sets))), np.array(list(map(len, y_sets)))
                near = estimates(a, b, size_x, size_y, 1.0 if kind_of else 1 / REGISTERS) >= FAR
                both = np.concatenate((x["component"], y["component"], x["id"], y["id"]))
                rank = np.unique(both, axis=0, return_inverse=True)[1].ravel()
                of_x, of_y, at_x, at_y = np.split(rank, np.cumsum([len(a), len(b), len(a)]))
                near &= of_x[:, None] != of_y
                near &= y["inner"] | (at_x[:, None] < at_y)
                own, other = band_values(a, kind_of), band_values(b, kind_of)
                at = int(np.argmax(own[0] == band))
                p, q = np.nonzero(near)
                fresh = ~(own[p, :at] == other[q, :at]).any(axis=1)  # else an earlier band has the pair
                found = {}
                for j, k in zip(p[fresh].tolist(), q[fresh].tolist(), strict=True):
                    cell = (j, int(of_y[k]))
                    if cell not in found and _similar(x_sets[j], y_sets[k]):
                        found[cell] = k
                if found:
                    one, two = pa.array([j for j, _ in found]), pa.array(list(found.values()))
                    sides = (batch.column(n)[i].values.field("id").take(k) for n, k in ((1, one), (2, two)))
                    yield pa.RecordBatch.from_arrays(list(sides), ["a", "b"])

    return meeting.select("band", "l", "r").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept, lead, r1, r2`` for every row."""
    sketch = saved(sketches(docs, key, text), "sketches")
    first = F.struct(F.col("key").isNull().alias("unnamed"), "key", "r1", "r2")
    # of a set's rows any gives the same bands and registers
    heads = sketch.where("n_shingles > 0").groupBy("id").agg(F.min(first).alias("first"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "registers")))
    heads = saved(heads, "heads")
    groups = candidate_groups(heads.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("band")).select("band", "id", "size"))
    rows = heads.join(groups.select("id").distinct(), "id", "left_semi").select("first.r1", "first.r2")
    sets = saved(full_sets(docs, rows, key, text), "sets")
    members = sets.join(heads.select("id", "registers"), "id")
    found = saved(linked(groups, lambda pairs: true_links(pairs, sets), lambda rows: near_links(rows, members)))
    own = heads.select("id", "first").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    merged = own.select("id", "component").join(own.groupBy("component").agg(F.min("first").alias("lead")), "component").select("id", "lead")
    out = sketch.select("key", "r1", "r2", "n_shingles", "id").join(merged, "id", "left")
    alone = F.col("lead").isNull()
    here = alone | ((F.col("r1") == F.col("lead.r1")) & (F.col("r2") == F.col("lead.r2")))
    component = F.when(alone, F.col("key")).otherwise(F.col("lead.key"))
    return out.select(
        F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), here.alias("lead"), "r1", "r2",
    )
