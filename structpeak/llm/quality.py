"""Quality classifier: naive Bayes support vectors.

A text shows indicators of n-grams: its words, pairs of neighbouring words, and the first and last three
bytes of words; a word equal to the one before it stands as a repeat sign. Indicators are hashed
into a table of fixed size. Log-count ratios of the two classes come from all labelled rows, in
one distributed count. Indicators scaled by these ratios, each text's brought to unit length, are the inputs of a linear
hinge-loss model, fitted by dual coordinate descent on a bounded sample; a logistic curve
over margins of sample rows outside the fit turns margins into probabilities.

Null and empty texts show no indicator and get the score of the intercept. Repeated rows are each
scored. With labelled rows of one class only, every text gets that class's score (1 or 0); with
none, 0.5. Labels, language, source and key are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.llm.storage import saved
from structpeak.llm.textbuf import blocks, column_bytes, mix, prefix_hash, runs_of, span_hash, words

BITS = 18
#: Labelled rows of each class for the fit, the ones of smallest hash; every fourth of them only calibrates.
FIT_ROWS = 1500
REPEAT = np.uint64(0x52455045)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def indicators(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indicators of each document: sorted documents and their table slots."""
    start, end, document = words(data, borders)
    prefix = prefix_hash(data)
    word = mix(span_hash(prefix, start, end))
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (document[1:] == document[:-1])
    token = np.where(same, REPEAT, word)
    pair = np.flatnonzero(document[1:] == document[:-1])
    parts, owner = [mix(token + np.uint64(1)), mix(token[pair] * np.uint64(31) + token[pair + 1] + np.uint64(2))], [document, document[pair]]
    kinds = np.unique(mix(word ^ mix(document.astype(np.uint64))), return_index=True)[1]  # each word once a document
    for kind, lo, hi in ((3, start[kinds], np.minimum(start[kinds] + 3, end[kinds])), (4, np.maximum(end[kinds] - 3, start[kinds]), end[kinds])):
        parts.append(mix(span_hash(prefix, lo, hi) * np.uint64(31) + (hi - lo).astype(np.uint64) + np.uint64(kind << 8)))
        owner.append(document[kinds])
    slot = np.concatenate(parts) & np.uint64((1 << BITS) - 1)
    cell = np.unique(np.concatenate(owner).astype(np.uint64) << np.uint64(BITS) | slot)
    return (cell >> np.uint64(BITS)).astype(np.int64), (cell & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that show each indicator, for one task."""
    count = np.zeros((2, 1 << BITS), np.int64)
    seen = np.zeros(2, np.int64)
    for batch in batches:
        data, borders, _ = column_bytes(batch.column(0))
        label = np.asarray(batch.column(1))
        for lo, hi, part, local in blocks(data, borders):
            document, slot = indicators(part, local)
            own = label[lo:hi]
            for c in (0, 1):
                count[c] += np.bincount(slot[own[document] == c], minlength=1 << BITS)
                seen[c] += np.count_nonzero(own == c)
    some = np.flatnonzero(count.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[0][some], seen[0])), pa.array(np.append(count[1][some], seen[1]))], ["slot", "zero", "one"])


def margins(document: np.ndarray, slot: np.ndarray, n: int, ratio: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sums over each document's ratio-scaled indicators, brought to unit length."""
    length = np.sqrt(np.bincount(document, ratio[slot] ** 2, n))
    return np.bincount(document, ratio[slot] * weight[slot], n) / np.maximum(length, 1e-9)


def descend(index: np.ndarray, ptr: np.ndarray, sign: np.ndarray, ratio: np.ndarray, cost: float, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared-norm, hinge-loss model over ratio-scaled indicators; the last weight is the bias."""
    rows = [index[ptr[i]:ptr[i + 1]] for i in range(len(sign))]
    value = [ratio[r] / max(np.linalg.norm(ratio[r]), 1e-9) for r in rows]
    norm = np.array([v @ v + 1.0 for v in value])
    weight, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(sign))
    share = {c: len(sign) / (2.0 * max(np.count_nonzero(sign == c), 1)) for c in (-1, 1)}
    upper = np.array([cost * share[int(c)] for c in sign])  # both classes weigh the same
    order = np.random.default_rng(11)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(sign)):
            slope = sign[i] * (weight[rows[i]] @ value[i] + bias) - 1.0
            new = min(max(dual[i] - slope / norm[i], 0.0), upper[i])
            step = (new - dual[i]) * sign[i]
            if step:
                dual[i] = new
                weight[rows[i]] += step * value[i]
                bias += step
                moved = max(moved, abs(step) * norm[i])
        if moved < 1e-3:
            break
    return weight, bias


def logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of largest weighted likelihood, by damped Newton steps on softened targets."""
    ones, zeros = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    at = np.array([1.0, np.log((ones + 1) / (zeros + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (target - p)) - 1e-6 * at)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(at[0]), 0.0), float(at[1])


def train(labelled: DataFrame, text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, cost: float = 1.0) -> Model:
    """Counts over all of ``labelled``, which is stored once; the fit takes at most ``fit_rows`` rows of each class."""
    rows = saved(labelled.where(F.col(label).isin(0, 1)).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")), "labelled")
    counts = rows.mapInArrow(_count, "slot long, zero long, one long").groupBy("slot").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"))
    counted = counts.toPandas()  # at most 2**BITS + 1 rows
    head = counted["slot"] == -1
    seen = counted.loc[head, ["zero", "one"]].sum().to_numpy(float)
    if not seen.all():
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, float(np.sign(seen[1] - seen[0])) * 30.0)
    shown = np.zeros((2, 1 << BITS))
    shown[:, counted.loc[~head, "slot"]] = counted.loc[~head, ["zero", "one"]].to_numpy(float).T
    share = (shown + 2 * seen[:, None] / seen.sum()) / seen[:, None]  # what was never seen speaks for no class
    ratio = np.log(share[1] / share[0])
    keyed = rows.select("label", F.struct(F.xxhash64("text").alias("at"), "text").alias("row"))
    cells = keyed.groupBy("label", F.pmod(F.col("row.at"), F.lit(fit_rows)).alias("cell")).agg(F.min("row").alias("row"))
    sample = cells.orderBy("label", "cell").collect()  # at most 2 * fit_rows rows
    texts = [r["row"]["text"].encode() for r in sample]
    borders = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    owner, slots = [], []
    for lo, _, part, local in blocks(np.frombuffer(b"".join(texts), np.uint8), borders):
        d, s = indicators(part, local)
        owner.append(d + lo)
        slots.append(s)
    owner, slots = np.concatenate(owner), np.concatenate(slots)
    ptr = runs_of(owner, len(sample))
    value = np.array([r["label"] for r in sample], np.int64)
    fitted = np.arange(len(sample)) % 4 != 0
    if len(set(value[fitted].tolist())) < 2 or len(set(value[~fitted].tolist())) < 2:
        fitted[:] = True
    chosen = np.flatnonzero(fitted)
    size = np.diff(ptr)[chosen]
    flat = slots[np.repeat(fitted, np.diff(ptr))]
    weight, bias = descend(flat, np.concatenate(([0], np.cumsum(size))), 2 * value[chosen] - 1, ratio, cost)
    margin = margins(owner, slots, len(sample), ratio, weight) + bias
    held = ~fitted if not fitted.all() else fitted
    # the curve sees the classes as often as they are labelled
    often = np.array([seen[c] / max(np.count_nonzero(value[held] == c), 1) for c in (0, 1)])
    slope, shift = logistic(margin[held], value[held], often[value[held]] / often.max())
    return Model(ratio, weight, slope, shift + slope * bias)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders, _ = column_bytes(batch.column(1))
            for lo, hi, part, local in blocks(data, borders):
                document, slot = indicators(part, local)
                margin = margins(document, slot, hi - lo, model.ratio, model.weight)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(model.score(margin))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)
