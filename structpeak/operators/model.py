"""Low-rank denoiser fitted by distributed sums, and its batched application.

The fit learns the clean window from its contaminated copy through a bottleneck of
``latent`` numbers. Workers reduce their windows to cross-product matrices; only those
(of constant size) meet on the driver, where the small linear system is solved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY, PeakConfig
from structpeak.operators.contamination import COPIES, contaminated_copies, with_copies
from structpeak.operators.hotkeys import FEW
from structpeak.operators.ordering import radix_quantiles

SMALLEST_RESIDUAL = 1e-3
# Most tasks that each send one matrix; partitions beyond share a task.
MOST_MATRICES = 4096
# Parts in which a matrix row is summed first.
SUM_PARTS = 64
# Values a scoring task holds before it hands its partial results on.
HELD_VALUES = 4_000_000


@dataclass(frozen=True)
class Denoiser:
    """Fitted weights: ``codes = [features, 1] @ encode`` and ``window = codes @ decode``.

    ``center`` and ``width`` are the pool median and interquartile range of every code;
    ``kappa`` limits codes to ``center +- kappa * width`` (infinite: no limit).
    """

    config: PeakConfig
    encode: np.ndarray
    decode: np.ndarray
    version: str = "unversioned"
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    width: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kappa: float = float("inf")

    def check_measure(self, measure: str) -> None:
        """Refuse to score a measure the model was not fitted on."""
        if measure != self.config.measure:
            raise ValueError(f"model was fitted on {self.config.measure!r}, not {measure!r}")


def block_mean_denoiser(config: PeakConfig, blocks: int, version: str = "block-mean", shares: dict[str, float] | None = None) -> Denoiser:
    """Fixed weights: codes are block means of the channels times their ``shares``, the window repeats them. Needs no fit."""
    step = config.length // blocks
    decode = np.kron(np.eye(blocks), np.ones((1, step)))
    encode = np.zeros((config.length * len(config.channels) + 1, blocks))
    for name, share in (shares or {"value": 1.0}).items():
        place = config.channels.index(name) * config.length
        encode[place : place + config.length] = share * decode.T / step
    return Denoiser(config, encode, decode, version, np.zeros(blocks), np.ones(blocks))


def stacked(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy())


def feature_matrix(
    values: np.ndarray, level: np.ndarray | None, delta: np.ndarray | None, names: Sequence[str], width: int
) -> np.ndarray:
    """Chosen channels of a batch of windows, laid side by side (rows are windows)."""
    blank = np.zeros_like(values)
    parts = []
    for name in names:
        if name == "value":
            parts.append(values)
        elif name == "derivative":
            parts.append(np.gradient(values, axis=1))
        elif name == "spread":
            half = width // 2
            near = np.lib.stride_tricks.sliding_window_view(np.pad(values, ((0, 0), (half, half)), mode="edge"), width, axis=1)
            variance = (near * near).mean(axis=2) - near.mean(axis=2) ** 2
            parts.append(np.sqrt(np.maximum(variance, 0.0))[:, : values.shape[1]])
        elif name in ("level", "level_delta"):
            found = level if name == "level" else delta
            parts.append(blank if found is None else found)
        else:
            raise ValueError(f"unknown channel {name!r}")
    return np.hstack(parts)


def uses_registry(config: PeakConfig) -> bool:
    return bool({"level", "level_delta"} & set(config.channels))


def encoder(model: Denoiser):
    """Column function: value arrays (and registry arrays, where used) to code arrays."""
    weights, bias = model.encode[:-1], model.encode[-1]
    names, width = model.config.channels, model.config.spread_width

    length = model.config.length

    def coded(*columns: pa.Array) -> pa.Array:
        if not len(columns[0]):
            return matrix_list(np.zeros((0, len(bias))))
        values, level, delta = [list_matrix(c, length) for c in columns] + [None] * (3 - len(columns))
        return matrix_list(feature_matrix(values, level, delta, names, width) @ weights + bias)

    @F.arrow_udf("array<double>")
    def of_values(values: pa.Array) -> pa.Array:
        return coded(values)

    @F.arrow_udf("array<double>")
    def of_all(values: pa.Array, level: pa.Array, delta: pa.Array) -> pa.Array:
        return coded(values, level, delta)

    return of_all if uses_registry(model.config) else of_values


def model_inputs(windows: DataFrame, config: PeakConfig, values: str = "values") -> list[Column]:
    """Array columns the encoder needs; registry arrays that were never aligned read as zero."""
    if not uses_registry(config):
        return [F.col(values)]
    blank = F.array_repeat(F.lit(0.0), config.length)
    return [F.col(values), *[F.col(c) if c in windows.columns else blank for c in ("level", "level_delta")]]


def decoder(model: Denoiser):
    """Column function: code arrays to windows."""
    weights = model.decode

    @F.arrow_udf("array<double>")
    def windows(codes: pa.Array) -> pa.Array:
        return matrix_list(list_matrix(codes, len(weights)) @ weights)

    return windows


def limit_codes(codes: Column, model: Denoiser, kappa: Column | float) -> Column:
    """Clip every code to its pool median plus or minus ``kappa`` interquartile ranges."""
    if isinstance(kappa, float):
        if np.isinf(kappa):
            return codes
        kappa = F.lit(kappa)
    bounds = F.array(*[
        F.struct(F.lit(float(c)).alias("c"), F.lit(float(w)).alias("w"))
        for c, w in zip(model.center, model.width, strict=True)
    ])

    def clip(code: Column, b: Column) -> Column:
        return F.least(F.greatest(code, b["c"] - kappa * b["w"]), b["c"] + kappa * b["w"])

    clipped = F.zip_with(codes, bounds, clip)
    return F.when(kappa == float("inf"), codes).otherwise(clipped)


def window_codes(windows: DataFrame, model: Denoiser, values: str = "values") -> DataFrame:
    """Add the bottleneck ``codes`` of every window."""
    return windows.withColumn("codes", encoder(model)(*model_inputs(windows, model.config, values)))


def reconstruct(windows: DataFrame, model: Denoiser, values: str = "values", out: str = "structural") -> DataFrame:
    """Add the structural window (scaled units) the model sees in every window."""
    coded = window_codes(windows, model, values)
    limited = limit_codes(F.col("codes"), model, model.kappa)
    return coded.withColumn(out, decoder(model)(limited)).drop("codes")


def _cross_products(coefficients: np.ndarray | None, config: PeakConfig):
    """Partition function: weighted cross products of features and targets, row by row."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if batch.empty:
                continue
            registry = [stacked(batch[c]) if c in batch else None for c in ("level", "level_delta")]
            x = feature_matrix(stacked(batch["input"]), *registry, config.channels, config.spread_width)
            x = np.hstack([x, np.ones((len(x), 1))])
            y = stacked(batch["target"])
            if coefficients is None:
                w = np.ones(len(x))
            else:
                w = 1.0 / np.maximum(np.abs(y - x @ coefficients).mean(axis=1), SMALLEST_RESIDUAL)
            xw = x * w[:, None]
            part = np.hstack([xw.T @ x, xw.T @ y, np.full((x.shape[1], 1), w.sum())])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"row": np.arange(len(total)), "part": TaskContext.get().partitionId() % SUM_PARTS, "sums": list(total)})

    return sums


def cross_products(examples: DataFrame, config: PeakConfig, coefficients: np.ndarray | None = None) -> DataFrame:
    """``row, sums``: the weighted sums of a feature times every feature, times every target, and of the weights.

    Each task reduces its windows to one matrix, and there are at most ``MOST_MATRICES`` tasks. The
    matrices are summed in two levels, by (row, part) and by row, so no task adds up more than a part of them.
    """
    parts = examples.drop("window_id", "replica").coalesce(MOST_MATRICES).mapInPandas(
        _cross_products(coefficients, config), "row int, part int, sums array<double>"
    )
    summed = Summarizer.sum(array_to_vector("sums"))
    first = parts.groupBy("row", "part").agg(summed.alias("v")).select("row", "part", vector_to_array("v").alias("sums"))
    return first.groupBy("row").agg(summed.alias("v")).select("row", vector_to_array("v").alias("sums"))


def summed_products(examples: DataFrame, coefficients: np.ndarray | None, config: PeakConfig) -> np.ndarray:
    """The cross products as a matrix on the driver, one row a feature."""
    rows = cross_products(examples, config, coefficients).collect()  # one row per feature
    if not rows:
        raise ValueError("no training windows: every series is shorter than one window")
    return np.array([r["sums"] for r in sorted(rows, key=lambda r: r["row"])])


def _normal_equations(sums: np.ndarray, length: int, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    p = sums.shape[0]
    gram, cross, weight = sums[:, :p], sums[:, p : p + length], sums[0, -1]
    penalty = np.eye(p) * ridge * weight
    penalty[-1, -1] = 0.0  # the intercept is free
    return gram + penalty, cross


def solve_products(sums: np.ndarray, length: int, ridge: float) -> np.ndarray:
    return np.linalg.solve(*_normal_equations(sums, length, ridge))


def fit_residual(sums: np.ndarray, coefficients: np.ndarray, length: int, ridge: float) -> np.ndarray:
    """What is left of the penalised normal equations under ``coefficients``, relative to their right side: zero at the optimum."""
    left, right = _normal_equations(sums, length, ridge)
    return (left @ coefficients - right) / np.maximum(np.abs(right).max(axis=0), 1.0)


def _cut_rank(coefficients: np.ndarray, sums: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Best rank-limited form of the map: leading directions of the fitted windows."""
    p = sums.shape[0]
    fitted = coefficients.T @ sums[:, :p] @ coefficients
    _, vectors = np.linalg.eigh((fitted + fitted.T) / 2)
    lead = vectors[:, ::-1][:, : min(rank, vectors.shape[1])]
    lead = lead * np.where(np.abs(lead).max(axis=0) == lead.max(axis=0), 1.0, -1.0)  # fixed signs
    return coefficients @ lead, lead.T


def training_examples(windows: DataFrame, config: PeakConfig, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Contaminated copies (``input``) beside the clean window they should give (``target``)."""
    copies = contaminated_copies(windows, config, keys)
    registry = ["level", "level_delta"] if uses_registry(config) and "level" in windows.columns else []
    return copies.select("window_id", "replica", F.col("contaminated").alias("input"), F.col("values").alias("target"), *registry)


def fit_denoiser(
    windows: DataFrame,
    config: PeakConfig,
    keys: Sequence[str] = SERIES_KEY,
    version: str = "unversioned",
) -> Denoiser:
    """Fit the denoiser on all scaled windows given.

    Rounds of row re-weighting by inverse mean absolute residual stand in for an absolute loss.
    The windows are kept between rounds, each once with its contaminated copies beside it, so their draws are made
    once; a caller with several fits may keep what ``with_copies`` gives and pass that. Every round reduces each task to one matrix. A lost executor only recomputes its part.
    """
    registry = [c for c in ("level", "level_delta") if c in windows.columns]
    drawn = COPIES in windows.columns  # then the caller keeps them
    kept = windows if drawn else with_copies(windows.select(*keys, "window_id", "values", *registry), config, keys)
    kept = kept.select("window_id", "values", *registry, COPIES)
    if not drawn:
        kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        examples = training_examples(kept, config, keys)
        coefficients = None
        for _ in range(1 + config.reweight_rounds):
            sums = summed_products(examples, coefficients, config)
            coefficients = solve_products(sums, config.length, config.ridge)
        encode, decode = _cut_rank(coefficients, sums, config.latent)
        bare = Denoiser(config, encode, decode, version)
        codes = window_codes(examples, bare, "input").select("codes").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            center, width = code_statistics(codes.select(F.posexplode_outer("codes").alias("component", "code")))
        finally:
            codes.unpersist()
    finally:
        if not drawn:
            kept.unpersist()
    return Denoiser(config, encode, decode, version, center, width)


def code_statistics(codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Exact median and interquartile range of every code over the pool (one row per component)."""
    names = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    rows = radix_quantiles(codes, ["component"], "code", names, FEW).orderBy("component").collect()
    table = np.array([[r[n] for n in names] for r in rows])
    return table[:, 1], table[:, 2] - table[:, 0]


def list_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def matrix_list(rows: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as a list column."""
    cut = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.ascontiguousarray(rows).ravel()))


def batch_codes(batch: pa.RecordBatch, model: Denoiser, values: str = "values") -> np.ndarray:
    """Codes of an Arrow batch of windows."""
    registry = [list_matrix(batch.column(c), model.config.length) if c in batch.schema.names else None for c in ("level", "level_delta")]
    x = feature_matrix(list_matrix(batch.column(values), model.config.length), *registry, model.config.channels, model.config.spread_width)
    return x @ model.encode[:-1] + model.encode[-1]


def limited(codes: np.ndarray, model: Denoiser, kappa: float) -> np.ndarray:
    if np.isinf(kappa):
        return codes
    return np.clip(codes, model.center - kappa * model.width, model.center + kappa * model.width)


def _top_points(model: Denoiser, quantile: float, keys: Sequence[str]):
    """Task function: the largest structural points of each series, as many as its quantile can ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, list] = {}
        held, names, types = 0, None, None

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in state], t) for i, t in enumerate(types)]
            tops = [v[1] for v in state.values()]
            cut = pa.array(np.concatenate(([0], np.cumsum([len(t) for t in tops]))).astype(np.int32))
            flat = pa.array(np.concatenate(tops) if tops else np.zeros(0))
            return pa.RecordBatch.from_arrays([*columns, pa.array([v[0] for v in state.values()], pa.int64()), pa.ListArray.from_arrays(cut, flat)], [*names, "n", "top"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, types = list(keys), [batch.column(k).type for k in keys]
            seen = limited(batch_codes(batch, model), model, model.kappa) @ model.decode
            points = seen * batch.column("scale").to_numpy()[:, None] + batch.column("median").to_numpy()[:, None]
            size = batch.column("n_windows").to_numpy() * model.config.length
            most = size - np.floor(quantile * (size - 1)).astype(np.int64)
            rows: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in keys], strict=True)):
                rows.setdefault(k, []).append(i)
            for k, at in rows.items():
                own = points[at].ravel()
                own = own[np.isfinite(own)]
                n, top = state.get(k, (0, np.zeros(0)))
                held -= len(top)
                merged, keep = np.concatenate((top, own)), int(most[at[0]])
                if len(merged) > keep:
                    merged = np.partition(merged, len(merged) - keep)[len(merged) - keep :]
                state[k] = (n + len(own), merged)
                held += len(merged)
            if held > HELD_VALUES:
                yield out()
                state.clear()
                held = 0
        if state:
            yield out()

    return run


def structural_quantile(windows: DataFrame, model: Denoiser, quantile: float, keys: Sequence[str] = SERIES_KEY, out: str = "peak") -> DataFrame:
    """High quantile of the structural points of every series, in measured units; NULL when no point is finite.

    One pass over the windows, in Python, turns them into the points; a task keeps of each series only as
    many of the largest as the quantile's rank can reach, counted from the top. Those few move, the points don't.
    ``windows`` needs ``n_windows`` (of the series), ``median``, ``scale``, ``values`` and the registry arrays the model uses.
    """
    keys = list(keys)
    inputs = [c.alias(n) for c, n in zip(model_inputs(windows, model.config), ("values", "level", "level_delta"), strict=False)]
    schema = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys) + ", n long, top array<double>"
    tops = windows.select(*keys, "median", "scale", "n_windows", *inputs).mapInArrow(_top_points(model, quantile, keys), schema)
    merged = tops.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sort_array(F.flatten(F.collect_list("top")), asc=False).alias("_top"))
    place = F.lit(float(quantile)) * (F.col("_n") - 1)
    low, high = (F.get("_top", (F.col("_n") - 1 - f(place)).cast("int")) for f in (F.floor, F.ceil))
    return merged.select(*keys, F.when(F.col("_n") > 0, low + (high - low) * (place - F.floor(place))).alias(out))
