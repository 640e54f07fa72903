"""Published h0 results and the label log to h1: calibration, its evaluation, final values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structpeak.config import RESULT_KEY
from structpeak.operators.evaluate import error_metrics, gated_metrics, out_of_fold
from structpeak.operators.hotkeys import TASK_ROWS, small_enough
from structpeak.operators.labels import calibrated, calibration_line, latest_per_key, production_override, with_labels

FOLDS = 5
SEED = 42


def paired_results(results: DataFrame, label_log: DataFrame) -> DataFrame:
    """Results with the latest label of their key (``label``)."""
    return with_labels(results, latest_per_key(label_log, RESULT_KEY, "label", "labelled_at"))


def usable_pairs(base: DataFrame) -> DataFrame:
    return base.dropna(subset=["peak_h0", "label"])


def evaluate_calibration(base: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Grouped out-of-fold metrics, overall and by region, gated on ten pairs."""
    pairs = usable_pairs(base)
    predictions = out_of_fold(pairs, "peak_h0", "label", folds, seed)
    spread = not small_enough(pairs, TASK_ROWS)
    return gated_metrics(pairs, error_metrics(predictions, "predicted", "label", ["region"], spread))


def calibrated_h1(base: DataFrame) -> DataFrame:
    """Staging rows of h1: the label where there is one, else the calibrated h0."""
    line = calibration_line(usable_pairs(base), "peak_h0", "label")
    with_line = calibrated(base, line, "peak_h0", "_estimate")
    return production_override(with_line, "label", "_estimate", "peak_h1").select(*RESULT_KEY, F.col("peak_h1"))
