"""Statistical comparisons of error tables: intervals, rank tests, agreement, learning curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structpeak.functions.draws import key_seed, uniform
from structpeak.operators.labels import line_columns
from structpeak.operators.ordering import cumulative_histogram
from structpeak.operators.sampling import nested_chains

# Normal quantiles of one-sided 95 % and two-sided 95 % intervals.
Z_90_TWO_SIDED = 1.6448536269514722
Z_95_TWO_SIDED = 1.959963984540054
# Coefficients of a published rational approximation of the normal tail (error below 7.5e-8).
TAIL_P = 0.2316419
TAIL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327
# Cumulative probabilities of a Poisson(1) count of 0..7.
POISSON_1 = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
)

# Coefficients of a published rational approximation of the normal quantile (relative error below 1.2e-9).
QUANTILE_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
QUANTILE_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
QUANTILE_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
QUANTILE_TAIL = 0.02425
EXACT_PAIRS = 25  # most pairs whose signed ranks are enumerated


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(TAIL_P) * z)
    poly = F.lit(0.0)
    for b in reversed(TAIL_B):
        poly = (poly + F.lit(b)) * t
    return F.lit(INV_SQRT_2PI) * F.exp(-z * z / 2) * poly


def normal_share(z: Column) -> Column:
    """P(Z <= z)."""
    return F.when(z >= 0, 1 - upper_tail(z)).otherwise(upper_tail(-z))


def normal_quantile(p: Column) -> Column:
    """The z with P(Z <= z) = p, for p between 0 and 1."""

    def poly(coefficients: Sequence[float], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    def tail(share: Column) -> Column:
        x = F.sqrt(F.lit(-2.0) * F.log(share))
        return poly(QUANTILE_C, x) / poly((*QUANTILE_D, 1.0), x)

    middle = p - F.lit(0.5)
    square = middle * middle
    inner = poly(QUANTILE_A, square) * middle / poly((*QUANTILE_B, 1.0), square)
    return F.when(p < QUANTILE_TAIL, tail(p)).when(p > 1 - QUANTILE_TAIL, -tail(1 - p)).otherwise(inner)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inversion of a uniform draw."""
    out = F.lit(len(POISSON_1))
    for k in range(len(POISSON_1) - 1, -1, -1):
        out = F.when(u <= POISSON_1[k], F.lit(k)).otherwise(out)
    return out


def _draw_estimates(per_entity: DataFrame, entity: str, draws: int, seed: int, by: Sequence[str]) -> DataFrame:
    drawn = per_entity.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    weight = poisson_one(uniform(key_seed(F.lit(str(seed)), F.col("draw"), F.col(entity)), 1))
    sums = drawn.withColumn("_w", weight).groupBy(*by, "draw").agg(
        F.sum(F.col("_w") * F.col("_num")).alias("_num"), F.sum(F.col("_w") * F.col("_den")).alias("_den")
    )
    return sums.where(F.col("_den") > 0).withColumn("_est", F.col("_num") / F.col("_den"))


def cluster_bootstrap(
    df: DataFrame, numerator: str, denominator: str, entity: str, draws: int, seed: int, by: Sequence[str] = (),
    low: float = 0.025, high: float = 0.975,
) -> DataFrame:
    """Percentile interval of ``sum(numerator) / sum(denominator)`` resampling whole entities.

    Rows are first summed per entity; each draw weights the entity with a Poisson(1) count,
    so only ``draws`` partial sums leave a task.
    """
    per_entity = df.groupBy(*by, entity).agg(F.sum(numerator).alias("_num"), F.sum(denominator).alias("_den"))
    return _draw_estimates(per_entity, entity, draws, seed, by).groupBy(*by).agg(
        F.percentile("_est", low).alias("lower"), F.percentile("_est", 0.5).alias("middle"),
        F.percentile("_est", high).alias("upper"), F.count("*").alias("draws"),
    )


def accelerated_interval(
    df: DataFrame, numerator: str, denominator: str, entity: str, draws: int, seed: int, by: Sequence[str] = (), z: float = Z_95_TWO_SIDED
) -> DataFrame:
    """Bias-corrected accelerated interval of ``sum(numerator) / sum(denominator)`` over whole entities.

    The draws are those of ``cluster_bootstrap``. The bias comes from the share of draws below the estimate, the
    acceleration from the estimates without one entity each, which are the totals less that entity's own sums. NULL group values are groups.
    """
    by = list(by)
    per_entity = df.groupBy(*by, entity).agg(F.sum(numerator).alias("_num"), F.sum(denominator).alias("_den"))
    group = F.struct(F.lit(0).alias("_all"), *by).alias("_g")
    totals = per_entity.groupBy(group).agg(F.sum("_num").alias("_n"), F.sum("_den").alias("_d")).where("_d > 0").withColumn("estimate", F.col("_n") / F.col("_d"))
    left = (F.col("_n") - F.col("_num")) / F.nullif(F.col("_d") - F.col("_den"), F.lit(0))
    moved = per_entity.withColumn("_g", group).join(totals, "_g").withColumn("_u", left - F.col("estimate"))
    u = F.col("_u")
    parts = moved.groupBy("_g").agg(F.count("_u").alias("_k"), F.avg("_u").alias("_m"), F.sum(u * u).alias("_s2"), F.sum(u * u * u).alias("_s3"))
    k, m = F.col("_k"), F.col("_m")
    second = F.col("_s2") - k * m * m
    third = -(F.col("_s3") - 3 * m * F.col("_s2") + 2 * k * m * m * m)
    bend = parts.select("_g", F.coalesce(F.when(second > 0, third / (6 * F.pow(second, F.lit(1.5)))), F.lit(0.0)).alias("acceleration"))
    estimates = _draw_estimates(per_entity, entity, draws, seed, by).withColumn("_g", group).join(totals.select("_g", "estimate"), "_g")
    below = F.avg(F.when(F.col("_est") < F.col("estimate"), 1.0).when(F.col("_est") == F.col("estimate"), 0.5).otherwise(0.0))
    drawn = estimates.groupBy("_g").agg(F.first("estimate").alias("estimate"), below.alias("_below"), F.sort_array(F.collect_list("_est")).alias("_sorted"))  # `draws` numbers
    n = F.size("_sorted")
    bias = normal_quantile(F.least(F.greatest(F.col("_below"), 0.5 / n), 1 - 0.5 / n))
    out = drawn.join(bend, "_g").withColumn("bias", bias)

    def at(side: float) -> Column:
        shifted = F.col("bias") + F.lit(side)
        share = normal_share(F.col("bias") + shifted / (1 - F.col("acceleration") * shifted))
        place = share * (n - 1)
        low, high = F.get("_sorted", F.floor(place).cast("int")), F.get("_sorted", F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return out.select(*[F.col("_g")[c].alias(c) for c in by], "estimate", "bias", "acceleration", at(-z).alias("lower"), at(z).alias("upper"), n.cast("bigint").alias("draws"))


def success_test(interval: DataFrame, floor: float) -> DataFrame:
    """Whether the lower bound lies above the preset floor."""
    return interval.withColumn("passed", F.col("lower") > floor)


def equivalence(differences: DataFrame, value: str, level: str, margin: float) -> DataFrame:
    """Two one-sided tests per level: the 90 % interval of the mean difference inside the margin."""
    stats = differences.groupBy(level).agg(
        F.avg(value).alias("mean_diff"), F.stddev_samp(value).alias("sd_diff"), F.count(value).alias("n")
    )
    reach = F.lit(Z_90_TWO_SIDED) * F.col("sd_diff") / F.sqrt("n")
    bounded = stats.withColumn("lower", F.col("mean_diff") - reach).withColumn("upper", F.col("mean_diff") + reach)
    inside = (F.col("lower") > -margin) & (F.col("upper") < margin)
    return bounded.withColumn("equivalent", F.coalesce(inside, F.lit(False)))


def smallest_equivalent(tests: DataFrame, level: str) -> DataFrame:
    return tests.agg(F.min(F.when(F.col("equivalent"), F.col(level))).alias("smallest_level"))


def signed_rank(differences: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Paired signed-rank test with average ranks, tie correction and normal approximation."""
    by = list(by)
    used = differences.where(F.col(value) != 0).withColumn("_abs", F.abs(value))
    ranks = cumulative_histogram(used, by, "_abs")
    positive = used.where(F.col(value) > 0).groupBy(*by, "_abs").agg(F.count("*").alias("_plus"))
    side = positive.select(*[F.col(c).alias(f"_p_{c}") for c in [*by, "_abs"]], "_plus")
    match = F.lit(True)
    for c in [*by, "_abs"]:
        match = match & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    t = F.col("rows").cast("double")
    summed = ranks.join(side, match, "left").groupBy(*by).agg(
        F.sum(F.coalesce("_plus", F.lit(0)) * (F.col("below") + (F.col("rows") + 1) / 2)).alias("w_plus"),
        F.max("total").alias("n"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    z = (F.col("w_plus") - n * (n + 1) / 4) / sd
    return summed.withColumn("z", F.when(sd > 0, z)).withColumn(
        "p_value", F.least(F.lit(1.0), 2 * upper_tail(F.abs("z")))
    ).drop("_ties")


def exact_signed_rank(differences: DataFrame, value: str, by: Sequence[str] = (), most: int = EXACT_PAIRS) -> DataFrame:
    """Paired signed-rank test of small sets by the exact null distribution; ``p_value`` is NULL beyond ``most`` pairs.

    Zero differences are left out, ties take average ranks. The distribution counts the subsets of the ranks by their sum: an array fold
    over at most ``most`` ranks. Larger sets are counted, not collected; :func:`signed_rank` has their normal approximation.
    """
    by = list(by)
    used = differences.where(F.col(value) != 0).select(F.struct(F.lit(0).alias("_all"), *by).alias("_g"), F.col(value).alias("_d"))
    sizes = used.groupBy("_g").agg(F.count("*").alias("n"))
    small = used.join(sizes.where(F.col("n") <= most).select("_g"), "_g")
    size = F.abs("_d")
    inside, same = Window.partitionBy("_g").orderBy(size), Window.partitionBy("_g", size)
    ranked = small.withColumn("_twice", (2 * F.rank().over(inside) + F.count("*").over(same) - 1).cast("int"))  # doubled, so that average ranks are whole
    sets = ranked.groupBy("_g").agg(
        F.sort_array(F.collect_list("_twice")).alias("_ranks"), F.sum(F.when(F.col("_d") > 0, F.col("_twice")).otherwise(0)).cast("int").alias("_plus"), F.sum("_twice").cast("int").alias("_all")
    )

    def add(counts: Column, rank: Column) -> Column:
        return F.transform(counts, lambda c, i: c + F.when(i >= rank, F.get(counts, i - rank)).otherwise(F.lit(0.0)))

    empty = F.transform(F.sequence(F.lit(0), F.col("_all")), lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    counted = sets.withColumn("_counts", F.aggregate("_ranks", empty, add))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    lower = total(F.slice("_counts", F.lit(1), F.col("_plus") + 1))
    upper = total(F.slice("_counts", F.col("_plus") + 1, F.size("_counts")))
    p = F.least(F.lit(1.0), 2 * F.least(lower, upper) / F.pow(F.lit(2.0), F.size("_ranks")))
    found = counted.select("_g", (F.col("_plus") / 2).alias("w_plus"), p.alias("p_value"))
    return sizes.join(found, "_g", "left").select(*[F.col("_g")[c].alias(c) for c in by], "n", "w_plus", "p_value")


def adjacent_differences(runs: DataFrame, level: str, repetition: str, error: str) -> DataFrame:
    """For each repetition, the error at a level less that at the next smaller one (``smaller``, ``diff``)."""
    order = Window.partitionBy(repetition).orderBy(level)  # one row a level of the grid
    return runs.withColumn("smaller", F.lag(level).over(order)).withColumn("diff", F.col(error) - F.lag(error).over(order)).where(F.col("smaller").isNotNull())


def cliffs_delta(df: DataFrame, value: str, is_first: Column, by: Sequence[str] = ()) -> DataFrame:
    """Dominance of the first sample over the second, from average ranks of both together."""
    by = list(by)
    marked = df.withColumn("_first", is_first.cast("int"))
    ranks = cumulative_histogram(marked, by, value)
    side = marked.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum("_first").alias("_nx"))
    side = side.select(*[F.col(c).alias(f"_p_{c}") for c in [*by, value]], "_nx")
    match = F.lit(True)
    for c in [*by, value]:
        match = match & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    summed = ranks.join(side, match, "left").groupBy(*by).agg(
        F.sum(F.col("_nx") * (F.col("below") + (F.col("rows") + 1) / 2)).alias("_rank_sum"),
        F.sum("_nx").alias("n_first"),
        F.max("total").alias("_n"),
    )
    nx = F.col("n_first").cast("double")
    ny = F.col("_n") - nx
    u = F.col("_rank_sum") - nx * (nx + 1) / 2
    return summed.select(*by, "n_first", ny.cast("bigint").alias("n_second"),
                         F.when((nx > 0) & (ny > 0), 2 * u / (nx * ny) - 1).alias("delta"))


def holm(tests: DataFrame, p_value: str = "p_value", family: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values inside each family of tests (one row per comparison)."""
    tests = tests.withColumn("_family", F.concat_ws("|", F.lit(""), *family))
    order = Window.partitionBy("_family").orderBy(p_value, *tie)
    m = F.count("*").over(Window.partitionBy("_family"))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p_value))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_step", step).withColumn("adjusted_p", F.max("_step").over(running)).drop("_step", "_family")


def average_ranks(scores: DataFrame, dataset: str, method: str, score: str) -> DataFrame:
    """Mean rank of each method over the data sets (lower score is better, ties averaged)."""
    inside = Window.partitionBy(dataset).orderBy(score)
    same = Window.partitionBy(dataset, score)
    rank = F.rank().over(inside) + (F.count("*").over(same) - 1) / 2
    return scores.withColumn("_rank", rank).groupBy(method).agg(
        F.avg("_rank").alias("mean_rank"), F.count("*").alias("n_sets")
    )


def pair_deviation(opinions: DataFrame, keys: Sequence[str], annotator: str, value: str) -> DataFrame:
    """Every pair of annotators of a key: who they are, both values and their absolute difference.

    A key has as many opinions as annotators were asked for it, two or three; one opinion makes no pair.
    """
    told = F.array_sort(F.collect_list(F.struct(F.col(annotator).alias("who"), F.col(value).alias("said"))))
    per_key = opinions.where(F.col(value).isNotNull()).groupBy(*keys).agg(told.alias("_told"))

    def pairs(first: Column, i: Column) -> Column:
        rest = F.slice("_told", i + 2, F.size("_told"))
        return F.transform(rest, lambda second: F.struct(
            first["who"].alias("first_annotator"), second["who"].alias("second_annotator"), first["said"].alias("first_value"), second["said"].alias("second_value")
        ))

    listed = per_key.select(*keys, F.inline(F.flatten(F.transform("_told", pairs))))
    return listed.withColumn("deviation", F.abs(F.col("first_value") - F.col("second_value")))


def intraclass_correlation(opinions: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One-way intraclass correlation from per-key sums (unequal numbers of opinions allowed); NULL where it is not defined."""
    present = opinions.where(F.col(value).isNotNull())
    per_key = present.groupBy(*keys).agg(
        F.count(value).cast("double").alias("_k"), F.avg(value).alias("_m"), (F.var_pop(value) * F.count(value)).alias("_ssw"),
    ).select("_k", "_m", "_ssw")
    parts = per_key.agg(
        F.count("*").cast("double").alias("n"), F.sum("_k").alias("total"), F.sum(F.col("_k") * F.col("_k")).alias("k2"),
        F.sum("_ssw").alias("ssw"), F.try_divide(F.sum(F.col("_k") * F.col("_m")), F.sum("_k")).alias("grand"),
    )
    grand = parts.select("grand").scalar()
    between = per_key.agg(F.sum(F.col("_k") * (F.col("_m") - grand) * (F.col("_m") - grand)).alias("ssb"))
    whole = parts.withColumn("ssb", between.select("ssb").scalar())
    k0 = F.try_divide(F.col("total") - F.try_divide("k2", "total"), F.col("n") - 1)
    msb, msw = F.try_divide(F.col("ssb"), F.col("n") - 1), F.try_divide(F.col("ssw"), F.col("total") - F.col("n"))
    return whole.select(F.col("n").cast("bigint").alias("n_keys"), msb.alias("ms_between"), msw.alias("ms_within"),
                        F.try_divide(msb - msw, msb + (k0 - 1) * msw).alias("icc"))


def learning_errors(
    pool: DataFrame, test: DataFrame, x: str, y: str, grid: Sequence[int], repetitions: int, seed: int, keys: Sequence[str]
) -> DataFrame:
    """``test`` for every repetition and label-set size, with the absolute error ``miss`` of the calibration line fitted there.

    The sets are nested prefixes of the pool; a pool row feeds every set it belongs to. ``test`` must hold other
    entities than the pool (``frozen_split``), or the errors are those of the training rows.
    """
    chained = nested_chains(pool, grid, repetitions, seed, keys).where(F.col("first_level").isNotNull())
    sizes = F.filter(F.array(*[F.lit(n) for n in sorted(grid)]), lambda n: n >= F.col("first_level"))
    slope, intercept = line_columns(x, y)
    lines = chained.withColumn("level", F.explode(sizes)).groupBy("repetition", "level").agg(
        slope.alias("slope"), intercept.alias("intercept")
    )
    runs = F.explode(F.sequence(F.lit(1), F.lit(repetitions)))
    targets = test.withColumn("repetition", runs).withColumn("level", F.explode(F.array(*[F.lit(n) for n in sorted(grid)])))
    scored = targets.join(F.broadcast(lines), ["repetition", "level"])  # repetitions x grid rows
    return scored.withColumn("miss", F.abs(F.col("slope") * F.col(x) + F.col("intercept") - F.col(y))).drop("slope", "intercept")


def learning_runs(
    pool: DataFrame, test: DataFrame, x: str, y: str, grid: Sequence[int], repetitions: int, seed: int, keys: Sequence[str]
) -> DataFrame:
    """Mean test error for every repetition and label-set size, from ``learning_errors``."""
    scored = learning_errors(pool, test, x, y, grid, repetitions, seed, keys)
    return scored.groupBy("repetition", "level").agg(F.avg("miss").alias("mae"), F.count("*").alias("n_test"))


def fit_learning_curve(curve: DataFrame, n: str, error: str, floors: Sequence[float], margin: float) -> DataFrame:
    """Power law ``floor + a * n^-b`` by a grid over the floor; also the size where it flattens.

    ``curve`` has one row per grid size.
    """
    tried = curve.withColumn("floor", F.explode(F.array(*[F.lit(float(f)) for f in floors]))).where(F.col(error) > F.col("floor"))
    lx, ly = F.log(n), F.log(F.col(error) - F.col("floor"))
    logs = tried.withColumn("_lx", lx).withColumn("_ly", ly)
    fits = logs.groupBy("floor").agg(
        F.regr_slope("_ly", "_lx").alias("_s"), F.regr_intercept("_ly", "_lx").alias("_i"), F.count("*").alias("_n")
    ).where((F.col("_n") >= 3) & (F.col("_s") < 0))
    fitted = tried.join(F.broadcast(fits), "floor").withColumn("_fit", F.col("floor") + F.exp("_i") * F.pow(F.col(n), F.col("_s")))
    miss = F.col(error) - F.col("_fit")
    scored = fitted.groupBy("floor").agg(F.sum(miss * miss).alias("sse"), F.first("_s").alias("_s"), F.first("_i").alias("_i"))
    best = scored.agg(F.min_by(F.struct("floor", "_s", "_i", "sse"), F.struct("sse", "floor")).alias("b"))
    a, b = F.exp(F.col("b._i")), -F.col("b._s")
    return best.select(F.col("b.floor").alias("floor"), a.alias("a"), b.alias("b"), F.col("b.sse").alias("sse"),
                       F.pow(a / F.lit(margin / 2), 1 / b).alias("n_star"))
