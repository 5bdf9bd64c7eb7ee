"""Grouped tables of a benchmark: counts, shares, overlaps, tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.operators.joins import KEY, PSM_KEY
from psmweave.operators.running import rank_rows, small_groups
from psmweave.operators.windows import share_in_group


def count_by(df: DataFrame, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))


def accuracy_by_psm_type(
    psms: DataFrame,
    truth: DataFrame,
    types: Sequence[str] = ("target_accepted", "target_rejected", "decoy"),
) -> DataFrame:
    """Precision and coverage per engine and ground-truth type (A4).

    An engine without predictions in a type gets (null, 0).
    """
    sizes = truth.groupBy("psm_type").agg(F.count(F.lit(1)).alias("n_spectra"))
    rows = psms.join(truth.select(*KEY, "psm_type"), KEY)
    found = rows.groupBy("engine", "psm_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct_prediction"), 1)).alias("c")
    )
    grid = psms.select("engine").distinct().withColumn(
        "psm_type", F.explode(F.array(*[F.lit(t) for t in types]))
    )
    n = F.coalesce("n", F.lit(0))
    return (
        grid.join(found, ["engine", "psm_type"], "left")
        .join(sizes, "psm_type", "left")
        .select(
            "engine",
            "psm_type",
            F.when(n > 0, F.col("c") / n).alias("precision"),
            F.when(F.col("n_spectra") > 0, n / F.col("n_spectra")).otherwise(F.lit(0.0)).alias("coverage"),
        )
    )


def extra_predictions(psms: DataFrame) -> DataFrame:
    """Predictions without any ground truth, per engine (A4)."""
    lost = F.count(F.when(F.col("correct_prediction").isNull(), 1))
    return psms.groupBy("engine").agg(
        lost.alias("absolute"), (lost / F.count(F.lit(1))).alias("pct")
    )


def group_engines(
    psms: DataFrame, separator: str = "|", spectrum: str = "spectrum_id", peptide: str = "peptide"
) -> DataFrame:
    """(spectrum, peptide) with its engines and the composite title.

    Counts per engine are formed first, so a collected list is as long as the number of
    engines.  A separator inside an id is an error when the row is read.  Rows are shuffled once,
    by spectrum where its PSMs are few by their meaning, and a join on the spectrum needs no more.
    """
    keys = [c for c in ("run", spectrum, peptide) if c in psms.columns]
    if small_groups(keys):
        psms = psms.select(*keys, "engine").repartition(*[k for k in keys if k != peptide])
    counts = psms.groupBy(*keys, "engine").agg(F.count(F.lit(1)).alias("n"))
    engines = F.array_sort(F.collect_list(F.struct("engine", "n")))
    title = F.when(
        F.col(spectrum).cast("string").contains(separator),
        F.raise_error(F.concat(F.lit("separator in spectrum id: "), F.col(spectrum).cast("string"))),
    ).otherwise(F.concat(F.col(spectrum).cast("string"), F.lit(separator * 2), F.array_join("engines", separator)))
    return (
        counts.groupBy(*keys)
        .agg(engines.alias("_e"))
        .withColumn(
            "engines",
            F.flatten(F.transform("_e", lambda e: F.array_repeat(e["engine"], e["n"].cast("int")))),
        )
        .withColumn("title", title)
        .drop("_e")
    )


def pivot_counts(
    df: DataFrame, group: Sequence[str], column: str, values: Sequence[str]
) -> DataFrame:
    """Counts of ``column`` spread over declared ``values``."""
    counts = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(*group).pivot(column, list(values)).agg(F.sum("n"))
    return out.na.fill(0, subset=list(values))


def refinement_states(matched: DataFrame) -> DataFrame:
    """Long table (refiner, state, error_type) of unchanged, base and refined PSMs.

    ``matched`` has ``unchanged, error_type, refined_error_type``.
    """
    states = F.when(
        F.col("unchanged"), F.array(F.struct(F.lit("Unchanged").alias("state"), F.col("error_type")))
    ).otherwise(
        F.array(
            F.struct(F.lit("Refined_base").alias("state"), F.col("error_type")),
            F.struct(F.lit("Refined").alias("state"), F.col("refined_error_type").alias("error_type")),
        )
    )
    return matched.select("refiner", F.inline(states))


def refinement_flow(base: DataFrame, refined: DataFrame) -> DataFrame:
    """One wide row per spectrum and engine: base type, refined?, refined type, flow.

    The flow class names the row colours of the reference: improved, kept, towards the
    database, or lost.
    """
    out = base.select(*PSM_KEY, F.col("error_type").alias("base_type")).join(
        refined.select(*PSM_KEY, "refiner", "unchanged", "refined_error_type"), PSM_KEY, "left"
    )
    b = F.col("base_type")
    r = F.when(F.col("unchanged"), b).otherwise(F.col("refined_error_type"))
    hit, out_db, in_db = "match", "No match - Not in FASTA", "No match - In FASTA"
    return out.select(
        *PSM_KEY,
        "refiner",
        "base_type",
        (~F.col("unchanged")).alias("refined"),
        r.alias("refined_type"),
        F.when(r.isNull(), F.lit(None))
        .when((b == hit) & (r == hit), "kept")
        .when((b != hit) & (r == hit), "improved")
        .when((b == out_db) & (r == in_db), "towards_database")
        .when((b == hit) & (r != hit), "lost")
        .when(b == r, "kept")
        .alias("flow"),
    )


def refined_share(matched: DataFrame, group: Sequence[str] = ("engine",)) -> DataFrame:
    """Share of refined PSMs per group."""
    return matched.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg((~F.col("unchanged")).cast("double")).alias("share_refined")
    )


def describe(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles and max of a small table's column."""
    q = [F.percentile(value, p).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        *q,
        F.max(value).alias("max"),
    )


def outcome_rates(outcomes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Outcome counts over all, correct and incorrect predictions.

    ``outcomes``: engine, refiner, outcome.  ``predictions``: engine, correct.
    """
    sizes = predictions.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n_all"), F.count(F.when(F.col("correct"), 1)).alias("n_correct")
    )
    counts = count_by(outcomes, "engine", "refiner", "outcome").join(sizes, "engine")
    wrong = F.col("n_all") - F.col("n_correct")
    return counts.select(
        "engine",
        "refiner",
        "outcome",
        "n",
        (F.col("n") / F.col("n_all")).alias("per_prediction"),
        F.when(F.col("n_correct") > 0, F.col("n") / F.col("n_correct")).alias("per_correct"),
        F.when(wrong > 0, F.col("n") / wrong).alias("per_incorrect"),
    )


def distance_histogram(
    df: DataFrame, distance: str, group: Sequence[str], low: int | None = None, high: int | None = None
) -> DataFrame:
    """Share per distance with pooled tails."""
    value = F.col(distance)
    if high is not None:
        value = F.least(value, F.lit(high))
    if low is not None:
        value = F.greatest(value, F.lit(low))
    counts = df.withColumn(distance, value).groupBy(*group, distance).agg(F.count(F.lit(1)).alias("n"))
    return share_in_group(counts, group)


def mean_over(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Unweighted mean over the remaining groups, e.g. engines."""
    return df.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))


def substitution_counts(sites: DataFrame, group: Sequence[str] = ("engine",)) -> DataFrame:
    """Frequency and share of "source -> target" (A23)."""
    text = F.concat(F.col("source"), F.lit(" -> "), F.col("target"))
    counts = sites.withColumn("substitution", text).groupBy(*group, "substitution").agg(
        F.count(F.lit(1)).alias("n")
    )
    return share_in_group(counts, group)


def nearest_terminus(sites: DataFrame) -> DataFrame:
    """Closest terminus and its distance per error site."""
    n, c = F.col("n_term"), F.col("c_term")
    return sites.withColumns(
        {
            "terminus": F.when(n < c, "N").otherwise("C"),
            "distance": F.least(n, c),
        }
    )


def intersections(df: DataFrame, item: Sequence[str], member: str = "engine") -> DataFrame:
    """Items per exact combination of members, with degree.

    The set per item has at most as many elements as there are members.
    """
    return (
        df.select(*item, member)
        .distinct()
        .groupBy(*item)
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .groupBy("members")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.array_join("members", "|").alias("combination"),
            F.size("members").alias("degree"),
            "n",
            "members",
        )
    )


def pairwise_overlap(df: DataFrame, item: Sequence[str], member: str = "engine") -> DataFrame:
    """Share of A's items that B has too, for every ordered pair.

    Pairs come from the few distinct combinations, never from the items.
    """
    combos = intersections(df, item, member)
    first = combos.select(F.explode("members").alias("tool_a"), "members", "n")
    pairs = (
        first.select("tool_a", F.explode("members").alias("tool_b"), "n")
        .groupBy("tool_a", "tool_b")
        .agg(F.sum("n").alias("shared"))
    )
    sizes = first.groupBy("tool_a").agg(F.sum("n").alias("size_a"))
    tools = df.select(F.col(member).alias("tool_b")).distinct()
    others = F.collect_set("tool_b")
    grid = sizes.select("tool_a", "size_a").withColumn(
        "tool_b", F.explode(tools.agg(others).scalar())
    )
    return (
        grid.join(pairs, ["tool_a", "tool_b"], "left")
        .withColumn("shared", F.coalesce("shared", F.lit(0)))
        .withColumn("overlap", F.col("shared") / F.col("size_a"))
        .filter("tool_a <> tool_b")
    )


def consensus_false(
    evaluated: DataFrame, k: int, key: Sequence[str] = tuple(KEY), peptide: str = "peptide"
) -> DataFrame:
    """Wrong peptides shared by at least ``k`` tools, with the spectrum's main error type.

    The main type is the most frequent one, ties in alphabetical order.
    """
    wrong = (
        evaluated.filter("error_type <> 'match'")
        .select(*key, peptide, "engine")
        .distinct()
        .groupBy(*key, peptide)
        .agg(F.count(F.lit(1)).alias("n_tools"))
        .filter(F.col("n_tools") >= k)
    )
    main = (
        evaluated.groupBy(*key, "error_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*key)
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), "error_type"))["error_type"].alias("main_type"))
    )
    return wrong.join(main, list(key))


def species_counts(species: DataFrame, specific: bool = True) -> DataFrame:
    """Peptides per organism: specific to it, or any."""
    rows = species.filter("species_n = 1") if specific else species
    return rows.select(F.explode("species").alias("organism")).groupBy("organism").agg(
        F.count(F.lit(1)).alias("count_specific" if specific else "count_all")
    )


def precursor_error_counts(psms: DataFrame, ppm: str = "ppm", cap: float = 50.0) -> DataFrame:
    """Share of predictions whose precursor error is capped, per engine."""
    return psms.groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col(ppm) >= cap, 1)).alias("n_capped"),
        F.avg((F.col(ppm) >= cap).cast("double")).alias("share_capped"),
    )


def rank_distribution(ranks: DataFrame, methods: Sequence[str], base: str) -> DataFrame:
    """Ground-truth ranks counted per scoring method, with the gain over ``base``."""
    long = ranks.unpivot([], list(methods), "method", "rank")
    wide = long.groupBy("rank").pivot("method", list(methods)).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumns(
        {f"gain_{m}": F.col(m) - F.col(base) for m in methods if m != base}
    )


def higher_scoring_rate(evaluated: DataFrame) -> DataFrame:
    """Share of wrong PSMs that score above the ground truth, and the mean difference."""
    diff = F.col("score") - F.col("gt_score")
    return evaluated.filter("error_type <> 'match'").groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((diff > 0).cast("double")).alias("higher_rate"),
        F.avg(diff).alias("mean_diff"),
    )


def equal_width_bin(value: str, low: Column, high: Column, bins: int) -> Column:
    """1-based bin of a value; bins are closed on the right, the minimum falls in bin 1."""
    x = F.ceil((F.col(value) - low) / (high - low) * bins)
    return F.when(high > low, F.least(F.greatest(x, F.lit(1)), F.lit(bins))).otherwise(F.lit(1))


def binned_heatmap(df: DataFrame, x: str, y: str, x_bins: int, y_bins: int) -> DataFrame:
    """Counts over a grid of equal-width bins (A34), long form; pivot for display."""
    lo_hi = df.agg(F.struct(F.min(x), F.max(x), F.min(y), F.max(y)).alias("s"))
    r = lo_hi.scalar()
    cols = df.select(x, y).withColumn("_r", r)

    def part(i):
        return F.col("_r")[f"col{i}"]

    return (
        cols.select(
            equal_width_bin(x, part(1), part(2), x_bins).alias("x_bin"),
            equal_width_bin(y, part(3), part(4), y_bins).alias("y_bin"),
        )
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the incomplete beta function."""
    if math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a, b, x):
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def one_sample_t(df: DataFrame, value: str, group: Sequence[str], mean: float = 0.0) -> DataFrame:
    """t-test of the group mean against ``mean``.

    Spark aggregates; the p-value is computed on one row per group.
    """
    n, sd = F.count(value), F.stddev_samp(value)
    stats = df.groupBy(*group).agg(
        n.alias("n"), F.avg(value).alias("mean"), ((F.avg(value) - mean) / (sd / F.sqrt(n))).alias("t")
    )

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(
            [_t_two_sided(a, b - 1) if b > 1 and a is not None else None for a, b in zip(t, n)]
        )

    return stats.withColumn("p", p_value("t", F.col("n").cast("double")))


def flagged_shares(found: DataFrame, missed: DataFrame, value: str) -> DataFrame:
    """Value shares of PSMs found and not found in a candidate list."""
    both = found.select(value).withColumn("found", F.lit(True)).unionByName(
        missed.select(value).withColumn("found", F.lit(False))
    )
    return share_in_group(count_by(both, "found", value), ["found"])


def group_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values per key (A39): one row per value with its place, from 0, in the key's order.

    Long rows in place of lists, as one key may hold any share of all values.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, value)
    return rank_rows(rows, [key], [(value, True)], "first", "position").withColumn(
        "position", (F.col("position") - 1).cast("long")
    )


def null_count(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value, for the warning about missing organisms."""
    return df.agg(F.count(F.when(F.col(column).isNull(), 1)).alias("n_null"))


