"""Precision, recall and coverage curves.

Every curve first collapses rows to one per (group, score) with partial
aggregation, then accumulates once over the sorted scores.  No threshold looks
at the rows again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from psmweave.operators.running import _null_safe, _way, attach_group_values, running
from psmweave.runtime import stored


def _ratio(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b)


def _fits(strategy: str) -> bool | None:
    return {"single": True, "split": False}.get(strategy)


def score_levels(
    df: DataFrame, group: Sequence[str], score: str = "score", correct: str = "correct"
) -> DataFrame:
    """Rows and correct rows per distinct score."""
    return df.groupBy(*group, score).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(correct), 1)).alias("c")
    )


def prefix_counts(
    df: DataFrame,
    group: Sequence[str],
    score: str = "score",
    correct: str = "correct",
    inclusive: bool = False,
    strategy: str = "auto",
) -> DataFrame:
    """Rows and correct rows above each distinct score, with group totals.

    ``inclusive`` counts the rows at the score itself as well.
    """
    levels = score_levels(df, group, score, correct)
    out = running(
        levels,
        group,
        [(score, False)],
        {"above_n": ("sum", "n"), "above_c": ("sum", "c")},
        inclusive,
        strategy,
    )
    return attach_group_values(
        out, list(group), {"total_n": F.sum("n"), "total_c": F.sum("c")}, _fits(strategy)
    )


def precision_coverage(
    df: DataFrame,
    n_spectra: Column,
    group: Sequence[str] = ("engine",),
    score: str = "score",
    correct: str = "correct",
    strategy: str = "auto",
) -> DataFrame:
    """Curve with every distinct score as threshold (A1).

    Rows tied with the threshold count on neither side.  ``n_spectra`` is the
    number of ground-truth spectra; 0/0 is null.
    """
    p = prefix_counts(df, group, score, correct, False, strategy)
    tp, above = F.col("above_c"), F.col("above_n")
    p = p.select(
        *group,
        score,
        F.col("n").alias("n_rows"),
        tp.alias("tp"),
        (above - tp).alias("fp"),
        (F.col("total_c") - tp - F.col("c")).alias("fn"),
        (F.col("total_n") - above - F.col("n")).alias("u"),
        (n_spectra - above).alias("u_mgf"),
    )
    pos = F.col("tp") + F.col("fp")
    return p.withColumns(
        {
            "precision": _ratio(F.col("tp"), pos),
            "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "coverage": _ratio(pos, pos + F.col("u")),
            "coverage_mgf": _ratio(pos, pos + F.col("u_mgf")),
        }
    )


def threshold_at_precision(
    curve: DataFrame, threshold: float, group: Sequence[str] = ("engine",), score: str = "score"
) -> DataFrame:
    """Lowest score whose precision exceeds ``threshold`` (A2)."""
    return curve.filter(F.col("precision") > threshold).groupBy(*group).agg(
        F.min(score).alias("score"), F.min_by("precision", score).alias("precision")
    )


def accuracy_profile(
    df: DataFrame,
    n_spectra: Column,
    group: Sequence[str] = ("engine",),
    thresholds: Sequence[float] = (0.99, 0.95, 0.9, 0.85, 0.8),
    match_types: Sequence[str] = ("Match", "Better", "Worse", "Isobaric"),
    strategy: str = "auto",
) -> DataFrame:
    """Recall, coverage and score where precision passes each threshold (A3).

    Strict uses column ``correct``, lenient ``lenient``; lenient rows also carry the
    match-type shares among rows at or above the score.  The reference reads the
    score by position from a differently filtered table; here it is joined by score.
    """
    group = list(group)
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    parts = []
    for mode, column in (("strict", "correct"), ("lenient", "lenient")):
        curve = precision_coverage(df, n_spectra, group, "score", column, strategy)
        parts.append(
            curve.select("*", cuts)
            .filter(F.col("precision") > F.col("threshold"))
            .groupBy(*group, "threshold")
            .agg(F.min(F.struct("score", "recall", "coverage")).alias("p"))
            .select(*group, F.lit(mode).alias("mode"), "threshold", "p.*")
        )
    profile = parts[0].unionByName(parts[1])
    levels = df.groupBy(*group, F.col("score").alias("_s"), "match_type").agg(
        F.count(F.lit(1)).alias("_n")
    )
    at = profile.filter("mode = 'lenient'").select(*group, "threshold", F.col("score").alias("_cut"))
    total = F.sum("_n")
    shares = (
        levels.join(at, group)
        .filter(F.col("_s") >= F.col("_cut"))
        .groupBy(*group, "threshold")
        .agg(
            *[
                (F.sum(F.when(F.col("match_type") == m, F.col("_n")).otherwise(0)) / total).alias(
                    f"share_{m.lower()}"
                )
                for m in match_types
            ]
        )
        .withColumn("mode", F.lit("lenient"))
    )
    return profile.join(shares, [*group, "mode", "threshold"], "left")


def pr_auc(
    df: DataFrame,
    group: Sequence[str] = ("engine",),
    score: str = "score",
    correct: str = "correct",
    n_quantiles: int = 20,
    strategy: str = "auto",
) -> DataFrame:
    """Area under the curve through ``n_quantiles`` score quantiles, trapezoid rule.

    Thresholds are inclusive; recall is over all rows of the group, null scores included.
    """
    group = list(group)
    everything = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_targets"))
    levels = score_levels(df.filter(F.col(score).isNotNull()), group, score, correct)
    run = running(
        levels, group, [(score, True)], {"below_n": ("sum", "n"), "below_c": ("sum", "c")}, False,
        strategy,
    )
    lo, hi = F.col("below_n"), F.col("below_n") + F.col("n")
    places = F.transform(
        F.sequence(F.lit(0), F.lit(n_quantiles)),
        lambda i: F.when(i == n_quantiles, F.col("tn") - 1).otherwise(
            F.floor(F.col("tn") * i / F.lit(n_quantiles))
        ),
    )
    points = (
        attach_group_values(run, group, {"tn": F.sum("n"), "tc": F.sum("c")}, _fits(strategy))
        .filter(F.exists(places, lambda p: (p >= lo) & (p < hi)))
        .join(everything, group)
        .select(
            *group,
            F.col(score).alias("threshold"),
            _ratio(F.col("tc") - F.col("below_c"), F.col("n_targets")).alias("recall"),
            _ratio(F.col("tc") - F.col("below_c"), F.col("tn") - F.col("below_n")).alias("precision"),
        )
    )
    # At most n_quantiles + 1 points per group remain.
    w = Window.partitionBy(*group).orderBy(F.col("threshold").desc())
    width = F.col("recall") - F.lag("recall").over(w)
    height = (F.col("precision") + F.lag("precision").over(w)) / 2
    return (
        points.withColumn("_a", width * height)
        .groupBy(*group)
        .agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("auc"))
    )


def prc_linspace(
    df: DataFrame,
    totals: DataFrame | None = None,
    group: Sequence[str] = ("engine",),
    score: str = "score",
    correct: str = "correct",
    points: int = 1000,
) -> DataFrame:
    """Curve at ``points`` equally spaced scores from maximum to minimum, strict > (A10).

    ``totals`` gives ``n_predicted`` per group; by default all rows count.  Each
    distinct score finds the first threshold below it by arithmetic, so no row
    meets more than a handful of thresholds.
    """
    group = list(group)
    levels = score_levels(df, group, score, correct)
    span = levels.groupBy(*group).agg(
        F.max(score).alias("hi"), F.min(score).alias("lo"), F.sum("n").alias("tn")
    )
    if totals is not None:
        span = span.join(totals.select(*group, "n_predicted"), group)
    else:
        span = span.withColumn("n_predicted", F.col("tn"))
    last = points - 1

    def at(k: Column) -> Column:
        step = (F.col("lo") - F.col("hi")) / F.lit(last)
        return F.when(k == last, F.col("lo")).otherwise(F.col("hi") + k * step)

    guess = F.when(
        F.col("hi") > F.col("lo"),
        F.floor((F.col("hi") - F.col(score)) / (F.col("hi") - F.col("lo")) * last),
    ).otherwise(F.lit(0))
    near = F.sequence(F.greatest(guess - 1, F.lit(0)), F.least(guess + 2, F.lit(last)))
    first = F.filter(near, lambda k: F.col(score) > at(k))
    hits = (
        levels.join(span, group)
        .withColumn("k", F.try_element_at(first, F.lit(1)).cast("int"))
        .filter("k IS NOT NULL")
        .groupBy(*group, "k")
        .agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    )
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("k"))
    w = Window.partitionBy(*group).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(hits, [*group, "k"], "left")
        .withColumn("ci", F.sum(F.coalesce("n", F.lit(0))).over(w))
        .withColumn("cc", F.sum(F.coalesce("c", F.lit(0))).over(w))
        .select(
            *group,
            F.col("k").cast("long").alias("k"),
            at(F.col("k")).alias("threshold"),
            _ratio("cc", "ci").alias("precision"),
            _ratio("cc", "n_predicted").alias("recall"),
            _ratio("ci", "n_predicted").alias("coverage"),
        )
    )


#: Bins of a whole number among the ties of a score, and distinct texts up to which each is a bin.
TIE_BINS = 16
TIE_TEXTS = 64


def _tie_bins(rows: DataFrame, ties: Sequence[tuple[str, bool]]) -> list[tuple[str, Column, bool]]:
    """(name, bin, ascending) of the leading columns of a tie order: rows in order are in order of their bins, too.

    A text of few values is a bin itself; a whole number is divided evenly, and what follows it has no bin. Nulls
    stay nulls. Bins only decide how many rows are put in order afterwards, so other columns need none.
    """
    kinds = {f.name: f.dataType for f in rows.schema}
    whole = [c for c, _ in ties if isinstance(kinds[c], T.IntegralType)]
    texts = [c for c, _ in ties if kinds[c] == T.StringType()]
    if not whole and not texts:
        return []
    seen = rows.agg(
        *[f(c).alias(f"{k}_{c}") for c in whole for k, f in (("lo", F.min), ("hi", F.max))],
        *[F.approx_count_distinct(c).alias(f"n_{c}") for c in texts],
    ).first()
    bins = []
    for i, (c, up) in enumerate(ties):
        if c in texts and seen[f"n_{c}"] <= TIE_TEXTS:
            bins.append((f"_bin{i}", F.col(c), up))
            continue
        if c in whole and seen[f"lo_{c}"] is not None:
            width = (seen[f"hi_{c}"] - seen[f"lo_{c}"]) // TIE_BINS + 1
            bins.append((f"_bin{i}", F.call_function("div", F.col(c).cast("long"), F.lit(width).cast("long")), up))
        break
    return bins


def prc_coverage_grid(
    df: DataFrame,
    group: Sequence[str] = ("engine",),
    order: Sequence[tuple[str, bool]] = (("score", False), ("spectrum_id", True)),
    correct: str = "correct",
    points: int = 200,
    n_predicted: Column | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Curve at equal steps of coverage over rows sorted by score.

    Step k of ``points - 1`` looks at the first ceil(k n / (points - 1)) rows. Counts per score level tell in
    which levels a step ends, counts per bin of those levels (see :func:`_tie_bins`) in which bins; only rows of
    those bins are put in order, to count what stands before it.
    """
    group = list(group)
    (score, rising), *ties = order
    steps = points - 1
    flags = df.select(*group, *[c for c, _ in order], F.when(F.col(correct), 1).otherwise(0).alias("_c"))
    if _way(strategy, group) == "single":
        ranked = running(
            flags.withColumn("_one", F.lit(1)), group, order, {"r": ("sum", "_one"), "cc": ("sum", "_c")}, True, "single"
        )
        ranked = attach_group_values(ranked, group, {"n": F.count(F.lit(1))}, True)
    else:
        flags = stored(flags)
        counts = F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("_nc")
        levels = running(
            flags.groupBy(*group, score).agg(*counts), group, [(score, rising)],
            {"_before": ("sum", "_n"), "_before_c": ("sum", "_nc")}, False, "split",
        )
        levels = attach_group_values(stored(levels), group, {"n": F.sum("_n")}, False)
        ends = F.expr(f"({steps} * (_before + _n)) div n > ({steps} * _before) div n")
        found = ["_before", "_before_c", "n"]
        cell = [*group, score]
        last = stored(levels.filter(ends).select(*cell, *found))  # as many as points per group
        bins = _tie_bins(flags, ties)
        if bins:
            flags = flags.withColumns({name: c for name, c, _ in bins})
            names = [name for name, *_ in bins]
            cells = _null_safe(flags.groupBy(*cell, *names).agg(*counts), last, cell, "inner")
            cells = running(
                cells, cell, [(name, up) for name, _, up in bins], {"_b": ("sum", "_n"), "_bc": ("sum", "_nc")}, False, "single"
            ).withColumns({"_before": F.col("_before") + F.col("_b"), "_before_c": F.col("_before_c") + F.col("_bc")})
            cell = [*cell, *names]
            last = stored(cells.filter(ends).select(*cell, *found))
        rows = _null_safe(flags, last, cell, "inner")
        ranked = running(
            rows.withColumn("_one", F.lit(1)), cell, ties or [("_c", False)], {"r": ("sum", "_one"), "cc": ("sum", "_c")}, True, "split"
        ).withColumns({"r": F.col("r") + F.col("_before"), "cc": F.col("cc") + F.col("_before_c")})
    # Row r is the last one of the steps k with steps (r - 1) / n < k <= steps r / n.
    first = F.expr(f"({steps} * (r - 1)) div n + 1")
    last = F.expr(f"({steps} * r) div n")
    total = F.col("n") if n_predicted is None else n_predicted
    return (
        ranked.withColumns({"_first": first, "_last": last})
        .filter("_first <= _last")
        .withColumn("k", F.explode(F.sequence("_first", "_last")))
        .select(
            *group,
            F.col("k").cast("long").alias("k"),
            _ratio("cc", "r").alias("precision"),
            _ratio(F.col("cc"), total).alias("recall"),
            _ratio(F.col("r"), total).alias("coverage"),
        )
    )


def match_score_table(
    psms: DataFrame, key: Sequence[str], refined: DataFrame | None = None
) -> DataFrame:
    """(score, match) per PSM, of the base PSM or of its refinement.

    ``refined`` carries ``unchanged, refined_score, refined_correct`` per key.  PSMs
    without refinement leave the table; :func:`missing_refinements` counts them.
    """
    key = list(key)
    if refined is None:
        return psms.select(*key, "score", F.col("correct").alias("match"))
    joined = psms.join(
        refined.select(*key, "refiner", "unchanged", "refined_score", "refined_correct"), key
    )
    same = F.col("unchanged")
    return joined.select(
        *key,
        "refiner",
        F.when(same, F.col("score")).otherwise(F.col("refined_score")).alias("score"),
        F.when(same, F.col("correct")).otherwise(F.col("refined_correct")).alias("match"),
    )


def missing_refinements(psms: DataFrame, refined: DataFrame, key: Sequence[str]) -> DataFrame:
    return (
        psms.join(refined.select(*key), list(key), "left_anti")
        .groupBy("engine")
        .agg(F.count(F.lit(1)).alias("missing"))
    )


def exact_pr_curve(
    table: DataFrame, group: Sequence[str], score: str = "score", match: str = "match",
    strategy: str = "auto",
) -> DataFrame:
    """Precision and recall at every distinct score, inclusive."""
    p = prefix_counts(table, group, score, match, True, strategy)
    return p.select(
        *group,
        score,
        _ratio("above_c", "above_n").alias("precision"),
        _ratio("above_c", "total_c").alias("recall"),
    )


def aa_score_rows(psms: DataFrame, key: Sequence[str], scores: str = "aa_scores") -> DataFrame:
    """One row per residue with score and match flag.

    Leading extra scores (an N-terminal modification scored apart) are averaged into
    the first residue until both arrays have the same length.
    """
    extra = F.size(scores) - F.size("aa_match")
    head = F.aggregate(
        F.slice(F.col(scores), F.lit(2), F.greatest(extra, F.lit(0))),
        F.element_at(scores, 1),
        lambda acc, x: (acc + x) / 2,
    )
    aligned = F.when(
        extra > 0,
        F.concat(F.array(head), F.slice(F.col(scores), extra + 2, F.size(scores))),
    ).otherwise(F.col(scores))
    pairs = F.zip_with(
        aligned, F.col("aa_match"), lambda s, m: F.struct(s.alias("score"), m.alias("correct"))
    )
    return psms.select(*key, F.posexplode(pairs).alias("pos", "p")).select(*key, "pos", "p.*")


def precision_coverage_by_run(
    evaluated: DataFrame, spectra: DataFrame, group: Sequence[str] = ("engine", "run")
) -> DataFrame:
    """Share of correct predictions and of predicted spectra."""
    n_all = spectra.groupBy("run").agg(F.count(F.lit(1)).alias("n_all"))
    out = evaluated.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_predicted"), F.count(F.when(F.col("correct"), 1)).alias("n_correct")
    )
    return out.join(n_all, "run").select(
        *group,
        "n_predicted",
        "n_correct",
        "n_all",
        _ratio("n_correct", "n_predicted").alias("precision"),
        _ratio("n_predicted", "n_all").alias("coverage"),
    )


def spearman(df: DataFrame, x: str, y: str, group: Sequence[str] = (), strategy: str = "auto"):
    """Rank correlation with average ranks for ties."""
    group = list(group) or ["_g"]
    base = df if "_g" not in group else df.withColumn("_g", F.lit(0))
    ranked = base
    for name in (x, y):
        levels = base.groupBy(*group, name).agg(F.count(F.lit(1)).alias("n"))
        levels = running(levels, group, [(name, True)], {"b": ("sum", "n")}, False, strategy)
        ranks = levels.select(
            *group, name, (F.col("b") + (F.col("n") + 1) / 2).alias(f"_rank_{name}")
        )
        ranked = ranked.join(ranks, [*group, name])
    out = ranked.groupBy(*group).agg(
        F.corr(f"_rank_{x}", f"_rank_{y}").alias("rho"), F.count(F.lit(1)).alias("n")
    )
    return out.drop("_g")


def cumulative_share(
    df: DataFrame, group: Sequence[str], value: str, strategy: str = "auto"
) -> DataFrame:
    """Normalised value counts, sorted by value and accumulated."""
    group = list(group)
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    out = running(counts, group, [(value, True)], {"acc": ("sum", "n")}, True, strategy)
    out = attach_group_values(out, group, {"t": F.sum("n")}, _fits(strategy))
    return out.select(
        *group, value, (F.col("n") / F.col("t")).alias("share"), (F.col("acc") / F.col("t")).alias("cumulative")
    )


