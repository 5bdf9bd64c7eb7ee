"""Quality rules as a short-circuit cascade, in Spark functions only.

Every rule says when a text is rejected. A bounded sample tells how often each rule rejects and how
long it takes: one job evaluates every rule ``REPEATS`` times on each sampled row, between two readings of
the executor's clock, and takes the median of the repeats' sums less that of a rule that does nothing, so
neither the start of a job nor the order of the rules counts. The rules are then tried in the order of
rejections per second, and the first that rejects ends the evaluation of a text (``CASE WHEN`` evaluates
lazily). The order changes only the time: a text is kept if no rule rejects it, whatever the order.

Defined results: null, empty and blank texts have no words and are rejected by the length rule;
repeated rows are judged one by one; an empty table gives an empty table; other columns are neither
read nor changed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.llm.text import BLANKS, let, rows_of, shingle_hashes, words

SYMBOLS = "#*$%&|<>"

#: Rows of the sample on which cost and selectivity of the rules are estimated.
SAMPLE_ROWS = 2000

#: Evaluations of each rule per sampled row.
REPEATS = 5


@dataclass(frozen=True)
class Rule:
    """A named condition under which a text is rejected."""

    name: str
    rejects: Column


def n_of(text: Column, chars: str) -> Column:
    """How many characters of a text belong to a class."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[{chars}]")), F.lit(0)).cast("long")


def word_chars(tokens: Column) -> Column:
    """Code points in all words."""
    return F.length(F.array_join(tokens, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return n_of(text, SYMBOLS)


def lines_with_words(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(tokens: Column, width: int = 5) -> Column:
    """Words inside runs of ``width`` words that occur twice or more in the text, the first included.

    Windows are sorted by hash; equal neighbours give the positions of repeated windows, and the
    union of their words is the sum of the gaps between positions, each at most ``width``.
    """

    def covered(positions: Column) -> Column:
        return F.aggregate(
            positions,
            F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def repeated(ordered: Column) -> Column:
        same = F.filter(
            ordered,
            lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]),
        )
        return covered(F.sort_array(F.transform(same, lambda x: x["i"])))

    def count(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(placed), repeated)
        )

    return let(shingle_hashes(tokens, width), count).cast("long")


def digest_columns(text: Column, tokens: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": word_chars(tokens),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(tokens),
    }


def base_failed(n_words: Column, repeated: Column) -> Column:
    return (n_words < 10) | (100 * repeated > 20 * n_words)


def default_rules(text: Column, tokens: Column, measured: dict[str, Column] | None = None) -> list[Rule]:
    """The production rules; ``measured`` gives figures that are columns already.

    Limits lie far from ordinary prose: a mean word length outside 2 to 25 code points, more than a
    symbol for every five words, more than half of the lines repeated, more than half of the words
    ending in an exclamation mark, and more digits than half of all word characters.
    """
    m = measured or digest_columns(text, tokens)
    n = m["n_words"]
    return [
        Rule("length", n < 10),
        Rule("word_length", (m["word_chars"] < 2 * n) | (m["word_chars"] > 25 * n)),
        Rule("symbols", 5 * m["n_symbols"] > n),
        Rule("shouting", 2 * F.size(F.filter(tokens, lambda w: w.endswith("!"))) > n),
        Rule("digits", 2 * n_of(text, "0-9") > m["word_chars"]),
        Rule("lines", 2 * m["n_dup_lines"] > F.size(lines_with_words(text))),
        Rule("repetition", 100 * m["n_repeat_words"] > 20 * n),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def _sampled(docs: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` random rows; only the sample is bounded, the cascade then runs over every row."""
    return docs.sample(min(1.0, sample_rows / max(docs.count(), 1)), seed=7)


def _timed(rules: Sequence[Rule]) -> Column:
    """``repeat, rule, gone, nanos`` of every evaluation, in order; rule 0 does nothing."""
    clock = F.expr("reflect('java.lang.System', 'nanoTime')").cast("long")

    def reading(repeat: int, n: int, rejects: Column) -> Column:
        return F.struct(
            F.lit(repeat).alias("repeat"),
            F.lit(n).alias("rule"),
            clock.alias("began"),
            F.coalesce(rejects, F.lit(False)).alias("gone"),
            clock.alias("ended"),
        )

    tried = [F.lit(False), *[r.rejects for r in rules]]
    return F.array(*[reading(k, n, rejects) for k in range(REPEATS) for n, rejects in enumerate(tried)])


def estimate(
    sample: DataFrame, tokens: Column, rules_of: Callable[[Column], Sequence[Rule]]
) -> list[Estimate]:
    """Cost and selectivity of each rule on ``sample``, best rejection per second first.

    ``rules_of`` gives the rules from ``tokens``, which are cut once per row and not timed. Rules are
    timed as parts of one expression per row, as the cascade evaluates them.
    """
    names: list[Rule] = []

    def readings(x: Column) -> Column:
        names[:] = rules_of(x)
        return _timed(names)

    sums = (
        sample.select(F.explode(let(tokens, readings)).alias("at"))
        .groupBy("at.rule", "at.repeat")
        .agg(
            F.sum(F.col("at.ended") - F.col("at.began")).alias("nanos"),
            F.avg(F.col("at.gone").cast("double")).alias("rejected"),
        )
        .groupBy("rule")
        .agg(F.median("nanos").alias("nanos"), F.max("rejected").alias("rejected"))
    )
    found = {r.rule: r for r in sums.collect()}  # one row per rule
    idle = found[0].nanos if found else 0.0

    def of_rule(n: int, rule: Rule) -> Estimate:
        if n not in found:
            return Estimate(rule, 0.0, 0.0)
        return Estimate(rule, found[n].rejected, max(found[n].nanos - idle, 0.0) / 1e9)

    made = [of_rule(n, rule) for n, rule in enumerate(names, 1)]
    return sorted(made, key=lambda e: (-e.gain, e.seconds, e.rule.name))


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule, in this order, that rejects the row; null where none does."""
    if not rules:
        return F.lit(None).cast("string")
    first, *rest = rules
    return reduce(lambda c, r: c.when(r.rejects, F.lit(r.name)), rest, F.when(first.rejects, F.lit(first.name)))


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Rows of ``docs`` as ``__row`` with ``rejected_by``, the rule that ended the cascade, or null.

    Words are cut once, inside the verdict's own expression, so that a filter on the verdict may move
    below without cutting them for every rule; everything else is evaluated only where the cascade
    reaches it. Which of several rejecting rules is named depends on the measured order.
    """
    sample = _sampled(docs.select(docs["text"]), sample_rows)
    tried = estimate(sample, words(F.col("text")), lambda tokens: default_rules(F.col("text"), tokens))
    ordered = [e.rule.name for e in tried]

    def verdict(tokens: Column) -> Column:
        rules = {r.name: r for r in default_rules(docs["text"], tokens)}
        return cascade([rules[name] for name in ordered])

    return rows_of(docs, rejected_by=let(words(docs["text"]), verdict))


def keep_good(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns unchanged."""
    return judge(docs, sample_rows).filter(F.col("rejected_by").isNull()).select("__row.*")


def quality_digest(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Figures of every row and a verdict.

    The figures are asked for in every row, so the rules are timed with the figures at hand, where those
    that look at the text once more are the dear ones; the cascade runs only where the base limits hold.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    figures = {k: F.col(k) for k in names}

    def measured(df: DataFrame) -> DataFrame:
        cut = df.select("doc_id", "text", words(df["text"]).alias("words"))
        return cut.select("*", *[c.alias(k) for k, c in digest_columns(F.col("text"), F.col("words")).items()])

    def rules(tokens: Column) -> list[Rule]:
        return default_rules(F.col("text"), tokens, figures)

    sample = measured(_sampled(docs.select("doc_id", "text"), sample_rows))
    ordered = [e.rule.name for e in estimate(sample, F.col("words"), rules)]
    by_name = {r.name: r for r in rules(F.col("words"))}
    verdict = cascade([by_name[name] for name in ordered])
    return (
        measured(docs)
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .select("doc_id", *names, "base_failed", F.when(F.col("base_failed"), False).otherwise(verdict.isNull()).alias("kept"))
    )
