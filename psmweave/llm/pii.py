"""Personal data by bootstrapped contextual extraction.

1. Seeds: e-mail addresses, IP addresses, card and phone numbers found by their form.
2. Every other word that looks like an identifier (a digit, ``@`` or ``_`` in it and five characters or
   more) is a candidate. Seeds and candidates are instances; the words around an occurrence give its
   lexical patterns: one or two words before, one or two after, one on each side. A neighbour that is an
   identifier itself stands in the pattern as its kind or shape, and digits in words stand as ``0``.
3. Pattern and instance scores are computed in turn on the graph of both. A pattern's score for a
   kind is the share of its distinct instances that belong to the kind (weighted by their scores), with
   ``PRIOR`` instances of nothing added and ``SUPPORT`` distinct seeds demanded; a candidate's score is
   that of its best pattern. A candidate that reaches ``ACCEPT`` for a kind takes part in the next round
   as an instance of it.
4. Occurrences of accepted candidates next to a pattern that reaches ``ACCEPT`` become added spans of
   that kind.

Only a text's occurrences leave the scan, identifiers as 128-bit hashes; edges are made distinct before
they move, so a pattern or an instance that holds a third of them is a few rows. Defined results: null and empty texts have no
spans; every row gets a row; rows that repeat a ``doc_id`` with other texts keep their own spans; a
null ``doc_id`` is like any other; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.llm.store import written

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.8
SUPPORT = 5
PRIOR = 1.0
ROUNDS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"([0-9]++)(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARKS = "\"'()[]{}<>.,;:!?"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with a domain after it and the longest local part before it, from left to right."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            end = match.end()
        else:
            end = at + 1
        at = text.find("@", end)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if m[2] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        found += [(s, 0, e) for s, e in emails(text)]
    if re.search("[0-9]", text):
        found += [(s, 1, e) for s, e in ips(text)]
        found += [(s, 2, e) for s, e in cards(text)]
    if "+" in text:
        found += [(s, 3, e) for s, e in phones(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def shape(word: str) -> str:
    """A word as it stands in a pattern: lower case, digits as 0; identifiers by their characters only."""
    low = word.lower().strip(_MARKS)
    if len(low) >= 5 and re.search("[0-9@_]", low):
        return "<" + re.sub(r"(.)\1+", r"\1", re.sub("[^0-9@._+-]", "a", re.sub("[0-9]", "0", low)))[:12] + ">"
    return re.sub("[0-9]", "0", low)[:40]


def occurrences(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Seeds and candidates of a text with their patterns."""
    if not spans and not re.search("[0-9@_]", text):
        return []
    tokens: list[tuple[int, int, str, str | None]] = []  # start, end, shape, kind (empty: candidate)
    merged: list[list] = []
    for s, e, k in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e, k])
    ahead = iter([*merged, None])
    seed = next(ahead)
    at = 0
    while True:
        m = _WORD.search(text, at)
        if m is None:
            break
        if seed and m.end() > seed[0]:
            tokens.append((seed[0], seed[1], f"<{seed[2]}>", seed[2]))
            at, seed = seed[1], next(ahead)
            continue
        word = m[0]
        left = len(word) - len(word.lstrip(_MARKS))
        bare = word.strip(_MARKS)
        candidate = len(bare) >= 5 and re.search("[0-9@_]", bare)
        start = m.start() + left
        tokens.append((start, start + len(bare), shape(word), "" if candidate else None))
        at = m.end()
    around = ["^", "^", *(t[2] for t in tokens), "$", "$"]
    out = []
    for i, (s, e, _, kind) in enumerate(tokens):
        if kind is not None:
            a, b, c, d = around[i], around[i + 1], around[i + 3], around[i + 4]
            out.append(
                {"start": s, "end": e, "kind": kind, "value": xxhash.xxh3_128_hexdigest(text[s:e].encode()),
                 "patterns": [f"{a} {b} _", f"{b} _", f"{b} _ {c}", f"_ {c}", f"_ {c} {d}"]}
            )
    return out


_SCAN = (
    "doc_id long, base array<struct<start:int,end:int,kind:string>>, "
    "found array<struct<start:int,end:int,kind:string,value:string,patterns:array<string>>>"
)
_BASE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_FOUND_TYPE = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]
    )
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, found = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
            found.append(occurrences(text or "", spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, _BASE_TYPE), pa.array(found, _FOUND_TYPE)], names=["doc_id", "base", "found"]
        )


def _pattern_scores(edges: DataFrame, known: DataFrame | None, accept: float, support: int, prior: float) -> DataFrame:
    """``pattern, kind, score`` of the patterns that reach ``accept``.

    ``edges``: distinct ``pattern, value, seed`` (kind or empty); ``known``: accepted ``value, kind, score``,
    if there are any yet.
    """
    nothing = {"kind": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}
    scored_edges = edges.withColumns(nothing) if known is None else edges.join(known, "value", "left")
    held = scored_edges.select(
        "pattern",
        F.when(F.col("seed") != "", F.col("seed")).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("seed") != "", F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
        (F.col("seed") != "").alias("seed"),
    )
    by_kind = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"w_{k}") for k in KINDS]
    seeds = [F.count_if((F.col("kind") == k) & F.col("seed")).alias(f"s_{k}") for k in KINDS]
    sums = held.groupBy("pattern").agg(F.count("*").alias("n"), *by_kind, *seeds)
    scored = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), (F.col(f"w_{k}") / (F.col("n") + prior)).alias("score"), F.col(f"s_{k}").alias("seeds"))
            for k in KINDS
        ]
    )
    return (
        sums.select("pattern", F.explode(scored).alias("k"))
        .select("pattern", "k.*")
        .filter((F.col("score") >= accept) & (F.col("seeds") >= support))
        .drop("seeds")
    )


def bootstrap(
    edges: DataFrame, accept: float = ACCEPT, support: int = SUPPORT, prior: float = PRIOR, rounds: int = ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (``pattern, kind, score``) and candidates (``value, kind, score``) after some rounds."""
    if rounds < 1:
        raise ValueError("at least one round is needed")
    known = patterns = None
    for step in range(rounds):
        patterns = written(_pattern_scores(edges, known, accept, support, prior), f"patterns-{step}")
        best = F.max(F.struct("score", "kind")).alias("b")
        known = written(
            edges.filter("seed = ''").join(patterns, "pattern").groupBy("value").agg(best).select("value", "b.kind", "b.score"),
            f"instances-{step}",
        )
    return patterns, known


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, by start, then kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.sort_array(
        F.transform(
            spans,
            lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("k"), x["end"].alias("end"), x["kind"].alias("kind")),
        )
    )
    return F.array_join(
        F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def extract(docs: DataFrame, accept: float = ACCEPT, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``added`` spans (arrays of ``start, end, kind``)."""
    scanned = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _SCAN)
    rows = written(scanned.withColumn("row", F.monotonically_increasing_id()), "identifiers")
    found = rows.select("row", F.explode("found").alias("o")).select("row", "o.*")
    edges = written(
        found.select(F.explode("patterns").alias("pattern"), "value", F.col("kind").alias("seed"))
        .distinct(),
        "pattern-edges",
    )
    patterns, known = bootstrap(edges, accept, support, rounds=rounds)
    candidates = found.filter("kind = ''").select("row", "start", "end", "value", F.explode("patterns").alias("pattern"))
    added = (
        candidates.join(patterns.select("pattern", "kind"), "pattern")
        .join(known.select("value", "kind"), ["value", "kind"])
        .select("row", F.struct("start", "end", "kind").alias("span"))
        .groupBy("row")
        .agg(F.collect_set("span").alias("added"))
    )
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select(
        "doc_id", "base", F.coalesce("added", none).alias("added")
    )


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base spans, their hash, and all spans, per row of :func:`extract`."""
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
