"""Line deduplication by pairwise alignment of overlapping documents.

1. Every text becomes the 128-bit hashes of its trimmed lines with a word. Of documents with equal lines
   the first stands for all; the others lose every line, so thousands of copies cost no pairs.
2. A block of ``min_words`` words holds, around each of its lines, a shortest run of lines with so many
   words. Documents that could share a block therefore hold equal shortest runs, and meet through them.
3. Pairs are aligned over all lines they share by patience diff: lines that both hold once are anchors,
   the longest increasing run of anchors is kept, and the gaps between anchors are aligned the same way;
   a gap without anchors gets a longest common subsequence. A document is aligned with the first holder of each of its runs. Runs that this does not
   delete (their order differs there) are aligned with ever more of their earlier holders, twice as many
   in each step, until they are deleted or all holders have been tried: the result is that of all pairs.
4. Aligned lines that follow each other in both documents (blank lines aside) form a block. Blocks of
   ``min_words`` words or more are deleted from the later document, the one with the larger ``doc_id``.

Only hashes and positions move until texts and deletions are joined. Defined results: null, empty and
blank texts stay as they are; rows with a null ``doc_id`` are left alone; rows that repeat both
``doc_id`` and text are one document and get the same deletions, rows that repeat only the ``doc_id``
are documents of their own, ordered by the hash of their text; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psmweave.llm.store import written
from psmweave.llm.text import BLANKS

MIN_WORDS = 5

_DOCS = "doc_id long, t long, s long, z long, lines binary, n_words array<int>, pos array<int>"
_RUNS = "doc_id long, t long, a int, b int, h long, g long"
_DIGEST = 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _halves(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def _lines(min_words: int):
    """Texts to their lines with words: digests, numbers of words, line numbers, and a hash of the whole sequence."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, t, text in ((x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                lines = [(pos, w, line) for pos, line in enumerate(text.split(b"\n")) if (w := len(line.split()))]
                if sum(w for _, w, _ in lines) >= min_words:
                    digests = b"".join(xxhash.xxh3_128_digest(line.strip()) for _, _, line in lines)
                    out.append((doc_id, t, *_halves(digests), digests, [w for _, w, _ in lines], [p for p, _, _ in lines]))
            yield _batch(out, _DOCS_ARROW)

    return rows


_DOCS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("t", pa.int64()), ("s", pa.int64()), ("z", pa.int64()), ("lines", pa.binary()),
     ("n_words", pa.list_(pa.int32())), ("pos", pa.list_(pa.int32()))]
)
_RUNS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("h", pa.int64()), ("g", pa.int64())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def least_runs(n_words: list[int], min_words: int) -> set[tuple[int, int]]:
    """First and last line of the shortest runs of ``min_words`` words from each line on and up to each line."""
    out, a, total = set(), 0, 0
    for b, w in enumerate(n_words):  # up to b
        total += w
        while total - n_words[a] >= min_words:
            total -= n_words[a]
            a += 1
        if total >= min_words:
            out.add((a, b))
    b, total = len(n_words) - 1, 0
    for a in range(len(n_words) - 1, -1, -1):  # from a on
        total += n_words[a]
        while total - n_words[b] >= min_words:
            total -= n_words[b]
            b -= 1
        if total >= min_words:
            out.add((a, b))
    return out


def _runs(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, t, lines, n_words in ((x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                for a, b in least_runs(n_words, min_words):
                    out.append((doc_id, t, a, b, *_halves(lines[a * _DIGEST : (b + 1) * _DIGEST])))
                if len(out) >= 20_000:
                    yield _batch(out, _RUNS_ARROW)
                    out = []
            yield _batch(out, _RUNS_ARROW)

    return rows


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting with back pointers)."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        below.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(shared: list[tuple[int, int, bool]]) -> list[int]:
    """Indices of the aligned ones of ``(place here, place there, once in both)``, sorted by place here."""
    anchors = [i for i, s in enumerate(shared) if s[2]]
    kept = [anchors[j] for j in longest_increasing([shared[i][1] for i in anchors])]
    out: list[int] = []
    previous, low = -1, -1
    for stop, high in [*((i, shared[i][1]) for i in kept), (len(shared), 1 << 62)]:
        gap = [i for i in range(previous + 1, stop) if not shared[i][2] and low < shared[i][1] < high]
        out += [gap[j] for j in longest_increasing([shared[i][1] for i in gap])]
        if stop < len(shared):
            out.append(stop)
        previous, low = stop, high
    return out


def deletions(shared: list[dict], min_words: int) -> list[int]:
    """Line numbers that aligned blocks with any partner delete from one document."""
    partners: dict[tuple, dict[int, dict]] = defaultdict(dict)
    for s in shared:
        partners[(s["p_doc"], s["p_t"])][s["seq"]] = s
    gone: set[int] = set()
    for lines in partners.values():
        rows = [lines[seq] for seq in sorted(lines)]
        aligned = [rows[i] for i in align([(r["seq"], r["p_seq"], r["once"]) for r in rows])]
        block: list[dict] = []
        for r in [*aligned, None]:
            if block and (r is None or r["seq"] != block[-1]["seq"] + 1 or r["p_seq"] != block[-1]["p_seq"] + 1):
                if sum(b["n_words"] for b in block) >= min_words:
                    gone.update(b["pos"] for b in block)
                block = []
            if r is not None:
                block.append(r)
    return sorted(gone)


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; rows of bits, of which every ``step``-th is kept for the way back."""
    masks: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        masks[x] |= 1 << j
    full = (1 << len(b)) - 1
    step = max(1, int(len(a) ** 0.5))

    def ahead(row: int, x: int) -> int:
        u = row & masks.get(x, 0)
        return ((row + u) | (row - u)) & full

    kept, row = [], full
    for i, x in enumerate(a):
        if i % step == 0:
            kept.append(row)
        row = ahead(row, x)
    out: list[tuple[int, int]] = []
    j = len(b) - 1
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k]]
        for x in a[k * step : (k + 1) * step]:
            rows.append(ahead(rows[-1], x))
        i = len(rows) - 2
        while i >= 0 and j >= 0:
            if rows[i + 1] >> j & 1:  # nothing gained by this place there
                j -= 1
            elif not rows[i] >> j & 1:  # gained without this place here
                i -= 1
            else:
                out.append((k * step + i, j))
                i, j = i - 1, j - 1
    return out[::-1]


def places(here: list, there: list) -> list[tuple[int, int]]:
    """Aligned places of two documents by patience diff, which goes on inside the gaps between anchors.

    A gap without a line that both sides hold once gets a longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(here), 0, len(there))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and here[a] == there[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        one, two = Counter(here[a:b]), Counter(there[c:d])
        at = {x: j for j, x in enumerate(there[c:d], c) if two[x] == 1}
        single = [(i, at[x]) for i, x in enumerate(here[a:b], a) if one[x] == 1 and x in at]
        anchors = [single[k] for k in longest_increasing([j for _, j in single])]
        if anchors:
            out += anchors
            ends = [(a - 1, c - 1), *anchors, (b, d)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:]) if i + 1 < k and j + 1 < m]
        else:
            both = one.keys() & two.keys()
            left = [i for i in range(a, b) if here[i] in both]
            right = [j for j in range(c, d) if there[j] in both]
            out += [(left[i], right[j]) for i, j in longest_common([here[i] for i in left], [there[j] for j in right])]
    return sorted(out)


def gone_lines(lines: bytes, n_words: list[int], there: bytes, min_words: int) -> list[int]:
    """Lines (by their place among the lines with words) that aligned blocks with one other document delete."""
    here, other = ([x[i : i + _DIGEST] for i in range(0, len(x), _DIGEST)] for x in (lines, there))
    shared = [
        {"pos": i, "seq": i, "n_words": n_words[i], "p_doc": 0, "p_t": 0, "p_seq": j, "once": True} for i, j in places(here, other)
    ]
    return deletions(shared, min_words)


#: Lines of documents whose deletions a task unites before it hands them on.
_UNITED = 200_000
_GONE_ARROW = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("gone", pa.list_(pa.int32()))])


def _united(gone: dict[tuple[int, int], set[int]]) -> pa.RecordBatch:
    return _batch([(*key, sorted(lines)) for key, lines in gone.items() if lines], _GONE_ARROW)


def _aligned(pairs: DataFrame, documents: DataFrame, min_words: int) -> DataFrame:
    """``doc_id, t, gone`` of all pairs ``doc_id, t, p_doc, p_t`` that delete something.

    The pairs of a document come together, so that what several partners delete is handed on once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        united: dict[tuple[int, int], set[int]] = {}
        held = 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):  # one pair at a time as Python objects
                doc_id, t, lines, n_words, there = (x.as_py() for x in row)
                if held > _UNITED and (doc_id, t) not in united:
                    yield _united(united)
                    united, held = {}, 0
                before = united.setdefault((doc_id, t), set())
                size = len(before)
                before.update(gone_lines(lines, n_words, there, min_words))
                held += 1 + len(before) - size
        yield _united(united)

    partners = documents.select(F.col("doc_id").alias("p_doc"), F.col("t").alias("p_t"), F.col("lines").alias("there"))
    return (
        pairs.join(partners, ["p_doc", "p_t"])
        .join(documents.select("doc_id", "t", "lines", "n_words"), ["doc_id", "t"])
        .select("doc_id", "t", "lines", "n_words", "there")
        .mapInArrow(run, "doc_id long, t long, gone array<int>")
    )


def _union(gone: DataFrame) -> DataFrame:
    """Every line of a document once, however many tasks have found it."""
    lines = gone.select("doc_id", "t", F.explode("gone").alias("line")).distinct()
    return lines.groupBy("doc_id", "t").agg(F.collect_list("line").alias("gone"))


def find_duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, t, gone``: the line numbers (from 0) to delete; ``t`` is XXH64 of the text."""
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("t"),
        F.col("text").cast("binary").alias("text"),
    )
    every = written(texts.mapInArrow(_lines(min_words), _DOCS), "lines")
    # What is joined with hot keys is written, so that the join deals both sides anew and can split them.
    first = F.min(F.struct("doc_id", "t")).alias("first")
    copied = every.join(written(every.groupBy("s", "z").agg(first), "first-copies"), ["s", "z"])
    is_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    copies = copied.filter(~is_first).select("doc_id", "t", F.col("pos").alias("gone"))
    documents = written(
        copied.filter(is_first).select("doc_id", "t", "lines", "n_words", "pos").dropDuplicates(["doc_id", "t"]), "documents"
    )

    runs = written(documents.select("doc_id", "t", "lines", "n_words").mapInArrow(_runs(min_words), _RUNS), "runs")
    holders = written(
        runs.groupBy("h", "g")
        .agg(first, F.max(F.struct("doc_id", "t")).alias("last"), F.count("*").alias("n"))
        .filter(F.col("first") != F.col("last"))
        .drop("last"),
        "first-holders",
    )
    shared = written(runs.join(holders, ["h", "g"]), "shared-runs")
    later = shared.filter(~is_first).select("doc_id", "t", "a", "b", "h", "g", "n", "first")
    ways = shared.count()
    pairs = later.select("doc_id", "t", F.col("first.doc_id").alias("p_doc"), F.col("first.t").alias("p_t")).distinct()
    gone = written(_union(_aligned(written(pairs, "pairs-0"), documents, min_words)), "gone-0")
    dealt = F.pmod(F.xxhash64("p_doc", "p_t"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    step = 0
    while True:
        step += 1
        kept = F.exists(F.sequence("a", "b"), lambda i: ~F.array_contains("gone", i))
        later = written(
            later.join(gone, ["doc_id", "t"], "left").filter(F.col("gone").isNull() | kept).drop("gone"), f"open-{step}"
        )
        left = later.agg(F.sum("n").alias("ways"), F.max("n").alias("most")).first()
        if not left.ways:
            break
        whole = left.ways <= ways or 1 << step >= left.most
        tried = F.lit(True) if whole else dealt * F.col("n") < float(1 << step)
        partners = (
            shared.select("h", "g", "n", F.col("doc_id").alias("p_doc"), F.col("t").alias("p_t"))
            .filter(tried)
            .select("h", "g", "p_doc", "p_t")
            .distinct()
        )
        before = (F.col("p_doc") < F.col("doc_id")) | ((F.col("p_doc") == F.col("doc_id")) & (F.col("p_t") < F.col("t")))
        pairs = later.join(partners, ["h", "g"]).filter(before).select("doc_id", "t", "p_doc", "p_t").distinct()
        found = _aligned(written(pairs, f"pairs-{step}"), documents, min_words)
        gone = written(_union(gone.unionByName(found)), f"gone-{step}")
        if whole:
            break
    at = F.array_sort(F.transform("gone", lambda i: F.col("pos")[i]))
    cut = documents.select("doc_id", "t", "pos").join(gone, ["doc_id", "t"]).select("doc_id", "t", at.alias("gone"))
    return cut.unionByName(copies.dropDuplicates(["doc_id", "t"]))


def _remaining(text: Column, gone: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of ``docs`` as ``__row`` with ``kept_text``, ``n_deleted`` lines and ``emptied``.

    ``emptied`` tells that deletions left no line with a word.
    """
    gone = written(find_duplicate_lines(docs, min_words), "deleted-lines").select(
        F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.col("gone").alias("__gone")
    )
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    row = F.col("__row")
    joined = rows.join(gone, (row["doc_id"].cast("long") == F.col("__d")) & (F.xxhash64(row["text"]) == F.col("__t")), "left")
    left = _remaining(row["text"], F.col("__gone"))
    return joined.select(
        "__row", left.alias("kept_text"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_deleted")
    ).withColumn("emptied", (F.col("n_deleted") > 0) & (F.btrim("kept_text", F.lit(BLANKS)) == ""))


def drop_duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with shortened texts; documents of which nothing is left go. ``n_chars`` follows the text."""
    done = dedup_lines(docs, min_words).filter(~F.col("emptied"))
    columns = []
    for c in docs.columns:
        new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema[c].dataType)}.get(c)
        columns.append((F.col("__row")[c] if new is None else new).alias(c))
    return done.select(*columns)
