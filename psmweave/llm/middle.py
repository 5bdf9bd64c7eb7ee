"""Fill-in-the-middle transformation with cuts found in compressed boundary sets.

The boundaries of a text are the byte offsets at which its units (code points) begin. They are kept as in
a Roaring bitmap: per 65,536 bytes one container, of the kind that is smallest there (sorted offsets, a
bitmap, or runs), and the number of boundaries before each container. A cut after k units is the k-th
boundary: the container is found in the cumulated numbers, the place inside it by the container itself.

Cuts, kind and order of the parts come from the SHA-256 of the ``doc_id``, so every run gives the same.
Bytes are cut and joined by Spark; Python only finds the offsets.

Defined results: null counts as the empty text; empty texts and texts with a marker stay plain; a null
``doc_id`` is hashed as an empty string; every row gets a row, also repeated ones; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16

PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = "<P>", "<S>", "<M>"


class _Array:
    """Sorted offsets, two bytes each."""

    def __init__(self, mask: np.ndarray) -> None:
        self.offsets = np.flatnonzero(mask).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.offsets[k])


class _Bitmap:
    """One bit per offset, and the number of boundaries before each 64 bytes of bits."""

    STEP = 64

    def __init__(self, mask: np.ndarray) -> None:
        self.bits = np.packbits(mask, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(self.bits).astype(np.int64), np.arange(0, len(self.bits), self.STEP))
        self.before = np.concatenate(([0], np.cumsum(counts)))

    def select(self, k: int) -> int:
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        low = block * self.STEP
        inside = np.flatnonzero(np.unpackbits(self.bits[low : low + self.STEP], bitorder="little"))
        return low * 8 + int(inside[k - self.before[block]])


class _Runs:
    """Stretches of neighbouring offsets: where each begins, and the number of boundaries before it."""

    def __init__(self, starts: np.ndarray, stops: np.ndarray) -> None:
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate(([0], np.cumsum(stops - starts)))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def _container(mask: np.ndarray) -> _Array | _Bitmap | _Runs:
    """The smallest kind of container for the boundaries of a chunk."""
    change = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    starts, stops = change[::2], change[1::2]
    sizes = {_Runs: 4 * len(starts), _Array: 2 * int((stops - starts).sum()), _Bitmap: CHUNK // 8}
    kind = min(sizes, key=sizes.__getitem__)
    return _Runs(starts, stops) if kind is _Runs else kind(mask)


class Boundaries:
    """The set of offsets at which the code points of a UTF-8 text begin."""

    def __init__(self, text: bytes | pa.Buffer) -> None:
        data = np.frombuffer(text, np.uint8) if len(text) else np.empty(0, np.uint8)
        self.size = len(data)
        self.containers: list[_Array | _Bitmap | _Runs] = []
        counts = [0]
        for at in range(0, self.size, CHUNK):
            mask = (data[at : at + CHUNK] & 0xC0) != 0x80
            self.containers.append(_container(mask))
            counts.append(int(np.count_nonzero(mask)))
        self.before = np.cumsum(counts)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """Byte offset behind the first ``k`` units."""
        if k >= len(self):
            return self.size
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        return c * CHUNK + self.containers[c].select(k - int(self.before[c]))


_CUTS = pa.schema([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        named = dict(zip(batch.schema.names, batch.columns))
        rows = []
        for text, h1, h2 in zip(named["text"], named["h1"].to_pylist(), named["h2"].to_pylist()):
            marks = Boundaries(text.as_buffer())
            n = len(marks)
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            rows.append((n, a, b, marks.select(a), marks.select(b)))
        cuts = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(_CUTS)
        yield pa.RecordBatch.from_arrays([*batch.columns, *cuts], names=[*batch.schema.names, *_CUTS.names])


def _draws(doc_id: Column) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the hash of an id, as numbers."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _joined(form: Column) -> Column:
    """The output as bytes, from the text's bytes and the offsets of the cuts."""
    text = F.col("text")
    prefix = F.substring(text, F.lit(1), F.col("from").cast("int"))
    middle = F.substring(text, F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int"))
    suffix = F.substring(text, F.col("to").cast("int") + 1, F.octet_length(text))
    p, s, m = (F.lit(x).cast("binary") for x in (PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK))
    return (
        F.when(form == "plain", text)
        .when(form == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )


def transform(docs: DataFrame, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row; shares are in percent."""
    text = F.coalesce(docs["text"], F.lit(""))
    marked = text == ""
    for mark in (PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK):
        marked = marked | F.contains(text, F.lit(mark))
    h1, h2, h3, h4 = _draws(docs["doc_id"])
    form = (
        F.when(marked | (h3 % 100 >= 100 - plain_share), F.lit("plain"))
        .when(h4 % 100 < spm_share, F.lit("spm"))
        .otherwise(F.lit("psm"))
    )
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), text.cast("binary").alias("text"), form.alias("form"),
        h1.alias("h1"), h2.alias("h2"),
    )
    kinds = "doc_id long, text binary, form string, h1 long, h2 long, n long, first long, second long, `from` long, `to` long"
    cut = F.col("form") != "plain"
    return rows.mapInArrow(_cut, kinds).select(
        "doc_id", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"),
        F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"),
        _joined(F.col("form")).cast("string").alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from; parts hold no marker, so the first of each kind is ours."""
    width = F.lit(3)

    def parts(first: str) -> tuple[Column, Column, Column]:
        """What stands behind the first marker, behind the second and behind the last."""
        whole = F.substr(output, width + 1)
        one = F.substring_index(whole, first, 1)
        rest = F.substr(whole, F.length(one) + width + 1)
        two = F.substring_index(rest, MIDDLE_MARK, 1)
        return one, two, F.substr(rest, F.length(two) + width + 1)

    prefix, suffix, middle = parts(SUFFIX_MARK)
    suffix_2, prefix_2, middle_2 = parts(PREFIX_MARK)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(prefix_2, middle_2, suffix_2))
    )


def digest(transformed: DataFrame) -> DataFrame:
    """Hashes of every output and of the text rebuilt from it, instead of the output itself."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
