"""Token counts of a byte-pair model by merging in a heap over a linked list; no ids are made.

The characters of a marked word form a linked list and its mergeable neighbours a heap by rank, then
place. Popping the lowest, joining it and pushing its new neighbours until the heap is empty leaves the
word's pieces: as many as it had symbols at first, less the merges. A symbol that is no piece counts
as its UTF-8 bytes. A worker remembers the counts of recent words, so a word is merged once for many
occurrences.

Defined results: null and empty texts have no tokens; every row gets a row, so repeated rows and null
ids need nothing special; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psmweave.llm import pieces
from psmweave.llm.sentences import _shared_model, chunks

LIMIT = 4096
REMEMBERED = 400_000


def count_word(word: str, ranks: dict[str, int]) -> int:
    """Tokens of one marked word."""
    n = len(word)
    length = [1] * n  # 0 where the symbol has been joined to the one before
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i, 2) for i in range(n - 1) if (p := word[i : i + 2]) in ranks]
    heapify(heap)
    merges = 0
    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        if not length[i] or j >= n or length[i] + length[j] != size:
            continue  # one of the two has been joined meanwhile
        length[i], length[j] = size, 0
        after[i] = k = after[j]
        merges += 1
        if k < n:
            before[k] = i
            if (r := ranks.get(word[i : k + length[k]])) is not None:
                heappush(heap, (r, i, size + length[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h : i + size])) is not None:
            heappush(heap, (r, h, length[h] + size))
    extra = sum(len(word[i].encode()) - 1 for i in range(n) if length[i] == 1 and word[i] not in ranks)
    return n - merges + extra


_KNOWN: dict[str, int] = {}
_KNOWN_MODEL: list[bytes] = []


def count_texts(texts: list[str | None], model: bytes) -> Iterator[int]:
    v = pieces.loaded(model)
    if v.model_type != pieces.BPE or not v.byte_fallback:
        raise ValueError("counting needs a byte-pair model with byte fallback")
    if _KNOWN_MODEL != [model]:
        _KNOWN.clear()
        _KNOWN_MODEL[:] = [model]
    for part in chunks(texts):
        for text in part:
            words = v.marked_words(text)
            for w in set(words).difference(_KNOWN):
                _KNOWN[w] = count_word(w, v.ranks)
            yield sum(map(_KNOWN.__getitem__, words))
            if len(_KNOWN) > REMEMBERED:
                _KNOWN.clear()


def count_tokens(docs: DataFrame, limit: int = LIMIT, model_path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    model = _shared_model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(list(count_texts(batch.column(2).to_pylist(), model())), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], counts], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    counted = docs.select(
        F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    ).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
