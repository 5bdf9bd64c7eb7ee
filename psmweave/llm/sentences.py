"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are cut into marked words. The distinct words of a chunk are sorted, which walks the trie of all
words depth first: the forward table of a word is kept up to the prefix it shares with the next one,
so every trie node is computed once.

A node's entry is the last piece of the best segmentation of its prefix:

* unigram models: the piece with the highest total score (Viterbi);
* byte-pair models: the pieces of a text are found by merging, not by adding up scores, so a highest
  sum would give other pieces than the model defines. The last piece of a prefix is the one piece
  that the merges leave standing beside the last piece before it: a sequence is what merging gives
  exactly if each pair of neighbours is. The forward pass keeps that piece, which also depends on the
  prefix alone, and gives the library's ids.

Defined results: null and empty texts give no ids; decoding gives back the text (a literal mark comes
back as a blank, and runs of blanks as the model's normalisation leaves them); rows are encoded one by
one, so repeated rows and null ids need nothing special; other columns are not read by ``encode``.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psmweave.llm import pieces
from psmweave.llm.pieces import BPE, MARK, Vocabulary

#: Characters of text handled at once, and encoded words a worker remembers between chunks.
CHUNK = 4_000_000
REMEMBERED = 600_000


def merged(text: str, ranks: dict[str, int]) -> list[str]:
    """Pieces of a short text by merging the lowest-ranked neighbours, the leftmost first."""
    parts = list(text)
    while len(parts) > 1:
        best, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Forward:
    """Forward table of the current word; entry i describes the prefix of i characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.word = ""
        self.length = [0]  # of the last piece
        self.score = [0.0]
        self.beside: dict[tuple[str, str], bool] = {}
        self.extend = self._extend_merges if vocabulary.model_type == BPE else self._extend_scores
        self.floor = min(vocabulary.scores.values(), default=0.0) - 10.0

    def _extend_scores(self, word: str, start: int) -> None:
        scores, length, score, longest = self.v.scores, self.length, self.score, self.v.longest
        for i in range(start, len(word) + 1):
            best, size = score[i - 1] + self.floor, 1
            for n in range(1, min(longest, i) + 1):
                s = scores.get(word[i - n : i])
                if s is not None and score[i - n] + s > best:
                    best, size = score[i - n] + s, n
            length.append(size)
            score.append(best)

    def _extend_merges(self, word: str, start: int) -> None:
        ids, length, beside, lengths = self.v.ids, self.length, self.beside, self.v.lengths
        for i in range(start, len(word) + 1):
            size = 1
            for n in lengths.get(word[i - 2 : i], ()) if i > 1 else ():
                if n <= i and (piece := word[i - n : i]) in ids:
                    pair = (word[i - n - length[i - n] : i - n], piece)
                    fits = beside.get(pair)
                    if fits is None:
                        fits = beside[pair] = merged(pair[0] + piece, self.v.ranks) == [p for p in pair if p]
                    if fits:
                        size = n
                        break
            length.append(size)
        if len(beside) > REMEMBERED:
            beside.clear()

    def pieces(self, word: str) -> list[str]:
        """Pieces of ``word``, computing only the prefixes it doesn't share with the word before."""
        shared = 0
        for a, b in zip(self.word, word):
            if a != b:
                break
            shared += 1
        del self.length[shared + 1 :], self.score[shared + 1 :]
        self.extend(word, shared + 1)
        self.word = word
        out, i, length = [], len(word), self.length
        while i:
            out.append(word[i - length[i] : i])
            i -= length[i]
        return out[::-1]


def encode_words(words: Iterable[str], forward: Forward) -> dict[str, bytes]:
    """Ids (32-bit integers, packed) of each distinct word, walking the words in sorted order."""
    ids, fallback = forward.v.ids, forward.v.fallback
    return {
        w: array("i", [x for p in forward.pieces(w) for x in ((ids[p],) if p in ids else fallback(p))]).tobytes()
        for w in sorted(set(words))
    }


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """Whole texts in lists of about ``CHUNK`` characters."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


_KNOWN: dict[bytes, tuple[Forward, dict[str, bytes]]] = {}


def _tools(model: bytes) -> tuple[Forward, dict[str, bytes]]:
    if model not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model] = Forward(pieces.loaded(model)), {}
    return _KNOWN[model]


def encode_texts(texts: list[str | None], model: bytes) -> Iterator[np.ndarray]:
    forward, known = _tools(model)
    for part in chunks(texts):
        cut = [forward.v.marked_words(t) for t in part]
        new = set(chain.from_iterable(cut)).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(chain.from_iterable(cut))
        known.update(encode_words(new, forward))
        get = known.__getitem__
        for w in cut:
            yield np.frombuffer(b"".join(map(get, w)), np.int32)


def decode_ids(ids: Iterable[int], v: Vocabulary) -> str:
    """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
    text = b"".join(map(v.spelled.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
    return text[1:] if v.dummy_prefix and text.startswith(" ") else text


def _list_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``CHUNK`` bytes of text, so that results stay small."""
    sizes = np.cumsum([len(t) if t is not None else 0 for t in batch.column(text).to_pylist()])
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + CHUNK, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _encoder(model: Callable[[], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                ids = list(encode_texts(batch.column(1).to_pylist(), model()))
                yield pa.RecordBatch.from_arrays([batch.column(0), _list_array(ids)], names=["doc_id", "ids"])

    return run


def _decoder(model: Callable[[], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces.loaded(model())
        for batch in batches:
            text = [None if x is None else decode_ids(x, v) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return run


def _shared_model(df: DataFrame, path: str | None) -> Callable[[], bytes]:
    """The model file (under a megabyte, whatever the data) for every worker."""
    sent = df.sparkSession.sparkContext.broadcast(pieces.read_model(path or pieces.default_path()))
    return lambda: sent.value


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, ids`` for every row."""
    model = _shared_model(docs, model_path)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoder(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, text`` for every row of ``doc_id, ids``; null ids give null."""
    model = _shared_model(encoded, model_path)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_decoder(model), "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, exact`` for every row; ``exact`` tells whether decoding gives the text back.

    A text with a literal mark or with blanks that the model squeezes cannot come back exactly.
    """
    model = _shared_model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces.loaded(model())
        for whole in batches:
            for batch in _slices(whole, 1):
                texts = batch.column(1).to_pylist()
                ids = list(encode_texts(texts, model()))
                exact = [decode_ids(i.tolist(), v) == (t or "") for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), _list_array(ids), pa.array([len(i) for i in ids], pa.int64()), pa.array(exact, pa.bool_())],
                    names=["doc_id", "ids", "n_tokens", "exact"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, ids array<int>, n_tokens long, exact boolean"
    )
