import random

import sentencepiece
from helpers import ODD, documents

from psmweave.llm import pieces, sentences, tokencount

MODEL = pieces.read_model(pieces.default_path())
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def _texts():
    r = random.Random(7)
    v = pieces.loaded(MODEL)
    letters = "ab ce  ▁\n\tñ漢😀<s>0x\x00́Az.,\r"
    return (
        ["", " ", "   ", "\n", "x" * 3000, "a b " * 2000, "<unk></s>"]
        + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(800)]
        + ["".join(r.choice(v.strings[259:]) for _ in range(20)) for _ in range(800)]
    )


def test_ids_and_counts_equal_the_library():
    texts = _texts()
    want = LIBRARY.encode(texts)
    assert [x.tolist() for x in sentences.encode_texts(texts, MODEL)] == want
    assert list(tokencount.count_texts(texts, MODEL)) == [len(x) for x in want]


def test_decoding_gives_the_text_back():
    v = pieces.loaded(MODEL)
    texts = _texts()
    for text, ids in zip(texts, sentences.encode_texts(texts, MODEL), strict=True):
        assert sentences.decode_ids(ids.tolist(), v) == text.replace("▁", " ") == LIBRARY.decode(ids.tolist())


def test_shared_prefixes_are_computed_once():
    forward = sentences.Forward(pieces.loaded(MODEL))
    steps = []
    extend = forward.extend
    forward.extend = lambda word, start: (steps.append(len(word) + 1 - start), extend(word, start))
    sentences.encode_words(["▁there", "▁the", "▁therefore"], forward)
    assert sum(steps) == len("▁therefore")


def test_unigram_models_by_brute_force():
    scores = {"▁": -2.0, "a": -1.5, "b": -1.0, "ab": -2.2, "▁a": -2.9, "ba": -1.7, "▁ab": -6.0, "aa": -2.0}
    v = pieces.Vocabulary(
        ids={p: i + 1 for i, p in enumerate(scores)}, scores=scores, strings=["<unk>", *scores], kinds=[2, *[1] * len(scores)]
    )

    def best(word):
        if not word:
            return 0.0
        return max(scores[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in scores)

    forward = sentences.Forward(v)
    r = random.Random(1)
    for word in sorted("▁" + "".join(r.choice("ab") for _ in range(r.randint(0, 9))) for _ in range(300)):
        found = forward.pieces(word)
        assert "".join(found) == word
        assert abs(sum(scores[p] for p in found) - best(word)) < 1e-9


def test_odd_rows(spark):
    docs = documents(spark, ODD, ["ids", "n_tokens"])
    done = sentences.round_trip(docs).collect()
    assert len(done) == len(ODD)
    assert all(r.exact or "▁" in t for r, (_, t) in zip(done, ODD, strict=True))
    assert [r.n_tokens for r in tokencount.count_tokens(docs).collect()] == [r.n_tokens for r in done]
    back = sentences.decode(sentences.encode(docs))
    assert [r.text for r in back.collect()] == [(t or "").replace("▁", " ") for _, t in ODD]
    assert sentences.round_trip(docs.limit(0)).count() == tokencount.count_tokens(docs.limit(0)).count() == 0


def test_query_equals_the_library(spark):
    from psmweave.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_token_counts"](spark, sf).collect():
        n = len(LIBRARY.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    for r in QUERIES["op6_sentencepiece"](spark, sf).collect():
        assert r.ids == LIBRARY.encode(texts[r.doc_id]) and r.exact
