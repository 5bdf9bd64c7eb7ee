import duckdb
from helpers import ODD, documents

from psmweave.llm import quality
from psmweave.llm.queries import ORACLES, QUERIES
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op10_quality_rules"](spark, SF)
    res = con.execute(ORACLES["op10_quality_rules"])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())


def _figures(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in quality.SYMBOLS for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def test_figures_by_brute_force(spark):
    texts = [
        "a b c d e a b c d e", "a a a a a a a", "x\nx\n\nx\ny", "#* $%& |<> 9", "a b c d e f a b c d e f g a b c d e",
        *(t for _, t in ODD if t is None or len(t) < 1000),
    ]
    got = quality.quality_digest(documents(spark, texts, ["words", "kept", "n_words"])).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _figures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_odd_rows_and_columns(spark):
    docs = documents(spark, ODD, ["words", "rejected_by"])
    assert quality.quality_digest(docs).count() == len(ODD)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 5]
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_order_changes_only_the_name(spark):
    docs = documents(spark, ["a!! " * 30, "# # # # # # # # # # # #", "good words stand here in a row that no rule rejects at all"])
    names = {r["__row"].doc_id: r.rejected_by for r in quality.judge(docs).collect()}
    assert names[2] is None and names[0] and names[1]


def _order(docs, *rules):
    found = quality.estimate(docs, quality.words(docs["text"]), lambda tokens: rules)
    return [e.rule.name for e in found]


def test_best_rule_comes_first(spark):
    docs = documents(spark, ["short", "also short", "one two three four five six seven eight nine ten"])
    text = docs["text"]
    assert _order(docs, quality.Rule("never", text.isNull()), quality.Rule("often", ~text.contains("ten"))) == ["often", "never"]
    assert sorted(_order(docs.limit(0), quality.Rule("a", text.isNull()), quality.Rule("b", text == ""))) == ["a", "b"]


def test_a_cheap_rule_comes_before_a_dear_one_on_every_run(spark):
    docs = documents(spark, [f"some words of row {i} " * 40 for i in range(200)] + ["x" * 40] * 50)
    text = docs["text"]
    dear = quality.Rule("dear", quality.F.size(quality.F.filter(quality.F.split(text, ""), lambda c: c.endswith("x"))) > 20)
    middling = quality.Rule("middling", quality.n_of(text, "x") > 20)
    cheap = quality.Rule("cheap", text.startswith("xx"))
    for _ in range(3):
        assert _order(docs, dear, middling, cheap) == ["cheap", "middling", "dear"]
        assert _order(docs, cheap, dear, middling) == ["cheap", "middling", "dear"]
