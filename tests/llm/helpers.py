"""Small tables with what operators must withstand, shared by the tests of this folder."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def documents(spark, texts, extra=()):
    """``documents`` rows from texts or ``(doc_id, text)`` pairs, with extra columns of clashing names."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], DOCS)
    for name in extra:
        df = df.selectExpr("*", f"'own' AS {name}")
    return df


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    (None, "no id at all in this row but quite a few words"), (None, None), (7, "word " * 5000), (8, "x" * 50_000),
    (9, "é ß 漢字 😀     ▁ \x00 <s> </s>"),
]
