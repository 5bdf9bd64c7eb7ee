"""Protein databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psmweave.functions import peptide as P
from psmweave.sources.files import blocks


#: Database codes of UniProt headers, and ``dn`` for de novo entries.
DATABASES = {"sp": "SwissProt", "tr": "TrEMBL", "dn": "DeNovo"}


def parse_headers(df: DataFrame) -> DataFrame:
    """Fields of the headers in column ``header``.

    A header is ``db|accession|entry description KEY=value KEY=value ...``: its first word is the
    full id, whose parts are separated by bars; the rest is cut in front of every ``KEY=``, and what
    precedes the first is the description. A first word without bars is an id without database and
    accession. Fields that a header lacks are null.
    """
    words = F.split(F.trim("header"), r"\s+", 2)
    parts = F.split(words[0], r"\|")
    cut = df.select("*", parts.alias("_id"), words[0].alias("_first"), F.split(F.get(words, F.lit(1)), r"(?:^|\s+)(?=[A-Za-z]+=)").alias("_rest"))
    listed = F.size("_id") > 2
    names = F.create_map(*[F.lit(x) for kv in DATABASES.items() for x in kv])
    described = F.filter("_rest", lambda x: ~x.rlike("^[A-Za-z]+="))
    pairs = F.filter("_rest", lambda x: x.rlike("^[A-Za-z]+="))
    tags = F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, "=", 1))),
            lambda k: F.struct(k, F.get(F.filter(pairs, lambda x: F.substring_index(x, "=", 1) == k), F.lit(0))),
        )
    )
    tagged = cut.select("*", described.alias("_described"), tags.alias("_tags"))

    def tag(name: str) -> Column:
        return F.substr(F.col("_tags")[name], F.lit(len(name) + 2))

    return tagged.select(
        *df.columns,
        F.when(listed, F.coalesce(names[F.col("_id")[0]], F.lit("Other"))).otherwise("Other").alias("name"),
        F.when(listed, F.col("_id")[1]).alias("protein_id"),
        F.col("_first").alias("protein_id_full"),
        F.nullif(F.get("_described", F.lit(0)), F.lit("")).alias("protein_description"),
        tag("OS").alias("organism"),
        tag("GN").alias("gene_name"),
        tag("PE").alias("protein_existence"),
        tag("SV").alias("sequence_version"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Proteins with parsed headers."""
    # A '>' inside a header would split it, so records start at line breaks only.
    rows = blocks(spark, path, "\n>").filter(F.trim("value") != "")
    text = F.regexp_replace("value", r"^\s*>", "")
    parts = rows.select(
        F.trim(F.regexp_extract(text, r"^([^\r\n]*)", 1)).alias("header"),
        F.regexp_replace(F.regexp_replace(text, r"^[^\r\n]*", ""), r"\s", "").alias("sequence"),
    )
    cols = [
        "name", "protein_id", "protein_id_full", "protein_description", "organism", "gene_name",
        "protein_existence", "sequence_version", "sequence",
    ]
    return parse_headers(parts).select(*cols)


def protein_entries(proteins: DataFrame) -> DataFrame:
    """FASTA text of proteins; empty header fields are left out."""
    fields = [
        ("protein_id_full", ""), ("protein_description", ""), ("organism", "OS="),
        ("gene_name", "GN="), ("protein_existence", "PE="), ("sequence_version", "SV="),
    ]
    header = F.concat_ws(
        " ", *[F.when(F.col(c) != "", F.concat(F.lit(p), F.col(c))) for c, p in fields]
    )
    return proteins.select(F.concat(F.lit(">"), header, F.lit("\n"), _wrapped("sequence")).alias("value"))


def denovo_entries(psms: DataFrame) -> DataFrame:
    """Predictions as ``dn|SEQUENCE|`` entries named after their scan."""
    seq = P.letters("peptide")
    title = F.col("spectrum_id").cast("string")
    scan = F.regexp_extract(title, r"scan=(\d+)", 1)
    header = F.concat(
        F.lit("dn|"), seq, F.lit("| denovo_"), F.when(scan != "", scan).otherwise(title), F.lit(" OS="), F.col("engine")
    )
    return psms.select(F.concat(F.lit(">"), header, F.lit("\n"), _wrapped(seq)).alias("value"))


def _wrapped(sequence: Column | str, width: int = 60) -> Column:
    return F.array_join(F.regexp_extract_all(sequence, F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")


def write_fasta(proteins: DataFrame, path: str, predictions: DataFrame | None = None) -> None:
    """Selected proteins, followed by de novo predictions."""
    out = protein_entries(proteins)
    if predictions is not None:
        out = out.unionByName(denovo_entries(predictions))
    out.write.text(path)
