"""Rows for the edge cases of every operator."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    """Documents with nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    passage = " ".join(f"shared{i}" for i in range(30))
    return [
        (1, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", "de", None, 0),
        (4, " \t\n ", None, "b", 3),
        (5, long, "en", "a", len(long)),
        (6, passage + " tail one", "fr", "b", 5),
        (7, "head " + passage + " " + passage, "fr", "b", 5),
        (8, "12 34 !!", "de", "b", 5),
        (9, "der schnelle braune Fuchs springt über den faulen Hund und läuft weg", "de", "c", 5),
        (9, "der schnelle braune Fuchs springt über den faulen Hund und läuft weg", "de", "c", 5),
        (None, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a", 1),
        (10, "The Quick brown fox jumps over the lazy dog and runs away from here", "en", None, 1),
        (11, "单词 δοκιμή слово", None, "c", 1),
    ]


# Names that the operators use inside; they must not collide with columns of the input.
CLASHING = ["slice", "t", "h", "fp", "rep", "size", "k0", "part", "row_no", "place", "first_id", "keep", "v", "slot", "shard"]


def edge_docs(spark, rows=None, clashing=True):
    df = spark.createDataFrame(edge_rows() if rows is None else rows, DOCS)
    for i, c in enumerate(CLASHING if clashing else []):
        df = df.withColumn(c, F.lit(None if i % 3 == 0 else i).cast("string"))
    return df
