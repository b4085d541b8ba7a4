import pytest
from pyspark.sql import functions as F


@pytest.fixture
def documents(spark):
    """Makes a documents table with columns that clash with those the operators make."""

    def make(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        clash = {c: F.lit(7) for c in ("kept", "score", "class_id", "selected", "chunk", "key", "doc", "length", "votes")}
        return docs.withColumns(clash)

    return make


#: Two words that a polynomial hash modulo 2 to the 64 takes for equal, whatever its odd base.
MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
TWIN = MORSE.translate({97: 98, 98: 97})

#: Null, empty and blank texts, a long one, repeated rows and a null id.
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Ein kurzer Text."), (4, "Ein kurzer Text."),
    (5, "wort " * 60_000), (6, "x" * 50_000), (None, "no id at all, but some words stand here"),
]


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as the registered queries read them, with columns that clash with those the operators make."""

    def make(**tables):
        for name, df in tables.items():
            clash = {c: F.lit(7) for c in ("kept", "score", "row", "kind", "n", "vector", "start", "instance", "tokens")}
            df.withColumns(clash).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
