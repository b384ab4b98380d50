import os

import pytest
from pyspark.sql import types as T

LONG = "word " * 30_000 + "end"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Missing keys and texts, empty and blank texts, a very long one, repeated rows, lines of other white space, columns with the operators' names."""
    rows = [(1, "alpha beta gamma delta " * 4), (None, "alpha beta gamma delta " * 4), (3, None), (4, ""), (5, " \n\t "),
            (6, LONG), (7, "one  two\tthree\n\nfour "), (7, "one  two\tthree\n\nfour "), (8, "É x　y <|endoftext|> 1 2"), (None, None),
            (9, "one\n\u00a0\n\u3000\n\u0085\n\x1c\x1d\n\x1e \x1f\ntwo")]
    names = ["key", "n_tokens", "kept", "spans", "component_id", "node", "ids", "Block", "row", "number", "maybe", "n_words"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(k, t, "en", None, None if t is None else len(t), *["x"] * len(names)) for k, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def key_of(value):
    return (value is None, value or 0)


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def on_disk(tmp_path, name, df):
    path = os.path.join(tmp_path, f"{name}.parquet")
    df.write.parquet(path)
    return str(tmp_path)
