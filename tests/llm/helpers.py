"""Small documents that hold every awkward case, as DataFrames."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     # names that operators use inside, to clash with
                     T.StructField("id", T.StringType()), T.StructField("key", T.StringType()),
                     T.StructField("_text", T.StringType()), T.StructField("name", T.StringType())])


def docs(spark, rows, schema=DOCS, parts=3):
    """``rows`` of (doc_id, text) or longer; missing columns are filled with odd values."""
    full = [(*r, *[None, "src", "x", "y", "z", "w"][len(r) - 2:]) for r in rows]
    return spark.createDataFrame(full, schema).repartition(parts)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


AWKWARD = [(1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x"), (None, "x y z"), (None, None), (7, "é" * 3000),
           (8, "a b " * 20_000)]
