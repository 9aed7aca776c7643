"""Small tables with the awkward rows every operator must take."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
])


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = "th an er in on re ed nd ou ea ti es or te of is it al ar st".split()
    out = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words)]
    return " ".join(out).replace(" an ", ".\n")


def awkward(spark, **clash: str):
    """Null id, null and empty texts, blanks only, a very long text, copies, repeated rows; columns that may clash."""
    long_one = prose(1, 60_000)
    rows = [
        (1, None, "en"), (2, "", None), (3, " \t\n ", "en"), (4, long_one, "en"), (5, prose(2, 40), "en"), (6, prose(2, 40), "en"),
        (6, prose(2, 40), "en"), (7, prose(3, 3), None), (None, prose(2, 40), "en"), (None, None, None), (8, "é́ ß 日本 \x00\x1c", "de"),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in clash.items():
        df = df.selectExpr("*", f"'{value}' AS `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")
