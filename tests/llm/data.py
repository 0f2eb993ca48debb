"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(x, T.StringType()) for x in ("id", "t", "key", "hash", "fp", "words", "n")]])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "stone", "river", "and", "light", "cold", "walk", "ember", "night", "a", "sings", "hollow", "field"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (30, 60, 120, 200, 45)]
    texts = [None, "", "   \n\t", "one", "one two three", "ÉÀ ünï ÇOde straße 日本 🎉", *base, base[1], base[1], base[2] + " tail", base[3].replace("river", "rivers", 1), "x" * 3000, "a b " * 2000, base[0] + "\n" + base[4], "the the the the the the the the the the the the the the the"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", None]), None, *["clash"] * 7) for i, t in enumerate(texts)]
    return [*out, out[7], (None, base[2], "en", "src0", 1, *["clash"] * 7)]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else [(*r, *[None] * (12 - len(r))) for r in some], DOCS)
