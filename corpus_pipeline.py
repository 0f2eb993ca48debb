"""A corpus pipeline of five stages, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs, whatever else these are
called. Rows are judged by doc_id and text, so rows that share an id but not a text have their own
verdicts; a null doc_id comes after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from transitlake.llm import contamination, language, queries, simhash, suffixes
from transitlake.llm.common import private, scratch, stored


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with enough confidence."""
    names = tuple(private(docs, "language", "score", "accepted"))
    return language.predict(docs, language.fit(docs), names=names).where(F.col(names[2])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose five-word shingles have a similarity of 0.8 or more: that of the smallest doc_id, then of the smallest hash of the text, then of all columns."""
    id_, content = private(docs, "id", "content")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(suffixes.LAST)), content: F.xxhash64(text, F.octet_length(text))})
    found = simhash.similar(marked, id_col=id_).toDF("id", "content", "root")
    found = stored(found.groupBy("id", "content", "root").agg(F.count("*").alias("rows")), "similar")
    first = stored(found.groupBy("root").agg(F.min(F.struct("id", "content")).alias("first")), "first")
    by_row = found.join(first, "root").select(F.col("id").alias(id_), F.col("content").alias(content), (F.struct("id", "content") != F.col("first")).alias("again"), "rows")
    by_row = stored(by_row.where("again OR rows > 1"), "again")
    kept = marked.join(by_row.select(id_, content), [id_, content], "left_anti").select(*docs.columns)
    many = by_row.where("NOT again").select(id_, content)
    if many.isEmpty():
        return kept
    one = marked.join(many, [id_, content], "left_semi").groupBy(id_, content).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return kept.unionByName(one.select("row.*"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a document of a smaller id has; documents of which nothing is left go."""
    n_bytes, n_removed, _, kept, _ = suffixes.result_columns(docs)
    done = suffixes.deduplicate(docs, decoded=True).where(F.col(n_removed).eqNullSafe(0) | (F.col(n_removed) < F.col(n_bytes)))
    cut = F.col(n_removed) > 0
    new = {"text": F.when(cut, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(cut, F.length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*[new[c].alias(c) if c in new else c for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with the benchmark."""
    id_, hash_ = private(docs, "id", "hash")
    found = contamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hash_col=hash_)
    bad = stored(found.where(contamination.contaminated()).select(F.col("doc_id").alias(id_), hash_).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (text_hash() == F.col(hash_)), "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text."""
    return queries.token_digests(docs, queries.vocabulary())


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", remove_repeats),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokenize),
]
#: SQL can't express training, XXH64 or merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"stage{i}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    return out
