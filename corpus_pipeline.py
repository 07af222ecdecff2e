"""A corpus made ready for training, in five stages over ``documents``.

Each stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared
folder and read again as the next stage's docs. All but the last return the columns of documents.

1. language: documents of no learned language, or of too uncertain a one, go.
2. near copies: of the rows of each group of links one with an id stays, that with the smallest, and one of those without an
   id. Where the smallest id repeats with other texts of its group, one of them stays. Texts without a word are in no group;
   one of each id and text stays.
3. benchmark: documents that hold a benchmark passage go.
4. secrets: every secret found is replaced by a mark, n_chars is counted anew; the document stays.
5. tokens: each text as token ids, with digests of the ids and of the text decoded from them.

Defined results: null and empty texts go in stage 1, which finds no language in them; an empty table stays empty; further
columns of the documents, whatever their names, pass through the first four stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.llm import bpe, decontaminate, language_id, ngram_join, secret_scan
from shelfsight.llm.common import held_out, saved, table

#: Share of the evidence that the best language must have.
LEAST_LANGUAGE_SCORE = 0.4


def _shielded(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """The documents under column names that clash with nothing, these names, and that of the text."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~held_out(docs["doc_id"])))
    own, names, text = _shielded(docs)
    found = language_id.predict(own, names, model, text)
    return found.where(language_id.accepted(LEAST_LANGUAGE_SCORE)).select(*names).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names, text = _shielded(docs)
    doc_id = F.col(names[docs.columns.index("doc_id")])
    told = F.concat(
        F.coalesce(F.concat(F.length(doc_id.cast("string")).cast("string"), F.lit(":"), doc_id.cast("string")), F.lit("-")),
        F.coalesce(F.concat(F.lit("t"), F.col(text).cast("string")), F.lit("-")),
    )
    keyed = own.withColumn("_key", F.md5(told.cast("binary")))  # of the id and the text, so that neither nulls nor repeated ids are one key
    rows = ngram_join.rows_in_groups(keyed.select(doc_id.alias("doc_id"), F.col(text).alias("text"), "_key"), more=("_key",))
    group = F.coalesce(F.hex("component"), F.col("_key")).alias("_group")
    staying = rows.groupBy(group, F.col("doc_id").isNull().alias("_unnamed")).agg(F.min(F.struct("doc_id", "_key")).alias("first")).select("first._key")
    # The join has dealt the rows by key already, which also brings repeated rows together.
    return keyed.join(staying, "_key", "left_semi").dropDuplicates(["_key"]).select(*names).toDF(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names, text = _shielded(docs)
    found = decontaminate.find(own, names, table(spark, sf_dir, "benchmark"), text)
    return found.where("n_hit = 0").select(*names).toDF(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names, text = _shielded(docs)
    marked = secret_scan.scan(own, names, text).withColumn(text, secret_scan.redacted(F.col(text), F.col("spans")))
    done = marked.select(*names).toDF(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(docs, ["doc_id"]), ["doc_id", "ids"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Tokens, language scores and links have no statement in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
