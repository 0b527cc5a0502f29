"""A training-data pipeline over `documents`: language, copies, near copies, source mix, token ids.

run(spark, sf_dir) applies STAGES in order. Each stage's rows are written to the shared folder as Parquet and read
again as the next one's docs. All but the last return the columns of docs.

Stages decide by row: each gives rows keys of its own, so null and repeated doc_ids are rows like any other."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.bpe import round_trip
from granary.llm.common import documents, if_small, materialise
from granary.llm.exact import exact_duplicates
from granary.llm.language import held_out, known_language, train_language_trees
from granary.llm.mixing import mix_sources, word_count
from granary.llm.simhash import near_copies


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row, and `_place`, which orders rows: by doc_id, null last, then by content.

    The key is the row's place in its Parquet file, so every scan gives the same one and no copy is written. Where docs
    is not such a table, or a row of a file stands in it more than once, it is written first."""
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        plain = docs.select(*at).groupBy("_file", "_at").count().where("count > 1").isEmpty()
    except AnalysisException:  # the plan has no file's rows to name
        plain = False
    docs = docs if plain else materialise(docs, "rows")
    files = sorted(r[0] for r in docs.select(at[0]).distinct().collect())  # file names, as Spark's own listing has them
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "_number long, _file string")
    keyed = docs.select("*", *at).join(F.broadcast(numbers), "_file")
    keyed = keyed.withColumn("_row", F.shiftleft("_number", 40) + F.col("_at"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*docs.columns).alias("content"), "_row")
    return keyed.select(*docs.columns, "_row", place.alias("_place"))


def _without(keyed: DataFrame, rows: DataFrame) -> DataFrame:
    """keyed without some rows. They are few and narrow, so whole texts are shuffled only where they are very many."""
    return keyed.join(if_small(materialise(rows, "dropped")), "_row", "left_anti").drop("_row", "_place")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those that no learned language's model compresses (see known_language).

    Each row is judged by its whole text alone, however long, so null and repeated doc_ids and repeated rows make no
    difference, and equal texts share their fate; null and empty texts go. An empty table gives no rows. Other columns
    are kept and not read."""
    return known_language(docs, train_language_trees(docs.where(~held_out(4, 2))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows of equal texts (null as empty), one of smallest doc_id stays; one without doc_id only where none has
    any. Ties are settled by content, then by row, so repeated rows leave one. Texts are compared whole, however long.
    An empty table gives no rows. Other columns are kept."""
    keyed = _keyed(docs)
    return _without(keyed, exact_duplicates(keyed, "_place").where("not kept").select("doc_id._row"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links of Jaccard similarity 0.8 or more over five-word shingles, found by SimHash, a row of
    smallest doc_id stays; one without doc_id only where none has any. Wordless and null texts are one group. Repeated rows leave one; texts are read
    whole, however long. An empty table gives no rows. Other columns are kept."""
    keyed = _keyed(docs)
    found = near_copies(keyed, "_row").withColumnRenamed("doc_id", "_row")
    found = materialise(found.join(keyed.select("_row", "_place"), "_row"), "near-places")
    first = found.groupBy("component_id").agg(F.min("_place").alias("first"))
    return _without(keyed, found.join(first, "component_id").where("_place <> first").select("_row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights, as many words as came in; a row stands there as often as it is used.

    Rows are dealt by doc_id, content and number among equal rows, so the result doesn't depend on where rows lie, and
    each of repeated rows is a row of its own, null doc_ids included. Null and empty sources are one source; one without
    any word is not used, and texts without words come along with their block. A text that is longer than what is left
    of a quota is left out, not cut. An empty table gives no rows."""
    keyed = _keyed(docs)
    narrow = keyed.select("_row", "source", word_count(F.col("text")).alias("n_words"), "_place.no_id", "doc_id", "_place.content")
    number = F.row_number().over(Window.partitionBy("no_id", "doc_id", "content").orderBy("_row"))
    narrow = materialise(narrow.select("_row", "source", "n_words", F.struct("no_id", "doc_id", "content", number.alias("number")).alias("key")), "mix-keys")
    used = mix_sources(narrow, id_col="key", tokens=F.col("n_words")).select(F.col("doc_id").alias("key"))
    rows = used.join(narrow.select("key", "_row"), "key").select("_row")
    return keyed.join(rows, "_row").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row: repeated rows and null doc_ids give a row each,
    null texts count as empty ones, texts are encoded whole, however long. An empty table gives no rows."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: SQL expresses neither the language models, nor the near copies, nor the mix, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
