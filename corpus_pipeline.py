"""A corpus pipeline: identify languages, take out repeated lines, keep one
document of each group of near copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir), works on all documents of the stage
before and returns the columns of ``documents``; the last adds ``ids``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.llm import jaccard, language, lines, mixing, pieces, sieve
from voltrail.llm.text import table
from voltrail.session import scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No stage of this pipeline is one SQL statement over the whole.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language - no text, no letters - go; a missing
    ``lang`` becomes the identified one."""
    sieve.release()  # the stage before is written
    model = language.Languages.fit(docs.filter(~language.held_out()))
    found = language.identified(docs, model)
    named = found.filter(F.col("lang_pred") != language.UNDETERMINED)
    return named.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document all of whose words they were."""
    sieve.release()  # the stage before is written
    left = lines.without_repeats(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return _sized(left.filter(~emptied))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id."""
    sieve.release()  # the stage before is written
    return jaccard.one_of_each_group(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its draw say."""
    sieve.release()  # the stage before is written
    return mixing.mix(docs).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with the ids of every text."""
    sieve.release()  # the stage before is written
    return pieces.with_ids(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", join_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
