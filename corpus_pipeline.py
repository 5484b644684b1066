"""A corpus pipeline: quality rules, near-dedup, secret scan, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet in the shared
folder and reads them again for the next; these tables stay there until the folder is cleared. All
but the last return the columns of documents. Other columns of the input pass through every stage unchanged, whatever their names.

Nulls, empty and very long texts, ties, repeated rows and empty tables are taken as each operator's module states: null
and empty texts fail the base rules and go in the first stage; repeated rows and rows of near-equal texts leave one; rows
that share a doc_id but not a text are told apart; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlens.llm import mixing, pieces, quality_rules, secrets, simhash
from strandlens.llm.store import keep, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def carried(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`stage` over the columns of documents, with all others in one struct that no operator's columns clash with."""
    others = [c for c in docs.columns if c not in COLUMNS]
    if not others:
        return stage(docs).select(docs.columns)
    own = [c for c in docs.columns if c in COLUMNS]
    packed = docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in others]).alias("__others"))
    return stage(packed).select(*own, "__others.*").select([F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts have no words and go; each row is judged for itself."""
    labels = table(spark, sf_dir, "labels")
    return carried(docs, lambda d: quality_rules.apply_rules(d, labels).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the row of smallest doc_id, null ids last.
    Rows of one doc_id with different texts are different documents, and all stay."""
    return simhash.drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted again where some were; null texts stay null."""
    rules, parts = secrets.learn(docs)

    def stage(d: DataFrame) -> DataFrame:
        found = secrets.scan(d, rules, parts=parts)
        chars = F.when(F.size("secrets") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
        return found.withColumn("n_chars", chars).withColumn("text", F.col("redacted"))

    return carried(docs, stage)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that the languages' expected words have their target shares of as many
    words as there are. A document of rate 1.4 is there once or twice, one of rate 0.6 once or not at all, by a hash of its id;
    copies repeat the row as it is, as documents have no column for a copy's number."""
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    domains = mixing.learn(docs, labelled, sorted(mixing.TARGETS))
    return carried(docs, lambda d: mixing.copies(mixing.mix(d, domains, mixing.TARGETS)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, n_tokens and round_trip, with its columns but the text; an input column by such a name is
    called input_<name> then."""
    clash = {c: f"input_{c}" for c in ("ids", "n_tokens", "round_trip") if c in docs.columns}
    docs = docs.withColumnsRenamed(clash)
    return pieces.encode_texts(docs, carry=[c for c in docs.columns if c != "text"])


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing to target weights", mixed),
    ("SentencePiece encoding", encoded),
]

#: Fingerprints, the forest, the regression and the pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
