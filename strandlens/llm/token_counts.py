"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Each whole text is encoded (byte-level merges of a public vocabulary, no special tokens); documents are counted by
their encoded length. Sums over all longer lengths answer, for every context limit: how many documents and tokens
reach it, the tokens left after truncation, and quantiles. Null texts are not counted; an empty text has length 0; an
empty table gives an empty histogram. Rows that repeat count as often as they occur; equal lengths share a row; only the
text column is read, so other columns can't clash. Texts are encoded once: the counts by length, a row for each length
that occurs, are written and read again. The sums run in blocks of BLOCK lengths with block totals carried over, so no task
holds more than one block of lengths or one row a block (the longest text's tokens / BLOCK rows, however many texts).
"""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandlens.llm import text as tx
from strandlens.llm.store import keep, table

BLOCK = 256


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(path: str, pattern: str | None = None):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, text: str = "text", ranks: str | None = None) -> DataFrame:
    """Column n_tokens, one row for each non-null text."""
    path = ranks or default_ranks()

    def count(batches):
        encode = encoding(path).encode_ordinary
        for part in tx.steps(batches, "text"):
            yield pa.record_batch([pa.array([len(encode(x)) for x in part.column("text").to_pylist()], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).filter("text IS NOT NULL").mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row for each length that occurs: n_docs; docs_at_least and tokens_at_least (suffix sums); docs_at_most;
    truncated_tokens, the total when every document is cut to n_tokens; share_at_most, the length's quantile."""
    counts = keep(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths").withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / F.lit(BLOCK)))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(x).over(longer), F.lit(0)).alias(f"{x}_longer") for x in "dt"], *[F.sum(x).over(every).alias(f"{x}_all") for x in "dt"])
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.join(blocks, "block")
    out = out.withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("d_longer")).withColumn("tokens_at_least", F.sum("tokens").over(within) + F.col("t_longer"))
    shorter = F.col("t_all") - F.col("tokens_at_least")
    at_most = F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", at_most.alias("docs_at_most"),
                      (shorter + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"), (at_most / F.col("d_all")).alias("share_at_most"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens left when every document is cut to `limit`, which needn't occur as a length. Of the suffix sums
    that counts: those of the smallest length from `limit` on."""
    longer = lambda x: F.coalesce(F.max(F.when(F.col("n_tokens") >= limit, F.col(x))), F.lit(0))  # noqa: E731  suffix sums fall with the length
    total = F.coalesce(F.max("tokens_at_least"), F.lit(0))
    return histogram.agg((total - longer("tokens_at_least") + F.lit(limit) * longer("docs_at_least")).alias("truncated_tokens"))


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least `share` of the documents don't exceed (null for an empty table)."""
    return histogram.filter(F.col("share_at_most") >= F.lit(share)).agg(F.min("n_tokens").alias("n_tokens"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
