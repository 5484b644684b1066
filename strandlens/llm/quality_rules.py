"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio of trusted target and raw corpus.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text; null and empty texts have none. A word's hash is its UTF-8 bytes
folded by h * 1000003 + byte modulo 2**31 - 1. One- and two-word sequences fall into `buckets` buckets each. Over all
documents they give the raw multinomial, over trusted ones (labels.quality = 1) the target multinomial. `smooth` is added to
each target count, and as much in proportion to the raw ones, so that n-grams of which nothing is known say nothing, at
any size of either table and for any number of buckets. A document's score is the mean log ratio of its n-grams, from weights rounded to 1e-6 so
that sums are exact and every decision is reproducible; it passes at `threshold` or more.

Null or repeated doc_ids, ties, empty tables and extra columns pass through: each input row gives one output row.
No trusted row at all makes all ratios zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlens.llm import text as tx

WINDOW = 8
BUCKETS = 1 << 18
#: Trusted ids that are broadcast at most (some 30 MB); more meet the texts by a shuffled join, with the same result.
BROADCAST_IDS = 1 << 20
SMOOTH = 4.0
THRESHOLD = -0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Multipliers of the two-word hash (stated in the SQL too).
PAIR = (31_337, 17)
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
UNIT = 1_000_000


def grams(words: tx.Words, buckets: int, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all one-word and two-word sequences, and each one's text; the second kind from `buckets` on."""
    n = len(small)
    owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if n else np.zeros(0, np.int64)
    two = (small[pair] * np.uint64(PAIR[0]) + small[pair + 1] * np.uint64(PAIR[1])) % np.uint64(tx.HASH_MOD)
    ids = np.concatenate([small % np.uint64(buckets), two % np.uint64(buckets) + np.uint64(buckets)]).astype(np.int64)
    return ids, np.concatenate([owner, owner[pair]])


def repeated(words: tx.Words, large: np.ndarray) -> np.ndarray:
    """Marks words in windows of WINDOW words that their text holds twice or more."""
    n = len(large)
    marked = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        owner = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
        odd = tx.powers(0xA0761D6478BD642F, WINDOW + 1)[1:]
        whole = sum(large[j : n - WINDOW + 1 + j] * odd[j] for j in range(WINDOW))
        key = tx.mix(whole) + tx.mix(owner[: n - WINDOW + 1].astype(np.uint64) + np.uint64(1))
        own = np.flatnonzero(owner[WINDOW - 1 :] == owner[: n - WINDOW + 1])
        order = own[np.argsort(key[own], kind="stable")]
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        again = np.zeros(n - WINDOW + 1, bool)
        again[order[same]] = True
        again[order[same + 1]] = True
        at = np.flatnonzero(again)
        np.add.at(marked, at, 1)
        np.add.at(marked, at + WINDOW, -1)
    return np.cumsum(marked[:n]) > 0


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def measures(batch: pa.RecordBatch, column: str) -> tuple[dict[str, np.ndarray], tx.Words, np.ndarray]:
    data, offsets = tx.raw(batch.column(column))
    words = tx.Words(data, offsets)
    small, large = words.hashes()
    lead = (data & 0xC0) != 0x80
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": tx.totals(lead & words.inside, offsets),
        "n_symbols": tx.totals(SYMBOLS[data], offsets),
        "n_dup_lines": np.array([repeated_lines(x) for x in tx.blobs(batch.column(column))], np.int64),
        "n_repeat_words": tx.totals(repeated(words, large), words.bounds),
    }, words, small


def gram_counts(docs: DataFrame, text: str, trusted: str, buckets: int = BUCKETS) -> DataFrame:
    """Columns bucket, n_raw, n_target over all documents; at most 2 * buckets rows. `trusted` names a boolean column."""

    def count(batches):
        n_raw, n_target = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for part in tx.steps(batches, "text"):
            words = tx.Words(*tx.raw(part.column("text")))
            ids, owner = grams(words, buckets, words.hashes()[0])
            n_raw += np.bincount(ids, minlength=2 * buckets)
            good = part.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            n_target += np.bincount(ids[good[owner]], minlength=2 * buckets)
        seen = np.flatnonzero(n_raw)
        yield pa.record_batch([pa.array(seen), pa.array(n_raw[seen]), pa.array(n_target[seen])], names=["bucket", "n_raw", "n_target"])

    part = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(trusted), F.lit(False)).alias("trusted"))
    counted = part.mapInArrow(count, "bucket long, n_raw long, n_target long")
    return counted.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def weights(counts: pa.Table, buckets: int = BUCKETS, smooth: float = SMOOTH) -> np.ndarray:
    """Log ratios in units of 1e-6, one for each bucket; each order of n-gram has its own totals."""
    raw, target = np.zeros(2 * buckets), np.zeros(2 * buckets)
    bucket = counts["bucket"].to_numpy()
    raw[bucket], target[bucket] = counts["n_raw"].to_numpy(), counts["n_target"].to_numpy()
    out = np.zeros(2 * buckets, np.int64)
    for half in (slice(0, buckets), slice(buckets, 2 * buckets)):
        if target[half].sum():
            due = raw[half] * (target[half].sum() / raw[half].sum())
            out[half] = np.round(np.log((target[half] + smooth) / (due + smooth)) * UNIT)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids of all documents of quality 1."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def apply_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD,
                buckets: int = BUCKETS, smooth: float = SMOOTH, carry: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns, `carry` or all) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, llr and kept.

    Columns of `docs` by these names give way to the new ones. Broadcast are 2 * buckets weights, and the trusted ids if
    they are counted as BROADCAST_IDS or fewer; as they grow with the labels, more are joined by a shuffle.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "llr_sum"]
    docs = docs.drop(*made, "base_failed", "llr", "kept")
    ids = trusted_ids(labels).select(F.col("doc_id").alias("trusted_id"), F.lit(True).alias("trusted"))
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    marked = plain.join(ids, F.col("key") == F.col("trusted_id"), "left")
    weight = weights(gram_counts(marked, "text", "trusted", buckets).toArrow(), buckets, smooth)
    shared = docs.sparkSession.sparkContext.broadcast(weight)
    names = docs.columns if carry is None else carry

    def score(batches):
        for part in tx.steps(batches, text):
            out, words, small = measures(part, text)
            ids, owner = grams(words, buckets, small)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
            out["n_grams"] = np.diff(bounds)
            out["llr_sum"] = tx.totals(shared.value[ids[order]], bounds)
            yield pa.record_batch([*(part.column(k) for k in names), *(pa.array(out[k], pa.int64()) for k in made)], names=[*names, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    found = docs.mapInArrow(score, f"{fields}, " + ", ".join(f"{k} long" for k in made))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    llr = F.when(F.col("n_grams") > 0, F.col("llr_sum") / (F.col("n_grams") * F.lit(float(UNIT)))).otherwise(F.lit(0.0))
    return (found.withColumn("base_failed", failed).withColumn("llr", llr)
            .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))).drop("llr_sum"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    from strandlens.llm.store import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_rules(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_grams", "llr")


#: The same rows by DuckDB.
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
h AS (SELECT w, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, octet_length(encode(w))),
             lambda k: ('0x' || substr(hex(encode(w)), (2 * k + 1)::INT, 2))::BIGINT)), lambda a, b: (a * {tx.HASH_BASE} + b) % {tx.HASH_MOD}) AS h
      FROM (SELECT DISTINCT w FROM w)),
t AS (SELECT w.r, w.i, w.w, h.h, lead(h.h) OVER o AS h2, count(*) OVER (PARTITION BY w.r) AS n,
             {" || chr(32) || ".join(["w.w"] + [f"lead(w.w, {k}) OVER o" for k in range(1, WINDOW)])} AS win
      FROM w JOIN h USING (w) WINDOW o AS (PARTITION BY w.r ORDER BY w.i)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM
        (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM t WHERE win IS NOT NULL), range({WINDOW}) AS x(k) WHERE c > 1 GROUP BY r),
g AS (SELECT r, h % {BUCKETS} AS b FROM t
      UNION ALL SELECT r, (h * {PAIR[0]} + h2 * {PAIR[1]}) % {tx.HASH_MOD} % {BUCKETS} + {BUCKETS} FROM t WHERE h2 IS NOT NULL),
trust AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
c AS (SELECT b, count(*) AS n_raw, count(*) FILTER (WHERE r IN (SELECT r FROM d WHERE doc_id IN (SELECT doc_id FROM trust))) AS n_target FROM g GROUP BY b),
s AS (SELECT b >= {BUCKETS} AS two, sum(n_raw)::DOUBLE AS s_raw, sum(n_target)::DOUBLE AS s_target FROM c GROUP BY 1),
lw AS (SELECT b, CASE WHEN s_target = 0 THEN 0 ELSE
         round_even(ln((n_target + {SMOOTH}::DOUBLE) / (n_raw * (s_target / s_raw) + {SMOOTH}::DOUBLE)) * {UNIT}, 0)::BIGINT END AS lw
       FROM c JOIN s ON (c.b >= {BUCKETS}) = s.two),
ll AS (SELECT r, sum(lw)::BIGINT AS z, count(*) AS n_grams FROM g JOIN lw USING (b) GROUP BY r),
m AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY r),
q AS (SELECT r, sum(c - 1) AS n_dup_lines FROM (SELECT r, l, count(*) AS c FROM
        (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r, l) GROUP BY r),
o AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(n_grams, 0)::BIGINT AS n_grams, coalesce(z / (n_grams * {float(UNIT)}::DOUBLE), 0.0::DOUBLE) AS llr
      FROM d LEFT JOIN m USING (r) LEFT JOIN q USING (r) LEFT JOIN rep USING (r) LEFT JOIN ll USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND llr >= {THRESHOLD} AS kept, n_grams, llr
FROM o"""
