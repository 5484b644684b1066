"""Counts behind conditional rules: made in one pass over the sequences, summed, kept, and turned into rules.

A tally row says how many rows of a family with a condition have a residue at a position: family, condition, cell, n. `cell` is
the position times WIDE plus the residue's code; cell 0 counts the condition's rows. Tallies of parts add up to those of the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlens.functions import residues as R
from strandlens.operators import blocks
from strandlens.operators.counts import condition_tokens, features
from strandlens.operators.gram import GAP, ROWS, codes
from strandlens.sources.sequences import LENGTH

WIDE = 32
#: Cells that are counted in an array; beyond it keys are sorted.
DENSE = 1 << 22
SCHEMA = "family string, condition string, cell int, n long"


def tallied(rows: DataFrame, places: list[int], family: Column | str = "family", full: bool = False) -> DataFrame:
    """Tallies of about ROWS rows each, to be added up by summed(). A row is never exploded: a task counts condition and
    residue codes of its Arrow batches, a condition's cells at a time. Rows without a family, and null conditions, don't count.
    `family` is what rows are told apart by; `full` counts all three ends of the third loop."""
    places = sorted(places)
    cells = (np.array(places)[:, None] * WIDE + np.arange(GAP)).ravel()
    base = features(rows).select((F.col(family) if isinstance(family, str) else family).alias("family"), condition_tokens(full).alias("tokens"), F.rpad(F.coalesce("v", F.lit("")), LENGTH, "-").alias("v")).filter("family IS NOT NULL")

    def flush(parts: list):
        table = pa.Table.from_batches(parts).combine_chunks()
        c = codes(table.column("v").combine_chunks(), places)
        at = np.arange(len(places)) * GAP + c
        held = c < GAP
        family, tokens = table.column("family").combine_chunks(), table.column("tokens").combine_chunks()
        width = len(tokens.flatten()) // len(tokens)
        for k in range(width):
            token = tokens.flatten()[k::width]
            named = pc.binary_join_element_wise(family, token, "\t").dictionary_encode()
            names = named.dictionary
            kind = named.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = kind >= 0
            key = (kind[:, None] * cells.size + at)[held & known[:, None]]
            if len(names) * cells.size <= DENSE:
                total = np.bincount(key, minlength=len(names) * cells.size)
                found = np.flatnonzero(total)
                n = total[found]
            else:
                found, n = np.unique(key, return_counts=True)
            kinds = np.concatenate([found // cells.size, np.arange(len(names))])
            cell = np.concatenate([cells[found % cells.size], np.zeros(len(names), np.int64)])
            n = np.concatenate([n, np.bincount(kind[known], minlength=len(names))])
            split = pc.split_pattern(names, "\t", max_splits=1)
            parted = [pc.list_element(split, i).take(pa.array(kinds)) for i in (0, 1)] if len(names) else [pa.array([], pa.string())] * 2
            yield pa.record_batch([*parted, pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["family", "condition", "cell", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= ROWS:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return base.mapInArrow(count, SCHEMA)


def mined(rows: DataFrame, mode: str = "fr3fr4", **thresholds) -> DataFrame:
    """Conditional rules of the rows: what operators.counts.rules() gives, from one counting pass."""
    places = R.positions(mode)
    return blocks.rules_of(blocks.packed(rows, places), places, **thresholds)


def global_mined(rows: DataFrame, mode: str = "vernier", min_support: int = 10, min_confidence: float = 0.6) -> DataFrame:
    """What operators.counts.global_rules() gives, from one counting pass: all rows as one family, whose residues the third
    loop's cysteine class, which every row has, adds up to."""
    sums = summed(tallied(rows, R.positions(mode), F.lit(""), full=True).filter("cell > 0 AND condition IS NOT NULL"))
    sums = sums.select("condition", "cell", F.col("n").alias("support"), F.expr(f"cell DIV {WIDE}").cast("int").alias("pos"))
    place = Window.partitionBy("condition", "pos")
    aa = F.substring(F.lit(R.RESIDUES), F.col("cell") % WIDE + 1, F.lit(1))
    out = sums.withColumn("aa", aa).withColumns({"n_valid": F.sum("support").over(place), "rank": F.row_number().over(place.orderBy(F.desc("support"), "aa"))}).filter("rank = 1")
    out = out.withColumn("confidence", F.col("support") * F.lit(1.0) / F.col("n_valid"))
    base = sums.filter(F.col("condition").startswith("cdr3_cys=")).groupBy("pos", "cell").agg(F.sum("support").alias("n"))
    base = base.select("cell", (F.col("n") * F.lit(1.0) / F.sum("n").over(Window.partitionBy("pos"))).alias("baseline"))
    definitional = F.col("condition").startswith("hallmarks=") & F.col("pos").isin(R.HALLMARKS)
    out = out.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & ~definitional)
    return out.join(F.broadcast(base), "cell").withColumn("lift", F.col("confidence") / F.col("baseline")).select("condition", "pos", "aa", "support", "confidence", "lift")


def of_family() -> Column:
    return F.col("condition") == F.concat(F.lit("family="), F.col("family"))


def summed(tallies: DataFrame) -> DataFrame:
    return tallies.groupBy("family", "condition", "cell").agg(F.sum("n").alias("n"))


def rules_of(tallies: DataFrame, min_obs: int = 5, min_support: int = 3, min_confidence: float = 0.7, min_lift: float = 1.1, top: int = 2) -> DataFrame:
    """The rules that tallies (added up or not) give: family, condition, pos, aa, support, n_valid, confidence,
    confidence_all, lift, baseline, rank, as operators.counts.rules() defines them.

    Both sides read the same sums, so that Spark makes them once: the family's own condition tells the baseline, and
    its lift is 1. What is left after the sums is some thousand rows a condition at most.
    """
    known = tallies.filter("family IS NOT NULL AND cell IS NOT NULL")  # what the join asks of its sides, so that both stay one plan
    sums = known.groupBy("family", "condition", "cell").agg(F.sum("n").alias("n"), F.max(F.when(of_family(), True)).alias("own"))
    pos, aa = F.expr(f"cell DIV {WIDE}").cast("int"), F.substring(F.lit(R.RESIDUES), F.col("cell") % WIDE + 1, F.lit(1))
    rules = sums.filter("own IS NULL") if min_lift > 1 else sums
    whole = Window.partitionBy("family", "condition")
    rules = rules.withColumn("n_condition", F.max(F.when(F.col("cell") == 0, F.col("n"))).over(whole)).withColumns({"pos": pos, "aa": aa})
    place = Window.partitionBy("family", "condition", "pos")
    rules = rules.filter("cell > 0").withColumn("n_valid", F.sum("n").over(place))
    rules = rules.withColumns({"confidence": F.col("n") * F.lit(1.0) / F.col("n_valid"), "confidence_all": F.col("n") * F.lit(1.0) / F.col("n_condition")})
    definitional = F.col("condition").startswith("hallmarks=") & F.col("pos").isin(R.HALLMARKS)
    rules = rules.filter((F.col("n_valid") >= min_obs) & (F.col("n") >= min_support) & (F.col("confidence") >= min_confidence) & ~definitional)
    base = sums.filter("own").withColumn("base_pos", pos)
    base = base.select("family", "cell", (F.col("n") * F.lit(1.0) / F.sum("n").over(Window.partitionBy("family", "base_pos"))).alias("baseline"))
    out = rules.join(base, ["family", "cell"]).withColumn("lift", F.col("confidence") / F.col("baseline")).filter(F.col("lift") >= min_lift)
    out = out.withColumn("rank", F.row_number().over(place.orderBy(F.desc("n"), "aa"))).filter(F.col("rank") <= top)
    return out.select("family", "condition", "pos", "aa", F.col("n").alias("support"), "n_valid", "confidence", "confidence_all", "lift", "baseline", "rank")
