"""Counts behind conditional rules as one row a condition: made in one pass over the sequences, merged, kept, and turned into rules.

A row says how many rows of a family a condition has, n, and which residues they have at the places: `block` holds the codes of
up to LIGHT rows one after the other, or else a count for each place and residue, in 2, 4 or 8 bytes as n asks. Most hallmarks
stand in a few rows only, so a row of theirs is shuffled as its codes, not as a cell for each place. Blocks of one condition
merge to a block; a condition has a block for each ROWS rows at most, so no task gets a part that grows with one condition's rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlens.functions import residues as R
from strandlens.operators.counts import condition_tokens
from strandlens.operators.gram import GAP, ROWS, codes
from strandlens.sources.sequences import LENGTH

#: Rows whose codes are kept as they are, and conditions that are counted at a time.
LIGHT, AT_ONCE = 2 * GAP, 512
#: Stands for a missing family, whose rows only count where families don't.
NONE = "\0"
SCHEMA = "family string, condition string, n long, block binary"
KEYS = ["condition", "family"]
FOUND = "scope int, family string, condition string, pos int, aa string, n long, n_valid long, n_condition long, good boolean, own boolean"


def width(n: int) -> np.dtype:
    return np.dtype("<u2" if n < 1 << 16 else "<u4" if n < 1 << 32 else "<i8")


def binary(parts: list) -> pa.Array:
    return pa.array(parts, pa.binary())


def tabled(family, condition, n, parts) -> pa.Table:
    return pa.table([family, condition, pa.array(np.asarray(n, np.int64)), binary(parts)], names=["family", "condition", "n", "block"])


def counted(c: np.ndarray, kind: np.ndarray, kinds: int) -> np.ndarray:
    """How many rows of each kind have each residue at each place (codes `c`, a line for each row): kinds x (places x GAP)."""
    k = c.shape[1]
    key = kind[:, None] * (k * GAP) + np.arange(k) * GAP + c
    return np.bincount(key[c < GAP], minlength=kinds * k * GAP).reshape(kinds, k * GAP)


def packed(rows: DataFrame, places: list[int], full: bool = False) -> DataFrame:
    """Blocks of about ROWS rows each. Null conditions don't count; a missing family is NONE. `full` counts all three ends of the
    third loop."""
    places = sorted(places)
    bins = {"cdr3_len": R.length_bin(F.length("cdr3")), "cdr3_charge": R.charge_bin(R.charge("cdr3")), "cdr3_cys": R.cysteine_bin(R.count_of("cdr3", "C"))}
    base = rows.withColumns(bins).select(F.coalesce("family", F.lit(NONE)).alias("family"), condition_tokens(full).alias("tokens"), F.rpad(F.coalesce("v", F.lit("")), LENGTH, "-").alias("v"))

    def flush(held: list):
        table = pa.Table.from_batches(held).combine_chunks()
        c = codes(table.column("v").combine_chunks(), places)
        small = c.astype(np.uint8)
        family, listed = table.column("family").combine_chunks(), table.column("tokens").combine_chunks()
        wide = len(listed.flatten()) // len(listed)
        for k in range(wide):
            named = pc.binary_join_element_wise(family, listed.flatten()[k::wide], "\t").dictionary_encode()
            names = named.dictionary
            if not len(names):
                continue
            kind = named.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = np.flatnonzero(kind >= 0)
            known = known[np.argsort(kind[known], kind="stable")]
            n = np.bincount(kind[known], minlength=len(names))
            ends = np.cumsum(n)
            raw, size = small[known].tobytes(), len(places)
            parts = [raw[a * size : b * size] for a, b in zip((ends - n).tolist(), ends.tolist())]
            many = np.flatnonzero(n > LIGHT)
            for start in range(0, len(many), AT_ONCE):
                some = many[start : start + AT_ONCE]
                at = np.full(len(names), -1)
                at[some] = np.arange(len(some))
                own = known[at[kind[known]] >= 0]
                for i, x in zip(some.tolist(), counted(c[own], at[kind[own]], len(some))):
                    parts[i] = x.astype(width(int(n[i]))).tobytes()
            split = pc.split_pattern(names, "\t", max_splits=1)
            yield from tabled(pc.list_element(split, 0), pc.list_element(split, 1), n, parts).to_batches()

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


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin, in a table that is sorted by them."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def residues_of(table: pa.Table, groups: np.ndarray, number: int, size: int) -> np.ndarray:
    """The counts of each of `number` groups (number x (places x GAP)); `groups` is each row's."""
    n = table.column("n").to_numpy()
    blocks = table.column("block").combine_chunks().cast(pa.large_binary())
    total = np.zeros((number, size * GAP), np.int64)
    for low, high in ((0, LIGHT), (LIGHT, (1 << 16) - 1), ((1 << 16) - 1, (1 << 32) - 1), ((1 << 32) - 1, None)):
        own = np.flatnonzero((n > low) & (n <= high if high else True))
        if not len(own):
            continue
        raw = b"".join(blocks.take(pa.array(own)).to_pylist())
        if not low:
            total += counted(np.frombuffer(raw, np.uint8).reshape(-1, size).astype(np.int64), np.repeat(groups[own], n[own]), number)
            continue
        g = groups[own]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        total[g[first]] += np.add.reduceat(np.frombuffer(raw, width(int(n[own[0]]))).reshape(len(own), -1), first, axis=0, dtype=np.int64)
    return total


def merged(table: pa.Table, keys: list[str], size: int) -> pa.Table:
    """A row for each group of a table sorted by `keys`, of `size` places."""
    first = starts(table, keys)
    if len(first) == len(table):
        return table.select(["family", "condition", "n", "block"])
    n = np.add.reduceat(table.column("n").to_numpy(), first)
    ends = np.append(first[1:], len(table))
    blocks = table.column("block").combine_chunks()
    parts = [None] * len(first)
    light = np.flatnonzero(n <= LIGHT)
    listed = blocks.to_pylist()
    for i, a, b in zip(light.tolist(), first[light].tolist(), ends[light].tolist()):
        parts[i] = listed[a] if b - a == 1 else b"".join(listed[a:b])
    heavy = np.flatnonzero(n > LIGHT)
    for start in range(0, len(heavy), AT_ONCE):
        some = heavy[start : start + AT_ONCE]
        rows = np.concatenate([np.arange(a, b) for a, b in zip(first[some], ends[some])])
        totals = residues_of(table.take(pa.array(rows)), np.repeat(np.arange(len(some)), (ends - first)[some]), len(some), size)
        for i, x in zip(some.tolist(), totals):
            parts[i] = x.astype(width(int(n[i]))).tobytes()
    at = pa.array(first)
    return tabled(table.column("family").take(at), table.column("condition").take(at), n, parts)


def gathered(batches, keys: list[str], size: int):
    """Tables of merged rows, of rows sorted by KEYS; rows of one value of keys[0] stay in one table. Blocks of a condition that
    goes on are merged, so that it holds a row a family."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        last = int(starts(table, keys[:1])[-1])
        if last:
            yield merged(table.slice(0, last).combine_chunks(), keys, size)
        held = merged(table.slice(last).combine_chunks(), keys, size)
    if held is not None:
        yield held


def dealt(blocks: DataFrame) -> DataFrame:
    """All blocks of a condition in one partition, in order."""
    return blocks.repartition("condition").sortWithinPartitions(*KEYS)


def compacted(blocks: DataFrame, size: int) -> DataFrame:
    """A block for each family and condition; `size` places."""
    def merge(batches):
        for table in gathered(batches, KEYS, size):
            yield from table.to_batches()

    return dealt(blocks.select("family", "condition", "n", "block")).mapInArrow(merge, SCHEMA)


def found(blocks: DataFrame, places: list[int], least: dict, whole: dict | None = None, among: list[int] | None = None) -> DataFrame:
    """What rules are made of, in one pass over the blocks (columns FOUND). Scope 0: residues of a family's condition that reach
    `least` (obs, support, confidence), and all of the family's own condition, the baseline. With `whole` (support, confidence)
    scope 1: the first residue of a condition over all families at the places `among`, if it reaches `whole`, and all residues
    of the third loop's cysteine classes, which every row has one of. `good` rows are rules, `own` rows the baseline."""
    places = sorted(places)
    size, letters = len(places), pa.array(list(R.RESIDUES))
    chosen = np.array([places.index(p) for p in sorted(among or [])], int)
    floor = max(least["obs"], least["support"])

    def rows_of(table: pa.Table, scope: int):
        family, condition = table.column("family").combine_chunks(), table.column("condition").combine_chunks()
        if scope:
            own = pc.starts_with(condition, "cdr3_cys=").to_numpy(zero_copy_only=False)
        else:
            own = pc.equal(condition, pc.binary_join_element_wise("family=", family, "")).to_numpy(zero_copy_only=False)
        total = table.column("n").to_numpy()
        keep = np.flatnonzero((total >= (whole["support"] if scope else floor)) | own)
        for start in range(0, len(keep), AT_ONCE):
            some = keep[start : start + AT_ONCE]
            n = residues_of(table.take(pa.array(some)), np.arange(len(some)), len(some), size).reshape(len(some), size, GAP)
            at = np.arange(size)
            if scope:
                n, at = n[:, chosen], chosen
            valid = n.sum(axis=2, keepdims=True)
            confidence = n * 1.0 / np.maximum(valid, 1)
            if scope:
                good = (n >= whole["support"]) & (confidence >= whole["confidence"]) & (np.arange(GAP) == n.argmax(axis=2)[:, :, None])
            else:
                good = (n >= least["support"]) & (valid >= least["obs"]) & (confidence >= least["confidence"])
            g, p, a = np.nonzero((good | own[some][:, None, None]) & (n > 0))
            i = pa.array(some[g])
            columns = [pa.array(np.full(len(g), scope, np.int32)), family.take(i), condition.take(i), pa.array(np.array(places, np.int32)[at[p]]), letters.take(pa.array(a)), pa.array(n[g, p, a]), pa.array(valid[g, p, 0]), pa.array(total[some[g]]), pa.array(good[g, p, a]), pa.array(own[some[g]])]
            yield pa.record_batch(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    def find(batches):
        for table in gathered(batches, KEYS, size):
            named = pc.not_equal(table.column("family"), NONE)
            if whole:  # family rules take the loop's last residue only
                named = pc.and_(named, pc.invert(pc.match_substring_regex(table.column("condition"), r"^cdr3\[-[23]\]=")))
            yield from rows_of(table.filter(named).combine_chunks(), 0)
            if whole:
                yield from rows_of(merged(table, ["condition"], size).combine_chunks(), 1)

    return dealt(blocks).mapInArrow(find, FOUND)


def indefinite() -> Column:
    """Whether a condition doesn't define the place's residue."""
    return ~(F.col("condition").startswith("hallmarks=") & F.col("pos").isin(R.HALLMARKS))


def family_rules(rows: DataFrame, min_lift: float = 1.1, top: int = 2) -> DataFrame:
    """Rules of found()'s scope 0, as operators.counts.rules() defines them. A family's own condition has a lift of 1."""
    confidence = F.col("n") * F.lit(1.0) / F.col("n_valid")
    base = F.max(F.when(F.col("own"), confidence)).over(Window.partitionBy("family", "pos", "aa"))
    out = rows.filter("scope = 0").withColumns({"confidence": confidence, "baseline": base}).filter(F.col("good") & indefinite() & (F.lit(min_lift <= 1) | ~F.col("own")))
    out = out.withColumns({"lift": F.col("confidence") / F.col("baseline"), "confidence_all": F.col("n") * F.lit(1.0) / F.col("n_condition")}).filter(F.col("lift") >= min_lift)
    place = Window.partitionBy("family", "condition", "pos")
    out = out.withColumn("rank", F.row_number().over(place.orderBy(F.desc("n"), "aa"))).filter(F.col("rank") <= top)
    return out.select("family", "condition", "pos", "aa", F.col("n").alias("support"), "n_valid", "confidence", "confidence_all", "lift", "baseline", "rank")


def family_archetypes(rows: DataFrame, least: int = 10) -> DataFrame:
    """The vernier positions' consensus in families of `least` rows or more, as operators.counts.archetypes() gives it, from found()'s
    baseline."""
    first = F.row_number().over(Window.partitionBy("family", "pos").orderBy(F.desc("n"), "aa"))
    held = rows.filter((F.col("scope") == 0) & F.col("own") & (F.col("n_condition") >= least) & F.col("pos").isin(R.VERNIER))
    return held.withColumn("rank", first).filter("rank = 1").select("family", "pos", "rank", F.col("aa").alias("consensus"), (F.col("n") * F.lit(1.0) / F.col("n_valid")).alias("frequency"), F.col("n").alias("support"))


def global_rules(rows: DataFrame) -> DataFrame:
    """Rules of found()'s scope 1, as operators.counts.global_rules() defines them."""
    n = F.sum(F.when(F.col("own"), F.col("n")))
    base = n.over(Window.partitionBy("pos", "aa")) * F.lit(1.0) / n.over(Window.partitionBy("pos"))
    confidence = F.col("n") * F.lit(1.0) / F.col("n_valid")
    out = rows.filter("scope = 1").withColumns({"confidence": confidence, "baseline": base}).filter(F.col("good") & indefinite())
    return out.select("condition", "pos", "aa", F.col("n").alias("support"), "confidence", (F.col("confidence") / F.col("baseline")).alias("lift"))


def rules_of(blocks: DataFrame, places: list[int], min_obs: int = 5, min_support: int = 3, min_confidence: float = 0.7, min_lift: float = 1.1, top: int = 2) -> DataFrame:
    """The rules that blocks (merged or not) of the places give: what operators.tallies.rules_of() gives from cells."""
    return family_rules(found(blocks, places, {"obs": min_obs, "support": min_support, "confidence": min_confidence}), min_lift, top)


def both_found(rows: DataFrame) -> DataFrame:
    """found() of family rules (fr3fr4) and global rules (vernier positions, which are among those) at their usual thresholds, from one
    counting pass over the rows."""
    places = R.positions("fr3fr4")
    return found(packed(rows, places, full=True), places, {"obs": 5, "support": 3, "confidence": 0.7}, {"support": 10, "confidence": 0.6}, R.positions("vernier"))
