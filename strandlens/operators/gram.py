"""Co-occurrence of all positions and exact histograms of features, by dense counts in Arrow batches.

A partition counts what its rows hold into arrays of fixed size, so that no row is exploded into its pairs of positions;
the arrays are added up in row blocks (one for each first position) by a tree of MERGE-fold groups.
Sequences are columns `v` of one-byte letters; shorter ones count as gaps behind their end, letters that are neither residues nor
gaps are one symbol of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from strandlens.functions import residues as R
from strandlens.sources.sequences import LENGTH

SYMBOLS = R.RESIDUES + "-"
GAP, SIZE = len(R.RESIDUES), len(SYMBOLS) + 1
CODE = np.full(256, SIZE - 1, np.int64)
CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
#: Arrays that are added up in one group, and rows that are counted at a time.
MERGE, ROWS = 64, 1 << 15


def codes(column: pa.Array, places: list[int]) -> np.ndarray:
    """Symbols of sequences of LENGTH letters at the places, a row for each."""
    joined = "".join(column.to_pylist()).encode("ascii", "replace")
    return CODE[np.frombuffer(joined, np.uint8).reshape(len(column), LENGTH)[:, np.array(places) - 1]]


def padded(rows: DataFrame):
    return F.rpad("v", LENGTH, "-").alias("v")


def joint_blocks(rows: DataFrame, places: list[int]) -> DataFrame:
    """Columns a, block: for the a-th place the counts of (later place, symbol here, symbol there), summed over all rows."""
    k = len(places)

    def count(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = codes(batch.column("v"), places)
            total = total or [np.zeros((k - 1 - a) * SIZE * SIZE, np.int64) for a in range(k - 1)]
            for a, own in enumerate(total):
                pair = c[:, a, None] * SIZE + c[:, a + 1 :] + np.arange(k - 1 - a) * (SIZE * SIZE)
                own += np.bincount(pair.ravel(), minlength=len(own))
        for a, own in enumerate(total or []):
            yield pa.record_batch([pa.array([a], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own.tobytes()], pa.binary())], names=["a", "part", "block"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("block").to_pylist())
        return pa.table({"a": table.column("a")[:1].cast(pa.int32()), "part": pa.array([0], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})

    fields = "a int, part long, block binary"
    parts = rows.select(padded(rows)).mapInArrow(count, fields)
    merged = parts.groupBy("a", F.pmod("part", F.lit(MERGE)).alias("branch")).applyInArrow(add, fields)
    return merged.groupBy("a").applyInArrow(add, fields).select("a", "block")


def shared_bits(rows: DataFrame, places: list[int], gaps: bool = True) -> DataFrame:
    """For each two places n, mi (bits that they share) and h (the larger entropy), over all rows; without `gaps`, over the rows that
    have a residue at both."""
    places = sorted(places)

    def measure(batches):
        for batch in batches:
            for a, block in zip(batch.column("a").to_pylist(), batch.column("block").to_pylist()):
                joint = np.frombuffer(block, np.int64).reshape(-1, SIZE, SIZE).astype(float)
                if not gaps:
                    joint[:, GAP, :] = joint[:, :, GAP] = 0
                n, left, right = joint.sum(axis=(1, 2)), joint.sum(axis=2), joint.sum(axis=1)
                share = lambda x: np.divide(x, n.reshape(-1, *[1] * (x.ndim - 1)), out=np.zeros_like(x), where=x > 0)
                logs = lambda x: np.log2(x, out=np.zeros_like(x), where=x > 0)
                both = np.divide(joint * n[:, None, None], left[:, :, None] * right[:, None, :], out=np.zeros_like(joint), where=joint > 0)
                mi = (share(joint) * logs(both)).sum(axis=(1, 2))
                h = np.maximum(-(share(left) * logs(share(left))).sum(axis=1), -(share(right) * logs(share(right))).sum(axis=1))
                some = n > 0
                later = np.array(places[a + 1 :], np.int32)[some]
                yield pa.record_batch([pa.array(np.full(len(later), places[a], np.int32)), pa.array(later), pa.array(n[some].astype(np.int64)), pa.array(mi[some]), pa.array(h[some])], names=["pos1", "pos2", "n", "mi", "h"])

    return joint_blocks(rows, places).mapInArrow(measure, "pos1 int, pos2 int, n long, mi double, h double")


#: A cell of a histogram is one number: residue and feature, and the value with ZERO added, in BITS bits.
BITS, ZERO = 40, 1 << 39


def value_blocks(rows: DataFrame, places: list[int], names: list[str]) -> DataFrame:
    """How often each value of the whole-number columns `names` stands with each residue at a place: a row for each family and place
    of about ROWS rows, with its cells and how often each occurs as whole numbers end to end. To be merged by summed_cells()."""

    def flush(parts: list):
        table = pa.Table.from_batches(parts).combine_chunks()
        c = codes(table.column("v").combine_chunks(), places)
        found = table.column("family").combine_chunks().dictionary_encode()
        kinds, family = found.dictionary, found.indices.to_numpy().astype(np.int64)
        values = []
        for name in names:
            value = table.column(name).to_numpy().astype(np.int64)
            low = int(value.min())
            values.append((value - low, low, int(value.max()) - low + 1))
        # one place after the other, so that memory is that of the rows and of one place's cells
        for i, place in enumerate(places):
            held = np.flatnonzero(c[:, i] < GAP)
            if not len(held):
                continue
            cell, groups, cells, counts = family[held] * GAP + c[held, i], [], [], []
            for k, (value, low, wide) in enumerate(values):
                key = cell * wide + value[held]
                size = len(kinds) * GAP * wide
                if size <= 1 << 22:
                    n = np.bincount(key, minlength=size)
                    key = np.flatnonzero(n)
                    n = n[key]
                else:
                    key, n = np.unique(key, return_counts=True)
                at = key // wide
                groups.append(at // GAP)
                cells.append(((at % GAP * len(names) + k) << BITS) + key % wide + (low + ZERO))
                counts.append(n)
            group = np.concatenate(groups)
            order = np.argsort(group, kind="stable")
            group = group[order]
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            bounds = pa.py_buffer((8 * np.append(first, len(group))).astype(np.int32).tobytes())
            packed = [pa.Array.from_buffers(pa.binary(), len(first), [None, bounds, pa.py_buffer(np.concatenate(x)[order].astype(np.int64).tobytes())]) for x in (cells, counts)]
            own = [kinds.take(pa.array(group[first])), pa.array(np.full(len(first), place, np.int32)), pa.array(np.full(len(first), TaskContext.get().partitionId(), np.int64))]
            yield pa.record_batch([*own, *packed], names=["family", "pos", "part", "cells", "counts"])

    def count(batches):
        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return rows.select("family", padded(rows), *names).mapInArrow(count, "family string, pos int, part long, cells binary, counts binary")


def summed_cells(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The different cells of a group's blocks, in order, and how often each occurs in all of them."""
    cells, counts = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("cells", "counts"))
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.add.reduceat(counts, first)


def value_statistics(blocks: DataFrame, names: list[str], shares: tuple[float, ...], least: int) -> DataFrame:
    """For each family, place and residue of `least` rows or more: n, and of each feature mean, std (of the whole), min, max and exact
    percentiles (linear between neighbours), from running sums over its values. Blocks are merged by a tree; a group holds one place's
    values, as many as the features have, however many rows there are."""
    fields = "family string, pos int, aa string, n long, " + ", ".join(f"{k}_mean double, {k}_std double, {k}_min int, {k}_max int, " + ", ".join(f"{k}_p{round(100 * p)} double" for p in shares) for k in names)

    def merge(table: pa.Table) -> pa.Table:
        cells, counts = summed_cells(table)
        one = lambda c: table.column(c)[:1]
        return pa.table({"family": one("family"), "pos": one("pos"), "part": one("part"), "cells": pa.array([cells.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    def measure(table: pa.Table) -> pa.Table:
        cells, n = summed_cells(table)
        value, kind = (cells & ((1 << BITS) - 1)) - ZERO, cells >> BITS
        # a residue has every feature, each with its values in order
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        lasts = np.append(starts[1:], len(kind)) - 1
        upto = np.cumsum(n)
        total, before = np.add.reduceat(n, starts), upto[starts] - n[starts]
        whole = value
        if float(np.abs(value).max()) ** 2 * float(total.max()) ** 2 >= 2.0**62:
            whole, n, total = value.astype(object), n.astype(object), total.astype(object)
        first, second = np.add.reduceat(whole * n, starts), np.add.reduceat(whole * whole * n, starts)
        spread = np.sqrt(np.maximum(total * second - first * first, 0).astype(float)) / total.astype(float)
        total = total.astype(np.int64)
        stats = [(first / total).astype(float), spread, value[starts].astype(np.int32), value[lasts].astype(np.int32)]
        for p in shares:
            at = (total - 1) * p
            low, high = (value[np.searchsorted(upto, before + x.astype(np.int64), "right")].astype(float) for x in (np.floor(at), np.ceil(at)))
            stats.append(low + (high - low) * (at - np.floor(at)))
        good = np.flatnonzero(total[:: len(names)] >= least)
        part = lambda x, k: pa.array(x.reshape(-1, len(names))[good, k])
        one = lambda c: pa.array([table.column(c)[0].as_py()] * len(good), table.schema.field(c).type)
        residue = pa.array([R.RESIDUES[i] for i in (kind[starts[:: len(names)]] // len(names))[good]], pa.string())
        columns = [one("family"), one("pos"), residue, part(total, 0), *[part(x, k) for k in range(len(names)) for x in stats]]
        return pa.table(columns, names=[f.split()[0] for f in fields.split(", ")])

    branches = blocks.groupBy("family", "pos", F.pmod("part", F.lit(MERGE)).alias("branch")).applyInArrow(merge, "family string, pos int, part long, cells binary, counts binary")
    return branches.groupBy("family", "pos").applyInArrow(measure, fields)
