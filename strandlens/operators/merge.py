"""Ingest and merge: metadata joins, scored and first-seen dedup, translation of reads, filters with reasons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlens.functions import residues as R

#: The standard genetic code, codons in the order T, C, A, G of each place.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def join_metadata(rows: DataFrame, meta: DataFrame, names: list[str], limit: int = 500) -> DataFrame:
    """Rows with a comma list of ids, and the distinct values of those ids' metadata in order, each list cut to `limit`."""
    listed = rows.select("seq_id", F.explode(F.split("ids", ",")).alias("id")).withColumn("id", F.trim("id"))
    joined = listed.join(meta, "id", "left").groupBy("seq_id").agg(*[F.substring(F.array_join(F.array_sort(F.collect_set(k)), "; "), 1, limit).alias(k) for k in names])
    return rows.join(joined, "seq_id", "left")


def keep_best(rows: DataFrame, key: str, score: Column, tie: str) -> DataFrame:
    """One row for each non-blank key: of largest score, then smallest tie column."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), tie)
    return rows.filter(F.col(key) != "").withColumn("score", score).withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def metadata_score(sources: dict[str, int]) -> Column:
    """20 for a target, 10 for a patent, 5 each for organism and structure, and the source's priority."""
    has = lambda k, n: F.when(F.coalesce(F.col(k), F.lit("")) != "", n).otherwise(0)
    priority = F.coalesce(*[F.when(F.col("source") == k, n) for k, n in sources.items()], F.lit(0))
    return has("targets", 20) + has("patent_id", 10) + has("organism", 5) + has("pdb_id", 5) + priority


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.filter(F.col(key) != "").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("rank = 1").drop("rank")


def duplicate_groups(rows: DataFrame, key: str, ident: str, shown: int = 10) -> DataFrame:
    """Groups of two rows or more: size and the first ids."""
    least = Window.partitionBy(key).orderBy(ident)
    ranked = rows.withColumn("__r", F.row_number().over(least))
    out = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("__r") <= shown, F.lpad(F.col(ident).cast("string"), 18, "0")))), ",").alias("members"))
    return out.filter("n > 1")


def merge_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources under the same columns; missing ones are empty strings."""
    out = None
    for name, frame in frames.items():
        frame = frame.withColumn("origin", F.lit(name))
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out.fillna("")


def merge_rules(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rules, and new ones for places and residues that no existing rule has."""
    return existing.unionByName(new.join(existing.select("pos", "aa").distinct(), ["pos", "aa"], "left_anti"), allowMissingColumns=True)


def metadata_coverage(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.coalesce(F.col(k).cast("string"), F.lit("")) != "").cast("double")).alias(f"{k}_share") for k in names])


def clean_bases(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), "[^ACGTN]", "")


def reverse_complement(x: Column) -> Column:
    return F.reverse(F.translate(x, "ACGTN", "TGCAN"))


def translate_frame(x: Column, frame: int) -> Column:
    """Residues of whole codons from `frame` (0 to 2); codons with N give X."""
    n = F.floor((F.length(x) - frame) / 3).cast("int")
    place = lambda k, o: F.position(F.substring(x, k * 3 - 2 + frame + o, F.lit(1)), F.lit("TCAG"))
    letter = lambda k: F.when((place(k, 0) > 0) & (place(k, 1) > 0) & (place(k, 2) > 0), F.substring(F.lit(CODE), 16 * place(k, 0) + 4 * place(k, 1) + place(k, 2) - 20, F.lit(1))).otherwise("X")
    return F.when(n < 1, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), letter), ""))


#: Reads that are translated into one Arrow batch, and residues of three bases' codes end to end.
READS = 256
BASE = np.full(256, 4, np.uint8)
BASE[np.frombuffer(b"TCAG", np.uint8)] = np.arange(4)
RESIDUE = np.full((5, 5, 5), ord("X"), np.uint8)
RESIDUE[:4, :4, :4] = np.frombuffer(CODE.encode(), np.uint8).reshape(4, 4, 4)
CODONS = RESIDUE.tobytes().ljust(256, b"X")
#: Codes of the other strand's bases.
OTHER = np.array([2, 3, 0, 1, 4], np.uint8)


def read_frames(read: str) -> list[str]:
    """Residues of a read's six frames, the read's own first. Every base's codon is looked up once a strand."""
    out, own = [], BASE[np.frombuffer(read.encode(), np.uint8)]
    for x in (own, OTHER[own[::-1]]):
        codons = RESIDUE[x[:-2], x[1:-1], x[2:]] if len(x) > 2 else x[:0]
        out += [codons[k::3].tobytes().decode() for k in range(3)]
    return out


def first_frame(rows: DataFrame, ident: str, bases: str, filled: dict[str, str]) -> DataFrame:
    """`ident` and, by each name of `filled`, the residues of a read's own first frame with its N taken as that base (or as N: X).
    Every codon is looked up once, in Arrow batches. Reads hold no letters but ACGTN and aren't null."""
    kind = rows.schema[ident].dataType.simpleString()
    tables = {}
    for name, base in filled.items():
        tables[name] = BASE.copy()
        tables[name][ord("N")] = BASE[ord(base)]

    def translate(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, READS):
                part = batch.slice(start, READS)
                out = {name: [] for name in tables}
                for read in part.column("fw").to_pylist():
                    letters = np.frombuffer(read.encode(), np.uint8)[: len(read) // 3 * 3].reshape(-1, 3)
                    for name, table in tables.items():
                        x = table[letters]
                        codons = x[:, 0] * np.uint8(25) + x[:, 1] * np.uint8(5) + x[:, 2]
                        out[name].append(codons.tobytes().translate(CODONS).decode())
                yield pa.record_batch([part.column(ident), *[pa.array(x, pa.string()) for x in out.values()]], names=[ident, *out])

    return rows.select(ident, F.col(bases).alias("fw")).mapInArrow(translate, f"{ident} {kind}, " + ", ".join(f"{name} string" for name in filled))


def longest_open(protein: Column) -> Column:
    return F.array_max(F.transform(F.split(protein, r"\*"), lambda s: F.length(s)))


def six_frames(rows: DataFrame, ident: str, bases: str) -> DataFrame:
    """A row for each strand and frame: protein, stops and longest open stretch."""
    kind = rows.schema[ident].dataType.simpleString()

    def translate(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, READS):
                part = batch.slice(start, READS)
                reads = part.column("fw").to_pylist()
                names = [f"{s}{k + 1}" for s in "+-" for k in range(3)] * len(reads)
                ids = part.column(ident).take(pa.array(np.repeat(np.arange(len(reads)), 6)))
                yield pa.record_batch([ids, pa.array(names), pa.array([x for r in reads for x in read_frames(r)])], names=[ident, "frame", "protein"])

    out = rows.select(ident, F.coalesce(clean_bases(F.col(bases)), F.lit("")).alias("fw")).mapInArrow(translate, f"{ident} {kind}, frame string, protein string")
    return out.withColumns({"stops": R.count_of("protein", "*"), "longest": longest_open(F.col("protein"))})


def best_frame(frames: DataFrame, ident: str) -> DataFrame:
    """Each row's frame of longest open stretch, then fewest stops, then name."""
    order = Window.partitionBy(ident).orderBy(F.desc("longest"), "stops", "frame")
    return frames.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def read_filter(protein: Column, least: int = 70) -> Column:
    """No stop inside, and `least` residues after trailing stops go."""
    return ~protein.rlike(r"\*.") & (F.length(F.rtrim(protein, F.lit("*"))) >= least)


#: Terminal tags as patterns, in the order of their removal: ends first, repeats with their linkers as one.
TAGS = {"his": "H{6,10}$", "flag": "DYKDDDDK$", "twinstrep": "WSHPQFEK(GGGS){1,3}(GGS)?A?WSHPQFEK$", "strep": "WSHPQFEK$", "ha": "((GGGGS|GSAT|GS)*YPYDVPDYA){1,3}$", "epea": "EPEA$", "mskik": "^M?SKIK"}


def strip_tags(x: Column, names: list[str] | None = None) -> Column:
    for name, pattern in TAGS.items():
        if names is None or name in names:
            x = F.regexp_replace(x, pattern, "")
    return x


def stripped(rows: DataFrame, sequence: str, names: list[str] | None = None) -> DataFrame:
    """`rows` with plain (the sequence without tags) and removed (the names of those that went, in order)."""
    out, gone = rows.withColumn("plain", F.col(sequence)), []
    for name, pattern in TAGS.items():
        if names is None or name in names:
            gone.append(F.when(F.length(f"__before_{name}") > F.length(f"__after_{name}"), name))
            out = out.withColumn(f"__before_{name}", F.col("plain")).withColumn("plain", F.regexp_replace("plain", pattern, "")).withColumn(f"__after_{name}", F.col("plain"))
    return out.withColumn("removed", F.concat_ws(",", *gone)).drop(*[f"__{x}_{name}" for x in ("before", "after") for name in TAGS])


def common_tags(rows: DataFrame, sequence: str, share: float) -> list[str]:
    """Tags that `share` of the rows or more have; one row of counts reaches the driver."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(sequence).rlike(p)).alias(k) for k, p in TAGS.items()]).first()
    return [k for k in TAGS if found["n"] and found[k] >= share * found["n"]]


def cysteine_reasons(v: str = "v") -> Column:
    """Why a sequence's cysteines are refused; empty if they aren't."""
    n = R.count_of(v, "C")
    at = lambda *places: sum(((R.residue(v, p) == "C").cast("int") for p in places), F.lit(0)) > 0
    extra = (R.residue(v, 55) == "C") != (R.residue(v, 100) == "C")
    return F.concat_ws(";", F.when(n % 2 == 1, "odd"), F.when(~at(22, 23), "first"), F.when(~at(103, 104), "second"), F.when(extra, "half_pair"))


def true_vhh_reason(mark: Column) -> Column:
    """The first reason for which hallmarks are not those of a VHH, or `kept`."""
    a, b, c, d = (F.substring(mark, k, 1) for k in (1, 2, 3, 4))
    return (F.when(c != "R", "pos50").when(d == "W", "pos52").when(~a.isin("F", "Y"), "pos42").when(~b.isin("E", "Q", "K"), "pos49").otherwise("kept"))
