"""Dependence between positions: mutual information, associations, feature compensation, charge windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandlens.functions import residues as R
from strandlens.operators.counts import features
from strandlens.operators.gram import ROWS, shared_bits, value_blocks, value_statistics
from strandlens.sources.sequences import LENGTH


def pairs_of(places: list[int]):
    """An array of (pos1, pos2, aa1, aa2) over all pairs of a few places, taken from the row itself."""
    return F.array(*[F.struct(F.lit(a).alias("pos1"), F.lit(b).alias("pos2"), R.residue("v", a).alias("aa1"), R.residue("v", b).alias("aa2")) for i, a in enumerate(places) for b in places[i + 1 :]])


def pair_type(pos1, pos2):
    """FR-FR, FR-CDR or CDR-CDR."""
    loop = lambda p: p.between(27, 38) | p.between(56, 65) | p.between(105, 117)
    return F.when(loop(pos1) & loop(pos2), "CDR-CDR").when(loop(pos1) | loop(pos2), "FR-CDR").otherwise("FR-FR")


def mutual_information(rows: DataFrame, places: list[int], top: int | None = None, rate: int | None = None, normalised: bool = False, least: int = 1) -> DataFrame:
    """Bits that two positions share, gaps counted as a symbol. `rate` keeps that many keys in a million; normalised leaves
    pairs with a gap out, and adds mi / larger entropy, the kind of pair and whether its framework position is a vernier one.
    Pairs of fewer than `least` rows are left out."""
    if rate is not None:
        rows = rows.filter(R.sample_key(F.col("doc_id")) < rate)
    out = shared_bits(rows, places, gaps=not normalised).filter(F.col("n") >= least)
    more = []
    if normalised:
        loop = lambda p: p.between(27, 38) | p.between(56, 65) | p.between(105, 117)
        frame = F.when(loop(F.col("pos1")), F.col("pos2")).otherwise(F.col("pos1"))
        nmi = F.round(F.col("mi") / F.when(F.col("h") > 0, F.col("h")), 6) + 0.0
        more = [nmi.alias("nmi"), pair_type(F.col("pos1"), F.col("pos2")).alias("kind"), (frame.isin(R.VERNIER) & ~loop(frame)).alias("vernier")]
    out = out.select("pos1", "pos2", "n", (F.round("mi", 6) + 0.0).alias("mi"), *more)
    return out.orderBy(F.desc("mi"), "pos1", "pos2").limit(top) if top else out


def pair_counts(rows: DataFrame, lefts: list[int], rights: list[int], by: list[str]) -> DataFrame:
    """`by` columns, pos1, aa1, pos2, aa2, n: how often letters stand at a left and a right place, to be added up. A task counts
    its Arrow batches, ROWS rows at a time, one pair of places after the other; no row is exploded into its pairs."""
    of = F.concat_ws("\t", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in by]) if by else F.lit("")
    kinds = ", ".join([*[f"{k} {rows.schema[k].dataType.simpleString()}" for k in by], "pos1 int, aa1 string, pos2 int, aa2 string, n long"])

    def flush(parts: list):
        table = pa.Table.from_batches(parts).combine_chunks()
        letters = np.frombuffer("".join(table.column("v").to_pylist()).encode("latin-1", "replace"), np.uint8).reshape(table.num_rows, LENGTH)
        alphabet = np.unique(letters)
        place = np.zeros(256, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        code = {p: place[letters[:, p - 1]] for p in {*lefts, *rights}}
        named = table.column("of").combine_chunks().dictionary_encode()
        kind = named.indices.to_numpy().astype(np.int64)
        first = np.unique(kind, return_index=True)[1]  # a row of each group, in the dictionary's order
        size = len(alphabet)
        symbols = pa.array([chr(x) for x in alphabet])
        for a in lefts:
            own, found = kind * size + code[a], []
            for b in rights:
                key = own * size + code[b]
                if len(first) * size * size <= DENSE:
                    n = np.bincount(key)
                    at = np.flatnonzero(n)
                    n = n[at]
                else:
                    at, n = np.unique(key, return_counts=True)
                found.append((np.full(len(at), b, np.int32), at, n))
            right, at, n = map(np.concatenate, zip(*found))
            group = pa.array(first[at // (size * size)])
            yield pa.record_batch([*[table.column(k).combine_chunks().take(group) for k in by], pa.array(np.full(len(at), a, np.int32)), symbols.take(pa.array(at // size % size)), pa.array(right), symbols.take(pa.array(at % size)), pa.array(n.astype(np.int64))],
                                  names=[*by, "pos1", "aa1", "pos2", "aa2", "n"])

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

    return rows.select(*by, of.alias("of"), F.rpad(F.coalesce("v", F.lit("")), LENGTH, "-").alias("v")).mapInArrow(count, kinds)


#: Cells that are counted in an array; beyond it keys are sorted.
DENSE = 1 << 22


def associations(rows: DataFrame, lefts: list[int], rights: list[int], least: int = 10, confidence: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """For each residue at a left place, the most frequent residue at a right place, with its share."""
    by = by or []
    counts = pair_counts(rows, lefts, rights, by).groupBy(*by, "pos1", "aa1", "pos2", "aa2").agg(F.sum("n").alias("n"))
    place = Window.partitionBy(*by, "pos1", "aa1", "pos2")
    out = counts.withColumns({"total": F.sum("n").over(place), "rank": F.row_number().over(place.orderBy(F.desc("n"), "aa2"))}).filter("rank = 1")
    out = out.withColumn("confidence", F.col("n") * F.lit(1.0) / F.col("total"))
    return out.filter((F.col("total") >= least) & (F.col("confidence") >= confidence)).select(*by, "pos1", "aa1", "pos2", F.col("aa2").alias("predicted"), "n", "total", "confidence")


#: Where the three residues before each junction and the five after it begin.
JUNCTIONS = {"fr1_cdr1": (24, 27), "cdr1_fr2": (36, 39), "fr2_cdr2": (53, 56), "cdr2_fr3": (63, 66), "fr3_cdr3": (102, 105), "cdr3_fr4": (115, 118)}


def junction_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` with junction, left and right of all six junctions, those of plain residues only."""
    made = F.array(*[F.struct(F.lit(k).alias("junction"), F.substring("v", a, 3).alias("left"), F.substring("v", b, 5).alias("right")) for k, (a, b) in JUNCTIONS.items()])
    return rows.select(*keep, F.explode(made).alias("x")).select(*keep, "x.*").filter(F.concat("left", "right").rlike(f"^[{R.RESIDUES}]{{8}}$"))


def junctions(rows: DataFrame, least: int = 5) -> DataFrame:
    """The three residues before a junction predict the five after it, and the third loop's length those of the others."""
    size = lambda k: F.length(R.region("v", k)).cast("string")
    lengths = rows.select(F.explode(F.array(*[F.struct(F.lit(f"length_cdr3_{k}").alias("junction"), size("cdr3").alias("left"), size(k).alias("right")) for k in ("cdr1", "cdr2")])).alias("x")).select("x.*")
    counts = junction_rows(rows, []).union(lengths).groupBy("junction", "left", "right").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("junction", "left")
    out = counts.withColumns({"total": F.sum("n").over(place), "rank": F.row_number().over(place.orderBy(F.desc("n"), "right"))})
    return out.filter((F.col("rank") == 1) & (F.col("total") >= least)).select("junction", "left", "right", "n", "total")


def universal_associations(rows: DataFrame, lefts: list[int], rights: list[int], clusters: int = 50, least: int = 3, share: float = 0.8) -> DataFrame:
    """Whether the global prediction of an association also leads in the largest framework clusters."""
    signed = rows.withColumn("signature", R.hallmarks("v"))
    top = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "signature").limit(clusters)
    everywhere = associations(signed, lefts, rights, least=least).select("pos1", "aa1", "pos2", "predicted")
    within = associations(signed.join(top.select("signature"), "signature", "left_semi"), lefts, rights, least=least, by=["signature"])
    agree = within.withColumnRenamed("predicted", "local").join(everywhere, ["pos1", "aa1", "pos2"]).groupBy("pos1", "aa1", "pos2", "predicted")
    out = agree.agg(F.count(F.lit(1)).alias("clusters"), F.avg((F.col("local") == F.col("predicted")).cast("double")).alias("agreement"))
    return out.filter(F.col("clusters") >= 3).withColumn("universal", F.col("agreement") >= share)


def dependent_positions(rows: DataFrame, lefts: list[int], rights: list[int], confidence: float = 0.75, least: int = 3) -> DataFrame:
    """Within families: positions where different cdr residues predict different residues with confidence."""
    strong = associations(rows, lefts, rights, least, confidence, ["family"])
    return strong.groupBy("family", "pos1", "pos2").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("predicted").alias("kinds")).filter("kinds > 1")


def family_dependent_positions(profile: DataFrame, confidence: float = 0.3) -> DataFrame:
    """Positions whose consensus, where it is strong, differs between families."""
    strong = profile.filter(F.col("major_frequency") >= confidence)
    return strong.groupBy("pos").agg(F.count_distinct("major").alias("kinds"), F.count(F.lit(1)).alias("families")).filter("kinds > 1")


def loop_features() -> dict:
    """22 whole-number features: of each loop length, charge, hydrophobicity in tenths, aromatics, cysteines, volume and beta
    propensity, and the charge of all."""
    out = {}
    for k in ("cdr1", "cdr2", "cdr3"):
        x = R.region("v", k)
        out |= {f"{k}_length": F.length(x), f"{k}_charge": R.charge(x), f"{k}_hydro": R.weighted(x, R.HYDROPHOBICITY), f"{k}_aromatic": R.count_of(x, "FWY"), f"{k}_cys": R.count_of(x, "C"), f"{k}_volume": R.weighted(x, R.VOLUME), f"{k}_beta": R.weighted(x, R.BETA)}
    return out | {"total_charge": R.charge("v")}


FEATURE_NAMES = [f"{k}_{x}" for k in ("cdr1", "cdr2", "cdr3") for x in ("length", "charge", "hydro", "aromatic", "cys", "volume", "beta")] + ["total_charge"]


#: Percentiles that compensation() tells.
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def compensation(rows: DataFrame, places: list[int], least: int = 10) -> DataFrame:
    """Feature statistics for each family, position and residue, of positions with two such residues or more, from exact
    histograms of the features' values."""
    blocks = value_blocks(rows.withColumns(loop_features()), places, FEATURE_NAMES)
    out = value_statistics(blocks, FEATURE_NAMES, SHARES, least)
    rounded = [F.round(f"{k}_{x}", 6).alias(f"{k}_{x}") for k in FEATURE_NAMES for x in ("std", *[f"p{round(100 * p)}" for p in SHARES])]
    plain = ["family", "pos", "aa", "n", *[f"{k}_{x}" for k in FEATURE_NAMES for x in ("mean", "min", "max")]]
    return out.select(*plain, *rounded).withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("family", "pos"))).filter("kinds >= 2")


#: Differences of mean features from which residues count as compensating.
EFFECTS = {"cdr3_length": 1.5, "cdr3_charge": 0.3, "cdr3_hydro": 2.0, "total_charge": 0.6}


def compensation_effects(stats: DataFrame) -> DataFrame:
    """Pairs of residues at a position whose mean features differ enough."""
    a, b = stats.alias("a"), stats.alias("b")
    out = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.aa") < F.col("b.aa")))
    out = out.select("a.family", "a.pos", F.col("a.aa").alias("aa1"), F.col("b.aa").alias("aa2"), *[(F.col(f"b.{k}_mean") - F.col(f"a.{k}_mean")).alias(f"d_{k}") for k in EFFECTS])
    big = [F.abs(f"d_{k}") >= x for k, x in EFFECTS.items()]
    return out.filter(big[0] | big[1] | big[2] | big[3])


def runs(positions: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of successive positions."""
    out: list[tuple[int, int]] = []
    for p in sorted(set(positions)):
        if out and p == out[-1][1] + 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def windows_of(positions: list[int], size: int = 10) -> dict[str, tuple[int, int]]:
    """Every position in a window: each run is cut into windows of `size` from its start; a run's last one may be shorter."""
    cut = [(a, min(a + size - 1, last)) for first, last in runs(positions) for a in range(first, last + 1, size)]
    return {f"w{k}": window for k, window in enumerate(cut)}


def available(rows: DataFrame, by: str = "source") -> list[int]:
    """Positions that hold a residue in some row of every file (`by`)."""
    filled = lambda p: F.max(R.residue("v", p).isin(list(R.RESIDUES)).cast("int"))
    each = rows.groupBy(by).agg(*[filled(p).alias(f"p{p}") for p in range(1, 129)])
    found = each.agg(*[F.min(f"p{p}").alias(f"p{p}") for p in range(1, 129)]).first()
    return [p for p in range(1, 129) if found[f"p{p}"]]


#: Windows over the whole grid, where every file has every position.
WINDOWS = windows_of(list(range(1, 129)))
#: Covariates by name: net charge of all positions, lengths of cdr3 and of the whole without gaps, aromatics of cdr3.
COVARIATES = {"total": lambda: R.charge("v"), "len_cdr3": lambda: F.length("cdr3"), "len_v": lambda: F.length(F.translate("v", "-", "")), "aromatic": lambda: R.count_of("cdr3", "FWY")}


def window_charges(rows: DataFrame, windows: dict[str, tuple[int, int]] = WINDOWS, covariates: tuple[str, ...] = tuple(COVARIATES)) -> DataFrame:
    """Net charge of each window of positions, and the covariates."""
    return rows.select("family", *[R.charge(F.substring("v", a, b - a + 1)).alias(k) for k, (a, b) in windows.items()], *[COVARIATES[k]().alias(k) for k in covariates])


def moments(frame: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """n, sums and sums of products of the named columns, one row for each group."""
    sums = [F.sum(F.col(a).cast("double")).alias(f"s_{a}") for a in names]
    products = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return frame.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def scatter(row, names: list[str]) -> np.ndarray:
    out = np.empty((len(names), len(names)))
    for i, a in enumerate(names):
        for j in range(i, len(names)):
            b = names[j]
            out[i, j] = out[j, i] = row[f"p_{a}_{b}"] - row[f"s_{a}"] * row[f"s_{b}"] / row["n"]
    return out


def as_correlations(spark, s: np.ndarray, names: list[str]) -> DataFrame:
    """window1, window2, r of a scatter matrix; null where a variance is zero."""
    d = np.sqrt(np.maximum(np.diag(s), 0))
    cells = [(a, b, None if d[i] * d[j] == 0 else round(float(s[i, j] / (d[i] * d[j])), 6) + 0.0) for i, a in enumerate(names) for j, b in enumerate(names)]
    return spark.createDataFrame(cells, "window1 string, window2 string, r double")


def window_correlations(rows: DataFrame, covariates: tuple[str, ...] = (), within: bool = False, least: int = 10, windows: dict[str, tuple[int, int]] = WINDOWS) -> DataFrame:
    """Correlations of window charges: raw, or with covariates taken out (S_yy - S_xy' S_xx^-1 S_xy); over all rows, or as the sum of
    what each family of `least` rows or more has within itself. Spark sums the moments; what is solved here is a matrix of a few
    columns for each family."""
    names, k = [*windows, *covariates], len(windows)
    found = moments(window_charges(rows, windows, covariates), names, ["family"] if within else None).collect()
    total = np.zeros((k, k))
    for row in found:
        if row["n"] >= (least if within else 1):
            s = scatter(row, names)
            total += s[:k, :k] - s[:k, k:] @ np.linalg.pinv(s[k:, k:]) @ s[k:, :k] if covariates else s
    return as_correlations(rows.sparkSession, total, list(windows))
