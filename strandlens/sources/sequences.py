"""Sequence tables: from the given documents, from annotated CSV, FASTA text and numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlens.functions import residues as R


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Positions of a sequence, and the step between the ids of two texts' sequences.
LENGTH, STEP = 128, 1_000_000


def once(column: F.Column) -> F.Column:
    """The column made by a generator, so that later expressions refer to it and don't make it again."""
    return F.explode(F.array(column))


def letters(text: str) -> F.Column:
    """A text's residues. Letters are kept before upper-casing, so that no letter changes its length."""
    plain = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z]", "")), "[BJOUXZ]", "")
    return F.translate(plain, "EFTRAYNGHLIWSC", "FERTYAGNLHWICS")


def pieces(aa: F.Column) -> F.Column:
    """Successive runs of LENGTH residues, all of them; an array of strings, the last one maybe shorter."""
    return F.regexp_extract_all(aa, F.lit(f"[A-Z]{{1,{LENGTH}}}"), F.lit(0))


def all_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into successive sequences of LENGTH residues, gaps after a last one that is shorter: doc_id (of the
    sequence: the text's id times STEP, and its number), text_id, lang, source, v, hallmarks, family, cdr3 (without gaps)."""
    cut = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "lang", "source", F.posexplode(pieces(letters("text"))).alias("n", "w"))
    rows = cut.select((F.col("text_id") * STEP + F.col("n")).alias("doc_id"), "text_id", "lang", "source", once(F.rpad("w", LENGTH, "-")).alias("v"))
    return rows.select("*", R.hallmarks("v").alias("hallmarks"), R.family("v").alias("family"), R.region("v", "cdr3").alias("cdr3"))


def complete() -> F.Column:
    """Whether a sequence is not cut short: 20 or more of positions 4-26 and 6 or more of 118-125 are filled."""
    filled = lambda a, n: F.length(F.translate(F.substring("v", a, n), "-X*", ""))
    return (filled(4, 23) >= 20) & (filled(118, 8) >= 6)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete ones of all_sequences(): what rules, clusters, searches and designs are made from."""
    return all_sequences(spark, sf_dir).filter(complete())


def long_residues(rows: DataFrame, places: list[int], keep: list[str]) -> DataFrame:
    """`keep` columns with pos and aa, one row for each place."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), R.residue("v", p).alias("aa")) for p in places]))
    return rows.select(*keep, pairs.alias("x")).select(*keep, "x.pos", "x.aa")


def valid(aa: str = "aa"):
    return F.col(aa).isin(list(R.RESIDUES))


def read_annotated(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Annotated CSV files with normalised header names; the first of repeated names counts, cdr3 must be there, and
    files are united by name."""
    out = None
    for path in sorted(set(paths)):
        frame = spark.read.option("header", True).csv(path)
        plain = ["".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in raw.strip().lower()) for raw in frame.columns]
        # Spark adds their place to repeated names
        short = [x.removesuffix(str(i)) for i, x in enumerate(plain)]
        plain = [y if x != y and short.count(y) > 1 else x for x, y in zip(plain, short)]
        names, picked = set(), []
        for raw, name in zip(frame.columns, plain):
            if name not in names:
                names.add(name)
                picked.append(R.norm_cell(F.col(f"`{raw}`")).alias(name))
        if "cdr3" not in names:
            raise ValueError(f"{path} has no cdr3 column")
        frame = frame.select(picked)
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    return out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Columns id and seq of FASTA records; white space in sequences goes."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    return records.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("id"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))


def decode_numbered(codes) -> F.Column:
    """The letters of a row of character codes; 0 and 124 are gaps."""
    return F.array_join(F.transform(F.filter(codes, lambda c: (c != 0) & (c != 124)), lambda c: F.upper(F.char(c.cast("long")))), "")


def numbered_regions(codes) -> dict[str, F.Column]:
    """Region strings of a numbered row by its fixed slices (places from 0)."""
    part = lambda *cuts: decode_numbered(F.concat(*[F.slice(codes, a + 1, b - a) for a, b in cuts]))
    tail = part((150, 190))
    cdr3 = F.when(tail.startswith("C") & (F.instr(tail, "W") > 0), F.substring_index(tail, "W", 1)).otherwise(tail)
    return {"cdr1": part((39, 46)), "cdr2": part((66, 75), (85, 91)), "cdr3": cdr3, "frameworks": part((0, 27), (46, 65), (91, 150), (190, 200)), "whole": part((16, 190))}
