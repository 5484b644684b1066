"""Loops found by anchors, and position grids of region strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What follows the third loop, most specific first.
TAILS = ["WGQG", "W.QG", "WG.G", "W..G", "WG.."]


def heuristic_cdr3(v: Column) -> Column:
    """From the last cysteine within 35 before the last tail anchor (or the last W of the last 30), itself included, up to
    it; from any cysteine before if none is so near; empty if shorter than 3."""
    v = F.regexp_replace(F.upper(v), "[^A-Z]", "")
    before = F.coalesce(*[F.when(v.rlike(t), F.regexp_extract(v, f"^(.*){t}", 1)) for t in TAILS], F.when(F.substring(v, -30, 30).contains("W"), F.regexp_extract(v, "^(.*)W", 1)))
    loop = F.regexp_extract(before, "(C[^C]*)$", 1)
    return F.when(F.length(loop) >= 3, loop).otherwise("")


def framework_split(v: Column) -> dict[str, Column]:
    """fr1 to fr4 and the loops by anchors: cysteine, W[YFVIL]RQ, cysteine, WG[QR]GT; empty strings where they don't stand in order."""
    pattern = "^(.{15,30}?C)(.{3,17}?)(W[YFVIL]RQ.{9,11}?)(.{3,12}?)(.{30,45}C)(.{3,35}?)(WG[QR]GT.*)$"
    return {k: F.regexp_extract(v, pattern, i) for i, k in enumerate(("fr1", "cdr1", "fr2", "cdr2", "fr3", "cdr3", "fr4"), 1)}


def grid(fr1: Column, fr2: Column, fr3: Column, fr4: Column) -> Column:
    """An array of (pos, aa) of framework strings: fr1 from 1 without 10, fr2 from 41, fr3 from 66 without 73, fr4 from 118."""

    def placed(x: Column, start: int, skipped: int | None) -> Column:
        letters = F.split(x, "")
        at = lambda i: F.lit(start) + i + (F.when(F.lit(start) + i >= skipped, 1).otherwise(0) if skipped else 0)
        return F.filter(F.transform(letters, lambda a, i: F.struct(at(i).cast("int").alias("pos"), a.alias("aa"))), lambda s: s["aa"] != "")

    return F.concat(placed(fr1, 1, 10), placed(fr2, 41, None), placed(fr3, 66, 73), placed(fr4, 118, None))


def tempered(p: Column, temperature: float) -> Column:
    """A probability whose log-odds are divided by the temperature."""
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / temperature))


#: What the second framework begins with, and what follows the third loop, most specific first.
FR2_STARTS = ["W[YFVILA]R[QRK]", "W[YFVILA][RK][QRK]", "W[A-Z]R[A-Z]"]
FR4_STARTS = ["W[GSVA]QG[TL][LQ]VTVSS", "W[GSVAR]QG[TL]", "W[GSR][QRGA]G[TL]", "[A-Z]{2}QG[TL][LQ]VTVSS", "W[GSVA]QG", "W[GSR][QRGA]G", "[A-Z]{2}QG[TL]"]


def anchored_cdr3(v: str, place: str = "instr") -> list[dict[str, str]]:
    """SQL expressions (of Spark, and with `place` = strpos of others), step by step, for column cdr3, the third loop by
    anchors: after the second framework's start (or from 80 on), up to the first of FR4_STARTS that is found, else two
    before QG[TL][LQ]VTVSS in the last 25, else the last WG, WS or WV; from the last cysteine 5 to 40 before. Empty if
    there is none. Places count from 0."""
    first = lambda x, t: f"({place}({x}, regexp_extract({x}, '({t})', 1)) - 1)"
    found = lambda x, t: f"regexp_extract({x}, '({t})', 1) <> ''"
    end = "QG[TL][LQ]VTVSS"
    return [
        {"x": v, "head": f"substr({v}, 11, 50)"},
        {"s": "CASE " + " ".join(f"WHEN {found('head', t)} THEN 60 + {first('head', t)}" for t in FR2_STARTS) + " ELSE 80 END"},
        {"rest": "substr(x, s + 1)", "tail": "right(x, 25)", "late": "substr(x, s + 2, greatest(length(x) - 14 - s, 0))"},
        {"e": "CASE " + " ".join(f"WHEN {found('rest', t)} THEN s + {first('rest', t)}" for t in FR4_STARTS) + f" WHEN {found('tail', end)} THEN length(x) - 27 + {first('tail', end)} WHEN {found('late', 'W[GSV]')} THEN s + 1 + length(regexp_extract(late, '^(.*)W[GSV]', 1)) END"},
        {"low": "greatest(s - 10, e - 40, -1)"},
        {"w": "substr(x, low + 2, greatest(e - 5 - low, 0))"},
        {"c": "CASE WHEN w LIKE '%C%' THEN low + 1 + length(regexp_extract(w, '^(.*)C', 1)) END"},
        {"cdr3": "CASE WHEN c IS NULL THEN '' ELSE substr(x, c + 2, e - c - 1) END"},
    ]
