"""Residue properties and sequence expressions, all as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: The residues that count, position ranges of the regions, and positions by role.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
REGIONS = {"fr1": (1, 26), "cdr1": (27, 38), "fr2": (39, 55), "cdr2": (56, 65), "fr3": (66, 104), "cdr3": (105, 117), "fr4": (118, 128)}
HALLMARKS = [42, 49, 50, 52]
VERNIER = [42, 49, 50, 52, 66, 67, 68, 69, 71, 76, 78, 82, 87, 89, 91, 94]
NOT_FOR_RULES = {1, 2, 3, 10, 73, 126, 127, 128}
#: Hydrophobicity in tenths, volume, beta propensity in hundredths.
HYDROPHOBICITY = {"I": 45, "V": 42, "L": 38, "F": 28, "C": 25, "M": 19, "A": 18, "G": -4, "T": -7, "S": -8, "W": -9, "Y": -13, "P": -16, "H": -32, "E": -35, "Q": -35, "D": -35, "N": -35, "K": -39, "R": -45}
VOLUME = {"G": 60, "A": 88, "S": 89, "C": 108, "D": 111, "P": 112, "N": 114, "T": 116, "E": 138, "V": 140, "Q": 143, "H": 153, "M": 162, "I": 166, "L": 166, "K": 168, "R": 173, "F": 189, "Y": 193, "W": 227}
BETA = {"V": 170, "I": 160, "Y": 147, "F": 138, "W": 137, "L": 130, "T": 119, "C": 119, "Q": 110, "M": 105, "R": 93, "N": 89, "H": 87, "A": 83, "S": 75, "G": 75, "K": 74, "P": 55, "D": 54, "E": 37}
GROUPS = {"hydrophobic": "AVILM", "aromatic": "FYW", "polar": "STNQ", "positive": "KRH", "negative": "DE", "special": "GPC"}
CATEGORIES = {"hydrophobic": "AILMFVW", "polar": "STNQ", "acidic": "DE", "basic": "KRH", "special": "GP", "reactive": "CY"}


def text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def count_of(x: Column | str, letters: str) -> Column:
    """How many of the letters a string has."""
    x = text(x)
    return F.length(x) - F.length(F.translate(x, letters, ""))


def weighted(x: Column | str, values: dict[str, int]) -> Column:
    """The whole-number sum of the letters' values; letters of equal value are counted together."""
    by: dict[int, str] = {}
    for letter, value in values.items():
        by[value] = by.get(value, "") + letter
    return reduce(lambda a, b: a + b, (count_of(x, letters) * value for value, letters in by.items()))


def charge(x: Column | str) -> Column:
    return count_of(x, "KRH") - count_of(x, "DE")


def hydrophobicity(x: Column | str) -> Column:
    """The mean, to three places; 0 for an empty string."""
    x = text(x)
    return F.round(weighted(x, HYDROPHOBICITY) / F.lit(10.0) / F.greatest(F.length(x), F.lit(1)), 3)


def residue(sequence: Column | str, position: int) -> Column:
    return F.substring(sequence, position, 1)


def region(sequence: Column | str, name: str) -> Column:
    """The region's residues, without gaps."""
    low, high = REGIONS[name]
    return F.translate(F.substring(sequence, low, high - low + 1), "-", "")


def hallmarks(sequence: Column | str) -> Column:
    return F.concat(*[residue(sequence, p) for p in HALLMARKS])


def group_of(x: Column, groups: dict[str, str] = GROUPS) -> Column:
    """The residue's class, `other` beyond them."""
    out = F.lit("other")
    for name, letters in reversed(groups.items()):
        out = F.when(x.isin(list(letters)), name).otherwise(out)
    return out


def norm_cell(x: Column) -> Column:
    """Missing marks become '-'."""
    trimmed = F.trim(x)
    return F.when(x.isNull() | F.lower(trimmed).isin("", "na", "nan", "none"), "-").otherwise(trimmed)


def identity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 if either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def length_bin(n: Column) -> Column:
    return F.when(n <= 8, "short").when(n <= 14, "medium").otherwise("long")


def charge_bin(q: Column) -> Column:
    return F.when(q <= -2, "negative").when(q >= 2, "positive").otherwise("neutral")


def cysteine_bin(n: Column) -> Column:
    return F.when(n == 0, "no_cys").when(n == 1, "one_cys").otherwise("multi_cys")


def family(sequence: Column | str) -> Column:
    """By hallmarks and all cysteines."""
    p42, label = residue(sequence, 42), F.when(count_of(sequence, "C") >= 4, "C4").otherwise("C2")
    return (F.when(residue(sequence, 50) == "L", "VH_like").when(residue(sequence, 52) == "W", "VHH_W52")
            .when(p42.isin("F", "Y"), F.concat(p42, F.lit("_"), label)).otherwise("Other_VHH"))


def family_positional(sequence: Column | str) -> Column:
    """The same, but four cysteines mean C at 55 and at 100."""
    p42 = residue(sequence, 42)
    label = F.when((residue(sequence, 55) == "C") & (residue(sequence, 100) == "C"), "C4").otherwise("C2")
    return (F.when(residue(sequence, 50) == "L", "VH_like").when(residue(sequence, 52) == "W", "VHH_W52")
            .when(p42.isin("F", "Y"), F.concat(p42, F.lit("_"), label)).otherwise("Other_VHH"))


def family_classical(sequence: Column | str) -> Column:
    p42, n = residue(sequence, 42), count_of(sequence, "C")
    classical = p42.isin("F", "Y") & residue(sequence, 49).isin("E", "Q") & (residue(sequence, 50) == "R")
    return (F.when(residue(sequence, 50) == "L", "VH_like")
            .when(classical & n.isin(2, 4), F.concat(p42, F.lit("_C"), n.cast("string"))).when(classical, "Classical_other")
            .when(residue(sequence, 52) == "W", "VHH_W52").otherwise("Non_classical"))


def family_light(mark: Column) -> Column:
    return (F.when(F.length(mark) != 4, "unknown").when(mark.startswith("Y"), "Y_like").when(mark.startswith("FER"), "F_C2")
            .when(mark.startswith("VG"), "VH_like").otherwise("other"))


def framework_type(mark: Column) -> Column:
    a, b, c, d = (F.substring(mark, k, 1) for k in (1, 2, 3, 4))
    camel, fourth = a.isin("F", "Y"), d.isin("G", "L", "F", "A")
    return (F.when(camel & b.isin("E", "Q") & (c == "R") & fourth, "Classical_VHH").when((a == "V") & (d == "W"), "VH")
            .when(camel & fourth & ((b == "G") | (c == "L")), "Humanized_VHH").when(a == "V", "VH_like").otherwise("Mixed"))


def hallmark_match(seen: Column, wanted: str) -> Column:
    """Same residue 1, same class one half, over four places."""
    total = F.lit(0.0)
    for k, letter in enumerate(wanted, 1):
        x = F.substring(seen, k, 1)
        mates = next((v for v in GROUPS.values() if letter in v), letter)
        total = total + F.when(x == letter, 1.0).when(x.isin(list(mates)), 0.5).otherwise(0.0)
    return total / 4


def positions(mode: str) -> list[int]:
    """Positions for rules: vernier, fr3fr4 or all frameworks, without those that rules don't use."""
    if mode == "vernier":
        chosen = set(VERNIER)
    elif mode == "fr3fr4":
        chosen = {*range(66, 105), *range(118, 129), *HALLMARKS}
    else:
        chosen = {p for name, (a, b) in REGIONS.items() if name.startswith("fr") for p in range(a, b + 1)}
    return sorted(chosen - NOT_FOR_RULES)


def sample_key(key: Column) -> Column:
    """A reproducible number below a million for each key."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 1_000_000
