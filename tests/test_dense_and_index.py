"""Segment index, dense counts and histograms against brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlens.operators import coupling, gram, search, segments


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def identity(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def altered(rng, x):
    x = list(x)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(x) + 1)
        kind = rng.random()
        if kind < 0.4 and at < len(x):
            x[at] = rng.choice("ACDE")
        elif kind < 0.7:
            x.insert(at, rng.choice("ACDE"))
        elif at < len(x):
            del x[at]
    return "".join(x)


def loops(rng, n, of=None):
    out = []
    for i in range(n):
        base = rng.choice(of) if of else None
        out.append((i, *[altered(rng, base[k + 1]) if base else "".join(rng.choice("ACDE") for _ in range(rng.choice([8, 10, 12, 13]))) for k in range(3)]))
    return out


@pytest.mark.parametrize("cut", [{"cdr1": 0.7, "cdr2": 0.7, "cdr3": 0.7}, {"cdr3": 0.75}, {"cdr1": 0.5, "cdr3": 0.9}, {"cdr1": 0.2, "cdr2": 0.2, "cdr3": 0.2}])
def test_index_finds_what_all_pairs_find(spark, cut):
    rng = random.Random(5)
    asked = loops(rng, 40)
    rows = loops(rng, 300, asked) + [(900, "", "", ""), (901, "A", "", "C")]
    rows += [rows[7], rows[7]]  # repeated rows are hits each
    table = spark.createDataFrame([(i, "s", "f", *r) for i, *r in rows], "doc_id long, source string, family string, cdr1 string, cdr2 string, cdr3 string").repartition(3)
    queries = spark.createDataFrame(asked + [(99, "", "A", "")], "query_id long, q_cdr1 string, q_cdr2 string, q_cdr3 string")
    want = []
    for q in asked + [(99, "", "A", "")]:
        for r in rows:
            ids = {k: identity(r[n], q[n]) for n, k in ((1, "cdr1"), (2, "cdr2"), (3, "cdr3")) if k in cut}
            near = all(abs(len(r[n]) - len(q[n])) <= 3 for n, k in ((1, "cdr1"), (2, "cdr2"), (3, "cdr3")) if k in cut)
            if near and all(x >= cut[k] for k, x in ids.items()):
                want.append((q[0], r[0], round(sum(ids.values()) / len(ids), 9)))
    for found in (segments.search(table, queries, cut), segments.indexed_hits(table, queries, cut, segments.lengths_of(table, list(cut)))):
        assert sorted((r.query_id, r.doc_id, round(r.identity, 9)) for r in found.collect()) == sorted(want)
    assert len(want) > 20


def test_index_compares_few_pairs_without_a_nested_loop(spark):
    rng = random.Random(9)
    some = lambda k: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(k))
    rows = [(i, "s", "f", some(12), some(10), some(13)) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, family string, cdr1 string, cdr2 string, cdr3 string")
    queries = table.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), *[F.col(k).alias(f"q_{k}") for k in ("cdr1", "cdr2", "cdr3")])
    cut = {"cdr1": 0.7, "cdr2": 0.7, "cdr3": 0.7}
    met = segments.meeting(table, queries, cut, segments.lengths_of(table, list(cut)))
    assert met.count() < 0.01 * 2000 * 100
    found = segments.search(table, queries, cut)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.count() == 100
    assert search.pair_up(table, queries, names=list(cut)).count() == 200_000


def test_index_of_no_rows(spark):
    table = spark.createDataFrame([], "doc_id long, source string, family string, cdr3 string")
    queries = spark.createDataFrame([(1, "ACDEACDEACDE")], "query_id long, q_cdr3 string")
    assert segments.search(table, queries, {"cdr3": 0.7}).count() == 0


def sequences_of(rng, n):
    return [("fam" + rng.choice("ab"), "".join(rng.choice("ACDW-") if rng.random() < 0.8 else rng.choice("ACDEFGHIKLMNPQRSTVWYX") for _ in range(128))) for _ in range(n)]


def test_shared_bits_against_counting(spark, monkeypatch):
    monkeypatch.setattr(gram, "MERGE", 2)
    rng = random.Random(3)
    rows, places = sequences_of(rng, 90) + [("fama", "ACD")], [1, 2, 5, 77, 128]
    frame = spark.createDataFrame(rows, "family string, v string").repartition(7)
    for gaps in (True, False):
        found = {(r.pos1, r.pos2): (r.n, round(r.mi, 9), round(r.h, 9)) for r in gram.shared_bits(frame, places, gaps).collect()}
        for a, b in combinations(places, 2):
            pairs = [(v.ljust(128, "-")[a - 1], v.ljust(128, "-")[b - 1]) for _, v in rows]
            pairs = [p for p in pairs if gaps or "-" not in p]
            n = len(pairs)
            count = lambda xs: {x: xs.count(x) for x in set(xs)}
            both, left, right = count(pairs), count([p[0] for p in pairs]), count([p[1] for p in pairs])
            mi = sum(c / n * math.log2(c * n / (left[x] * right[y])) for (x, y), c in both.items())
            h = max(-sum(c / n * math.log2(c / n) for c in side.values()) for side in (left, right))
            assert found.pop((a, b)) == (n, round(mi, 9), round(h, 9))
        assert not found
    assert gram.shared_bits(frame.limit(0), places).count() == 0


def test_histograms_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(gram, "MERGE", 2)
    monkeypatch.setattr(gram, "ROWS", 40)
    rng = random.Random(4)
    rows = sequences_of(rng, 300)
    frame = spark.createDataFrame(rows, "family string, v string").selectExpr("*", "regexp_replace(substring(v, 105, 13), '-', '') AS cdr3").repartition(5)
    data = frame.withColumns(coupling.loop_features()).toPandas()
    found = coupling.compensation(frame, [3, 90], least=5).collect()
    for r in found:
        own = data[(data.family == r.family) & (data.v.str[r.pos - 1] == r.aa)]
        assert r.n == len(own) >= 5
        for k in coupling.FEATURE_NAMES:
            x = own[k].to_numpy()
            want = [x.mean(), x.std(), x.min(), x.max(), *np.percentile(x, [5, 25, 50, 75, 95])]
            assert np.allclose([r[f"{k}_{s}"] for s in ("mean", "std", "min", "max", "p5", "p25", "p50", "p75", "p95")], want, atol=1e-6)
    kinds = {(f, p): sum((data.v[data.family == f].str[p - 1] == a).sum() >= 5 for a in gram.R.RESIDUES) for f in ("fama", "famb") for p in (3, 90)}
    assert len(found) == sum(kinds.values()) and all(r.kinds == kinds[r.family, r.pos] for r in found)
    assert coupling.compensation(frame.limit(0), [3]).count() == 0


def test_windows_hold_every_position_of_runs():
    assert coupling.windows_of([42, *range(49, 53), *range(66, 90)], 10) == {"w0": (42, 42), "w1": (49, 52), "w2": (66, 75), "w3": (76, 85), "w4": (86, 89)}
    assert coupling.windows_of([]) == {} and coupling.runs([3, 1, 2, 2]) == [(1, 3)]
    held = [p for a, b in coupling.WINDOWS.values() for p in range(a, b + 1)]
    assert held == list(range(1, 129))


def test_available_positions_and_residuals(spark):
    rng = random.Random(8)
    rows = [(f"s{i % 2}", f, v[:60] + "-" * 9 + v[69:], v[104:117].replace("-", "")) for i, (f, v) in enumerate(sequences_of(rng, 200))]
    rows += [("s2", "fama", "-" * 20 + "A" * 108, "A" * 13)]
    frame = spark.createDataFrame(rows, "source string, family string, v string, cdr3 string")
    places = coupling.available(frame)
    assert places == [*range(21, 61), *range(70, 129)]
    windows = coupling.windows_of(places, 25)
    charge = lambda x: sum(c in "KRH" for c in x) - sum(c in "DE" for c in x)
    total = np.zeros((len(windows), len(windows)))
    for family in ("fama", "famb"):
        own = [(v, c) for _, f, v, c in rows if f == family]
        y = np.array([[charge(v[a - 1 : b]) for a, b in windows.values()] for v, _ in own], float)
        x = np.array([[1, charge(v), len(c), 128 - v.count("-")] for v, c in own], float)
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        total += rest.T @ rest
    found = {(r.window1, r.window2): r.r for r in coupling.window_correlations(frame, ("total", "len_cdr3", "len_v"), True, 10, windows).collect()}
    d = np.sqrt(np.diag(total))
    for i, a in enumerate(windows):
        for j, b in enumerate(windows):
            assert found[a, b] == pytest.approx(total[i, j] / d[i] / d[j], abs=2e-6)


def test_histograms_take_the_memory_of_one_place(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Rows:
        select = lambda self, *columns: self
        mapInArrow = lambda self, count, fields: count

    monkeypatch.setattr(gram, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    rng, n = np.random.default_rng(1), 20_000
    letters = np.frombuffer(b"ACDEFGHIKLMNPQRSTVWY", np.uint8)[rng.integers(0, 20, (n, 128))]
    names = [f"x{k}" for k in range(10)]
    batch = pa.record_batch([pa.array(["f"] * n), pa.array([bytes(x).decode() for x in letters]), *[pa.array(rng.integers(0, 4000, n)) for _ in names]], names=["family", "v", *names])
    count = gram.value_blocks(Rows(), list(range(1, 94)), names)
    tracemalloc.start()
    total = sum(sum(np.frombuffer(x, np.int64).sum() for x in block.column("counts").to_pylist()) for block in count([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 93 * 10 * n and most < 200 << 20
