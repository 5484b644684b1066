"""Selection under quotas against brute force, rule tallies against rule mining, and rule counts that are stopped and repeated."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandlens.functions import residues as R
from strandlens.operators import counts as C, selection as S, tallies as T
from strandlens.streaming import rules as A

POOL = "lead string, candidate long, track int, kind string, bucket string, scaffold string, score double"


def reachable(available: Counter, wanted: dict, cap: int) -> bool:
    """Whether any numbers by track and kind reach all minima under the cap: all are tried."""
    cells = sorted(available)
    for taken in itertools.product(*[range(available[c] + 1) for c in cells]):
        kinds, tracks = {}, {}
        for (t, k), n in zip(cells, taken):
            kinds[k] = kinds.get(k, 0) + n
            tracks[t] = tracks.get(t, 0) + n
        if max(kinds.values()) <= cap and all(tracks.get(t, 0) >= n for t, n in wanted.items()):
            return True
    return False


def test_minima_are_reached_whenever_they_can_be(monkeypatch):
    monkeypatch.setattr(S, "LEAST", 2)
    monkeypatch.setattr(S, "SHARE", 0.0)
    rng, met = random.Random(5), 0
    for _ in range(150):
        wanted = {t: rng.randint(0, 3) for t in (1, 2, 3)}
        monkeypatch.setattr(S, "MINIMA", {t: (n, 10**6) for t, n in wanted.items()})
        monkeypatch.setattr(S, "ORIGINAL", (0, 10**6))
        rows = [(rng.choice((1, 2, 3)), rng.choice("abcd"), rng.random() < 0.3, rng.random() < 0.5) for _ in range(11)]
        slots = sum(wanted.values())
        step = S.quota_pick(rows, slots)
        tracks = Counter(rows[i][0] for i in step)
        assert len(step) == min(slots, len(rows))
        if reachable(Counter((t, k) for t, k, *_ in rows), wanted, 2):
            met += 1
            assert all(tracks[t] >= n for t, n in wanted.items()) and max(Counter(rows[i][1] for i in step).values(), default=0) <= 2
    assert met > 20


@pytest.fixture(scope="module")
def pool():
    rng = random.Random(7)
    rows = []
    for lead, n in (("a", 1500), ("b", 400), ("c", 30)):
        for i in range(n):
            kind = "hot" if rng.random() < 0.7 else rng.choice(["k1", "k2", "k3", None])
            rows.append((lead, i, 0 if i % 100 == 0 else rng.choice((1, 1, 1, 2, 3, 4)), kind, f"{kind}{rng.randint(0, 3)}", rng.choice(("universal", "universal", "original", None)), None if rng.random() < 0.02 else float(rng.randint(0, 30))))
    return rows + [("a", -1, None, "k1", "b", "original", -9.0), ("a", -2, -1, "k1", "b", "original", -9.0)]


def test_selection_holds_every_quota_and_equals_the_choice_from_the_whole_pool(spark, pool):
    n = 200
    found = S.select_by_quotas(spark.createDataFrame(pool, POOL).withColumn("extra", F.lit(1)).repartition(7), n).collect()
    for lead, size in (("a", n), ("b", n), ("c", 30)):
        rows = [r for r in found if r.lead == lead]
        ranked = [r for r in rows if r.track > 0]
        controls = sum(x[0] == lead and x[2] == 0 for x in pool)
        slots = n - controls
        assert len(rows) == size == len({r.candidate for r in rows}) and len(rows) - len(ranked) == controls
        own = sorted([x for x in pool if x[0] == lead and (x[2] or 0) > 0], key=lambda x: (x[6] is None, x[6], x[1]))
        want = S.quota_pick([(x[2], x[3], x[5] == "original", x[1] in buckets(own)) for x in own], slots)
        assert {r.candidate: r.step for r in ranked} == {own[i][1]: s for i, s in want.items()}
        if lead == "c":
            continue
        for t, (least, part) in S.MINIMA.items():
            assert sum(r.track == t for r in ranked) >= max(least, slots // part)
        assert sum(r.scaffold == "original" for r in ranked) >= max(10, slots // 5)
        kinds = [r.kind for r in ranked]
        assert max(map(kinds.count, set(kinds))) <= int(slots * S.SHARE)


def buckets(own: list) -> set:
    """Candidates that buckets prefer, by a walk over all rows, best first."""
    out, sizes = set(), {}
    for x in own:
        if sizes.setdefault((x[4], x[2]), 0) < S.BUCKET[x[2]]:
            sizes[x[4], x[2]] += 1
            sizes[x[4]] = sizes.get(x[4], 0) + 1
            out.add(x[1])
    for x in own:
        if x[1] not in out and sizes[x[4]] < S.TARGET:
            sizes[x[4]] += 1
            out.add(x[1])
    return out


def test_selection_of_nothing(spark):
    assert S.select_by_quotas(spark.createDataFrame([], POOL), 20).count() == 0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    v = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY-", weights=[3] * 20 + [2], k=128)) for _ in range(300)]
    v = [x[:41] + rng.choice("FY") + x[42:48] + "ER" + x[50:51] + rng.choice("GL") + x[52:70] + rng.choice("VVVR") + x[71:] for x in v]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "doc_id int, v string").repartition(5)
    return frame.withColumns({"family": R.family("v"), "hallmarks": R.hallmarks("v"), "cdr3": R.region("v", "cdr3")})


def plain(frame):
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in frame.collect())


@pytest.mark.parametrize("dense", [1 << 22, 0])
@pytest.mark.parametrize("lift", [1.1, 0.5])
def test_tallies_give_the_rules(spark, rows, monkeypatch, dense, lift):
    monkeypatch.setattr(T, "DENSE", dense)
    want = C.rules(rows, min_confidence=0.3, min_lift=lift)
    found = T.rules_of(T.tallied(rows, R.positions("fr3fr4")), min_confidence=0.3, min_lift=lift).select(want.columns)
    assert plain(found) == plain(want) and len(plain(want)) > 20


def test_tallies_of_nothing_and_of_nulls(spark, rows):
    places = R.positions("vernier")
    assert T.rules_of(T.tallied(rows.filter("false"), places)).count() == 0
    bare = rows.limit(0).union(spark.createDataFrame([(1, None, None, "FERG", "AA"), (2, None, "F_C2", None, None)], rows.schema))
    assert {(r.condition, r.cell, r.n) for r in T.tallied(bare, places).collect()} >= {("family=F_C2", 0, 1)}


def test_rule_counts_go_on_after_a_stop_and_repeats_change_nothing(spark, rows, tmp_path):
    places, path = R.positions("fr3fr4"), f"file://{tmp_path}/state"
    shard, source = rows.select("family", "hallmarks", "cdr3", "v"), f"file://{tmp_path}/in"
    shard.filter("v < 'M'").repartition(4).write.parquet(source)
    A.count_rules(spark, source, shard.schema, path, places, 1, min_confidence=0.3)
    assert len(A.versions(spark, f"{path}/counts")) == A.KEEP
    before = A.versions(spark, f"{path}/counts")
    A.merge(shard, before[-1], f"{path}/counts", places)  # a batch that is in already
    assert A.versions(spark, f"{path}/counts") == before
    broken = f"{path}/counts/version={before[-1] + 1}"  # a batch stopped while it was written
    shard.limit(3).write.parquet(broken)
    (tmp_path / "state" / "counts" / f"version={before[-1] + 1}" / "_SUCCESS").unlink()
    assert A.versions(spark, f"{path}/counts") == before
    shard.filter("NOT v < 'M'").repartition(2).write.mode("append").parquet(source)
    found = A.count_rules(spark, source, shard.schema, path, places, 1, min_confidence=0.3)
    want = C.rules(rows, min_confidence=0.3)
    assert plain(found.select(want.columns)) == plain(want)
    with pytest.raises(ValueError):
        A.count_rules(spark, source, shard.schema, path, places[1:], 1)
