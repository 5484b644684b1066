"""Selection of a fixed number of candidates for each lead under minima, quotas and caps."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Rows that a bucket prefers of each track and in all; least number and divisor of each track's minimum and of
#: the original scaffold's; share and least number of the cap on a kind.
BUCKET, TARGET = {1: 5, 2: 6, 3: 6, 4: 6}, 23
MINIMA, ORIGINAL = {1: (10, 10), 2: (15, 8), 3: (15, 8), 4: (20, 5)}, (10, 5)
SHARE, LEAST = 0.35, 5
COLUMNS = ["lead", "candidate", "track", "kind", "bucket", "scaffold", "score"]


def first_of(frame: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The n first rows of each key; Spark limits the window on the map side, so that a hot key isn't gathered."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.asc_nulls_last("score"), "candidate"))
    return frame.withColumn("__at", place).filter(F.col("__at") <= n)


def preferred(ranked: DataFrame) -> DataFrame:
    """What buckets prefer: each track's best by BUCKET, and the bucket's best until there are TARGET."""
    most = F.create_map(*[F.lit(x) for item in BUCKET.items() for x in item])[F.col("track")]
    dealt = first_of(ranked, ["lead", "bucket", "track"], max(BUCKET.values())).filter(F.col("__at") <= most)
    both = dealt.select(*COLUMNS, F.lit(1).alias("dealt")).union(first_of(ranked, ["lead", "bucket"], TARGET).select(*COLUMNS, F.lit(0)))
    both = both.groupBy(*COLUMNS).agg(F.max("dealt").alias("dealt"))
    return first_of(both, ["lead", "bucket"], TARGET, F.desc("dealt")).select(COLUMNS)


class Picks:
    """What is taken of one lead's rows (track, kind, original, preferred; best first), at most `cap` of a kind."""

    def __init__(self, rows: list[tuple], cap: int):
        self.rows, self.cap, self.step = rows, cap, {}
        self.kinds, self.tracks, self.taken = Counter(), Counter(), defaultdict(set)
        self.of_track = defaultdict(list)
        for i, (track, *_) in enumerate(rows):
            self.of_track[track].append(i)

    def take(self, i: int, step: str) -> None:
        track, kind, *_ = self.rows[i]
        self.step[i] = step
        self.kinds[kind] += 1
        self.tracks[track] += 1
        self.taken[track, kind].add(i)

    def drop(self, i: int) -> str:
        track, kind, *_ = self.rows[i]
        self.kinds[kind] -= 1
        self.tracks[track] -= 1
        self.taken[track, kind].discard(i)
        return self.step.pop(i)

    def free(self, i: int) -> bool:
        return i not in self.step and self.kinds[self.rows[i][1]] < self.cap

    def gain(self, track: int, seen: set) -> bool:
        """One more row of a track; where its kinds are full, another track gives up a row of that kind for one of another
        kind: an augmenting path, so that a minimum fails only if no choice under the cap reaches it."""
        for i in self.of_track[track]:
            kind = self.rows[i][1]
            if i in self.step or kind in seen:
                continue
            seen.add(kind)
            if self.kinds[kind] < self.cap:
                self.take(i, "minimum")
                return True
            for other in [t for t in self.of_track if t != track and self.taken[t, kind]]:
                worst = max(self.taken[other, kind])
                step = self.drop(worst)
                if self.gain(other, seen):
                    self.take(i, "minimum")
                    return True
                self.take(worst, step)
        return False

    def minimum(self, track: int, n: int) -> None:
        """n rows of a track: an equal part of each kind first, then the best."""
        own = self.of_track[track]
        part, place, spread = max(1, n // max(1, len({self.rows[i][1] for i in own}))), Counter(), []
        for i in own:
            place[self.rows[i][1]] += 1
            spread.append((place[self.rows[i][1]] > part, i))
        for _, i in sorted(spread):
            if self.tracks[track] < n and self.free(i):
                self.take(i, "minimum")
        while self.tracks[track] < n and self.gain(track, set()):
            pass

    def originals(self, n: int, slots: int, minima: dict[int, int]) -> None:
        """n rows of the original scaffold: the best while there are slots, then for the worst row that no minimum needs."""
        have = sum(self.rows[i][2] for i in self.step)
        waiting = [i for i, r in enumerate(self.rows) if r[2] and i not in self.step]
        for i in waiting:
            if have >= n:
                return
            track, kind, *_ = self.rows[i]
            if len(self.step) < slots and self.free(i):
                self.take(i, "original")
                have += 1
                continue
            out = [j for j in self.step if not self.rows[j][2] and (self.rows[j][1] == kind or self.kinds[kind] < self.cap) and (self.rows[j][0] == track or self.tracks[self.rows[j][0]] > minima[self.rows[j][0]])]
            if out:
                self.drop(max(out))
                self.take(i, "original")
                have += 1

    def fill(self, slots: int) -> None:
        """The preferred rows, then all, best first; the cap is the least one that fills the slots."""
        order = sorted(range(len(self.rows)), key=lambda i: (not self.rows[i][3], i))
        while len(self.step) < min(slots, len(self.rows)):
            for i in order:
                if len(self.step) < slots and self.free(i):
                    self.take(i, "bucket" if self.rows[i][3] else "fill")
            self.cap += 1


def minima(slots: int) -> dict[int, int]:
    """Each track's minimum, in the order of tracks while there are slots."""
    out, left = {}, slots
    for track, (least, part) in MINIMA.items():
        out[track] = min(left, max(least, slots // part))
        left -= out[track]
    return out


def quota_pick(rows: list[tuple], slots: int) -> dict[int, str]:
    """Which of one lead's rows (track, kind, original, preferred; best first) are chosen, with the step that chose them."""
    picks, wanted = Picks(rows, max(LEAST, int(slots * SHARE))), minima(slots)
    for track, n in wanted.items():
        picks.minimum(track, n)
    least, part = ORIGINAL
    picks.originals(min(slots, max(least, slots // part)), slots, wanted)
    picks.fill(slots)
    return picks.step


def select_by_quotas(pool: DataFrame, n: int) -> DataFrame:
    """Exactly n candidates of each lead, or all that it has, with `step`, the reason for each.

    `pool`: lead, candidate (unique within a lead), track (0 controls, 1 to 4; others and null are never chosen), kind,
    bucket, scaffold, score (lower is better, null last); more columns are left out. Controls come first. The other slots:
    each track's minimum, spread over kinds; the minimum of the original scaffold; what buckets prefer; the best of the rest.
    No kind has more than SHARE of the slots (LEAST at least), or the least number that still fills them. Track minima under
    the cap are reached whenever any choice reaches them, the scaffold's by exchanges of two rows. A null kind, bucket or
    scaffold is a value of its own. Ties go to the smaller candidate.

    Rows of one lead, track, kind and scaffold differ in nothing but score and preference, so only n of each can be chosen:
    limited windows leave these, and a task holds n rows for each such cell and preference of one lead, however large its
    pool is. The pool is read four times: store it first if it is dear to make.
    """
    pool = pool.select(F.col("lead"), F.col("candidate").cast("long").alias("candidate"), F.col("track").cast("int").alias("track"), "kind", "bucket", "scaffold", F.col("score").cast("double").alias("score"))
    ranked, cell = pool.filter(F.col("track").between(1, 4)), ["lead", "track", "kind", "scaffold"]
    parts = [first_of(pool.filter("track = 0"), ["lead"], n), first_of(ranked, cell, n), first_of(preferred(ranked), cell, n)]
    first, *rest = [p.select(*COLUMNS, F.lit(i == 2).alias("preferred")) for i, p in enumerate(parts)]
    for p in rest:
        first = first.union(p)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pool.schema.fields) + ", step string"

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("preferred", ascending=False, kind="stable").drop_duplicates("candidate").sort_values(["score", "candidate"], na_position="last")
        controls, others = rows[rows["track"] == 0].head(n), rows[rows["track"] > 0]
        names = others["kind"].where(others["kind"].notna(), None)
        made = list(zip(others["track"], names, (others["scaffold"] == "original").fillna(False).astype(bool), others["preferred"]))
        step = quota_pick(made, n - len(controls))
        chosen = others.iloc[sorted(step)].assign(step=[step[i] for i in sorted(step)])
        return pd.concat([controls.assign(step="control"), chosen])[[*COLUMNS, "step"]]

    return first.groupBy("lead").applyInPandas(walk, schema)
