"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandlens.plans import PLANS

SF = "/root/testdata/sf0.001"
#: All queries of some kinds, and a few of the others, which the driver compares as well; not those that take longest.
LONG = {"D02_score_class", "D05_rule_naturalness", "D08_candidates", "K03_run_outputs", "U04_rule_merge", "J09_rules_not_known"}
KINDS, SOME = ("D", "J", "K", "P", "T", "U", "W"), {"A01_rule_mining", "A05_conservation", "A12_triplet_rules", "A19_junctions", "A24_residual_correlations", "F07_six_frames", "F14_anchored_cdr3", "F16_tag_strip", "G04_best_hits", "I03_production_table", "S02_repertoire_tables", "S05_numbered_regions", "S07_structure_atoms", "X01_arriving_counts"}
NAMES = sorted(k for plan in PLANS for k in plan.SQL if (k.startswith(KINDS) or k in SOME) and k not in LONG)


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    queries = {k: q for p in PLANS for k, q in p.QUERIES.items()}
    sqls = {k: q for p in PLANS for k, q in p.SQL.items()}
    frame = queries[name](spark, SF)
    columns = sorted(frame.columns)
    mine = sorted(repr([plain(x) for x in r]) for r in frame.select(columns).collect())
    if name in sqls:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        found = con.sql(sqls[name])
        order = [found.columns.index(c) for c in columns]
        assert sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall()) == mine
    assert len(mine) > 0


def test_every_sql_has_a_query():
    assert {k for plan in PLANS for k in plan.SQL} <= {k for plan in PLANS for k in plan.QUERIES}
    names = [k for plan in PLANS for k in plan.QUERIES]
    assert len(names) == len(set(names))
