import hashlib

import numpy as np
from pyspark.sql import functions as F

from strandlens.llm import repeats
from tests.llm.fixtures import awkward, documents, prose


def brute(texts, ids, size=50):
    first: dict[bytes, int] = {}
    data = [(t or "").encode() for t in texts]
    for x, i in zip(data, ids):
        if i is not None:
            for k in range(len(x) - size + 1):
                w = x[k : k + size]
                first[w] = min(i, first.get(w, i))
    out = []
    for x, i in zip(data, ids):
        gone = np.zeros(len(x) + 2, bool)
        for k in range(len(x) - size + 1):
            if i is not None and first[x[k : k + size]] < i:
                gone[k + 1 : k + 1 + size] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1])
        rest = bytes(b for b, g in zip(x, gone[1:]) if not g)
        out.append((i, len(x), int(gone.sum()), len(edges) // 2, hashlib.sha256(rest).hexdigest()))
    return out


def found(frame):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed_spans(frame).collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def texts_with_repeats():
    base, rng = prose(4, 300), np.random.default_rng(2)
    out = [t for t in awkward() if t is None or len(t) < 5000]
    for k in range(40):
        a, b = sorted(rng.integers(0, len(base), 2))
        own = prose(100 + k, 30)
        out.append(own[: len(own) // 2] + base[a:b] + own[len(own) // 2 :])
    out += ["a" * 49, "a" * 50, "a" * 51, "a" * 120, "ab" * 80, "b" + "ab" * 40, base[:49], base[10:59], base[10:60], base[100:151]]
    out += ["é" * 40 + base[5:70], "xé" * 30 + base[5:70], "\0" * 60 + "x", "\0" * 55]
    return out


def test_against_brute_force(spark, monkeypatch):
    texts = texts_with_repeats()
    order = np.random.default_rng(1).permutation(len(texts))
    rows = [(int(order[i]) * 3 - 20, t) for i, t in enumerate(texts)] + [(None, prose(4, 300)), (4, prose(4, 100)), (4, prose(4, 100))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).repartition(3)
    want = sorted(brute([t for _, t in rows], [i for i, _ in rows]), key=key)
    assert sorted(found(frame), key=key) == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("blocks_")]
    # many shards: the pieces are put together in order
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    assert sorted(found(frame), key=key) == want


def test_small_steps_and_blocks_give_the_same():
    data = np.frombuffer(prose(8, 2000).encode(), np.uint8)
    whole = repeats.Parse(data)
    assert (whole.last - whole.first < repeats.SPREAD).all() and whole.first[0] == 0 and whole.last[-1] == len(data) - repeats.SIZE
    assert (whole.first[1:] == whole.last[:-1] + 1).all()
    # equal windows have equal triggers, wherever they stand
    other = repeats.Parse(np.concatenate([np.frombuffer(b"zz top ", np.uint8), data[500:3000]]))
    trigger = {k: t for f, l, t in zip(whole.first, whole.last, whole.trigger) for k in range(f, l + 1)}
    for f, l, t in zip(other.first, other.last, other.trigger):
        assert all(trigger[k + 493] == t for k in range(max(f, 7), l + 1))


def test_no_rows(spark):
    assert repeats.removed_spans(documents(spark, [])).count() == 0
    assert sorted(found(documents(spark, [None, ""]))) == [(i, 0, 0, 0, hashlib.sha256(b"").hexdigest()) for i in (0, 1)]
