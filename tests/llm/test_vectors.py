"""Hard negatives and close vectors against all pairs, with odd rows, ties, dense groups and other block sizes; and against their SQL."""

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talentweave.llm import close_vectors, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, num long, x string, digest int"


def frame(spark, rows):
    return spark.createDataFrame([(v, x and [None if e is None else float(e) for e in x], y, 1, "x", 2) for v, x, y in rows], SCHEMA)


def random_rows(n, d, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, d))
    label = rng.integers(0, labels, n)
    x = centres[label] + rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, x[i].astype(np.float32).tolist(), int(label[i])) for i in range(n)]


ODD = [
    (350, None, 1), (351, [None, 1.0], 1), (352, [float("nan"), 1.0], 1), (353, [float("inf"), 1.0], 2), (354, [0.5] * 6, None), (None, [0.5] * 6, 2),
    (355, [], 3), (356, [0.0] * 6, 3), (357, [0.9], 3), (400, [1.0, 0, 0, 0, 0, 0], 1), (400, [1.0, 0, 0, 0, 0, 0], 1), (401, [-0.0, 1.0, 0, 0, 0, 0], 1), (402, [0.0, 2.0, 0, 0, 0, 0], 1),
    (450, [1.0, 0, 0, 0, 0, 0], 2), (451, [1.0, 0, 0, 0, 0, 0], 3), (500, [3e6, -2e6, 1.0, 0, 0, 0], 4), (501, [3e6, 1e6, 1.0, 0, 0, 0], 4), (502, [2e6, 1e6, 1.0, 0, 0, 0], 5),
]


def brute_negatives(rows):
    kept = [(v, (y + 1) % 10 if v % 7 == 0 else y, [int(np.floor(256 * float(np.float32(e)))) for e in x]) for v, x, y in rows
            if v is not None and y is not None and x is not None and all(e is not None and np.isfinite(e) for e in x)]
    out = Counter()
    for v, y, x in kept:
        if v % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, z)), w, u) for w, u, z in kept)
        for p, i, _ in [s for s in scored if s[2] == y and s[1] != v][:5]:
            inside = [s for s in scored if s[2] != y and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out.update((v, i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(inside))
    return out


@pytest.mark.parametrize(("tree", "leaf", "anchors"), [(2048, 128, 8192), (40, 7, 3)])
def test_negatives_equal_all_pairs(spark, monkeypatch, tree, leaf, anchors):
    for k, v in (("TREE", tree), ("LEAF", leaf), ("ANCHORS", anchors)):
        monkeypatch.setattr(hard_negatives, k, v)
    rows = random_rows(330, 6, 4, 5) + ODD
    found = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert Counter(tuple(r) for r in found) == brute_negatives(rows)
    assert [f for f in found if f.anchor_id == 500]


def test_negatives_of_no_rows_and_no_anchors(spark):
    assert hard_negatives.mine(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(frame(spark, random_rows(40, 3, 2, 1)[1:]), F.col("vec_id") % 50 == 0).count() == 0


def test_boxes_are_dropped_where_vectors_lie_apart():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((2048, 6)) * 10 + np.repeat(rng.standard_normal((16, 6)) * 3000, 128, 0)).astype(np.int64)
    tree = hard_negatives.Tree(np.arange(2048), x)
    seen = []
    searches = hard_negatives.Searches([{"num": 0, "vec_id": -1, "label": 1, "x": x[5].tolist(), "lows": [-(1 << 62)], "highs": [1 << 62]}], 3, True)
    searches._take = lambda a, s, i, take=searches._take: (seen.append(len(i)), take(a, s, i))
    searches.search(1, hard_negatives.Tree.unpacked(tree.packed()))
    score = x @ x[5]
    assert [i for _, i in searches.found[0][0]] == sorted(range(2048), key=lambda i: (-score[i], i))[:3]
    assert len(seen) <= 3


def brute_links(rows):
    fit = {}
    for k, (_, x, _) in enumerate(rows):
        if x and all(e is not None and np.isfinite(e) for e in x) and any(x):
            v = np.array(x, np.float32).astype(float)
            fit[k] = v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())
    near = {k: {j for j in fit if j != k and len(fit[j]) == len(fit[k]) and fit[j] @ fit[k] >= 0.95} for k in fit}
    name = {k: k for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for k in near:
            low = min([name[k], *(name[j] for j in near[k])])
            changed |= low != name[k]
            name[k] = low
    smallest = {}
    for k, c in name.items():
        v = rows[k][0]
        if v is not None:
            smallest[c] = min(v, smallest.get(c, v))
    return Counter((rows[k][0], len(near.get(k, ())), smallest.get(name[k]), rows[k][0] == smallest.get(name[k])) for k in range(len(rows)))


def chains(seed=8, d=24):
    """Dense groups, chains of vectors a little over and under the threshold apart, and equal rows."""
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in ((150, 0.02), (60, 0.045), (40, 0.06), (90, 0.15)):
        c = rng.standard_normal(d)
        c /= np.linalg.norm(c)
        out += list(c + rng.standard_normal((size, d)) * noise)
    at = rng.standard_normal(d)
    for _ in range(60):
        at = at / np.linalg.norm(at) + rng.standard_normal(d) * 0.05
        out.append(at)
    out += [out[7]] * 30 + [out[160]] * 3
    order = rng.permutation(len(out))
    return [(int(1000 + order[i]), np.asarray(v, np.float32).tolist(), 1) for i, v in enumerate(out)]


@pytest.mark.parametrize(("tile", "small"), [(512, 32), (16, 4)])
def test_links_equal_all_pairs(spark, monkeypatch, tile, small):
    monkeypatch.setattr(close_vectors, "TILE", tile)
    monkeypatch.setattr(close_vectors, "SMALL", small)
    rows = chains() + random_rows(200, 24, 3, 2) + ODD + [(None, [0.3] * 24, 1), (None, [0.3] * 24, 1)]
    found = Counter(tuple(r) for r in close_vectors.link(frame(spark, rows)).collect())
    assert found == brute_links(rows)


def test_links_of_no_rows(spark):
    assert close_vectors.link(frame(spark, [])).count() == 0
    assert Counter(tuple(r) for r in close_vectors.link(frame(spark, [(5, None, 1), (5, [], 1)])).collect()) == Counter({(5, 0, 5, True): 2})


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(1)
    lines, tables = close_vectors.plan(20_000)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 32))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y
    met = (close_vectors.keys_of(x, lines, tables) == close_vectors.keys_of(y, lines, tables)).any(1)
    assert met.mean() > 0.998
    far = rng.permutation(3000)
    assert (close_vectors.keys_of(x, lines, tables) == close_vectors.keys_of(y[far], lines, tables)).mean() < 1e-3


def test_queries_equal_their_sql(spark, tmp_path):
    rows = chains(3, 12) + random_rows(120, 12, 4, 9)
    rows = [(i, x, i % 4) for i, (_, x, _) in enumerate(rows)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    for query, sql in ((hard_negatives.op12_hard_negatives, hard_negatives.SQL), (close_vectors.op13_close_vectors, close_vectors.SQL)):
        want = con.execute(sql).df()
        got = query(spark, path).toPandas()[want.columns.tolist()]
        by = want.columns.tolist()
        pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True), check_dtype=False)
