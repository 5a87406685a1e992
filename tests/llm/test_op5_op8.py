from __future__ import annotations

import math


import numpy as np
from quire.llm import op5_topk, op8_embeddings
from quire.llm.vectors import matrix

from .helpers import closed

SCHEMA = "vec_id long, embedding array<double>, label int, g int, d double, v string, rep long, many long, chunk long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 1.0, "x", 1, 1, 1) for i, v, l in rows], SCHEMA).repartition(3)


def vectors(n: int, dim: int = 12, seed: int = 1, copies: int = 0):
    rnd = np.random.default_rng(seed)
    rows = [(i, rnd.standard_normal(dim).tolist(), i % 3) for i in range(n)]
    for k in range(copies):
        i, v, l = rows[int(rnd.integers(n))]
        rows.append((n + k, v if k % 4 == 0 else (np.array(v) + rnd.standard_normal(dim) * 0.15).tolist(), l))
    return rows


ODD = [(9001, None, 1), (9002, [1.0, None] + [0.0] * 10, 1), (9003, [float("nan")] + [1.0] * 11, 1), (9004, [float("inf")] + [1.0] * 11, 1), (None, [1.0] * 12, 1), (9050, [2.0, 1.0], 2), (9100, [], 0)]


def test_top_k(spark):
    rows = vectors(700, copies=60) + ODD
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(256 * x) for x in v] + [0] * (12 - len(v))
    want = []
    for q in ok:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = [tuple(r) for r in op5_topk.top_k(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want)


def test_top_k_with_many_pivots_ties_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(op5_topk, "PER_PIVOT", 2)
    monkeypatch.setattr(op5_topk, "ROWS", 64)
    rows = [(i, [1.0 if i % 2 else -1.0, float(i % 7)], 0) for i in range(600)]
    v = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows}
    want = []
    for q in range(0, 600, 50):
        best = sorted(((-(v[q][0] * w[0] + v[q][1] * w[1]), i) for i, w in v.items() if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in op5_topk.top_k(frame(spark, rows)).collect()) == want
    few = rows[:3] + rows[:2]  # fewer than k others, and a query id of two rows
    assert sorted(tuple(r) for r in op5_topk.top_k(frame(spark, few)).collect()) == brute_top(few)
    assert [tuple(r)[:3] for r in sorted(op5_topk.top_k(frame(spark, rows[:3])).collect())] == [(0, 1, 2), (0, 2, 1)]
    assert op5_topk.top_k(frame(spark, [])).count() == 0


def brute_top(rows, k=5):
    """As the SQL of the query has it: every row with another id is a candidate, and a query id's rows share its best."""
    v = [(i, np.array([math.floor(256 * x) for x in e])) for i, e, _ in rows]
    out = []
    for me in {i for i, _ in v if i % 50 == 0}:
        found = sorted((-int(a @ b), j) for i, a in v if i == me for j, b in v if j != me)[:k]
        out += [(me, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_top_k_with_repeated_ids_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(op5_topk, "PER_PIVOT", 3)
    rnd = np.random.default_rng(8)
    rows = [(int(rnd.integers(0, 400)), rnd.standard_normal(6).tolist(), 0) for _ in range(500)]
    one = [3.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows += [(i, one, 0) for i in range(300, 420)] + [(301, one, 0)] * 30 + [(350, one, 0), (1, [9.0] + [1.0] * 5, 0), (1, [-9.0] + [1.0] * 5, 0)]
    assert sorted(tuple(r) for r in op5_topk.top_k(frame(spark, rows)).collect()) == brute_top(rows)


def test_bounds_rule_out_far_groups(spark, monkeypatch):
    monkeypatch.setattr(op5_topk, "PER_PIVOT", 4)
    names, counts, keep = [], {}, op5_topk.stage

    def counted(df, name):
        out = keep(df, name)
        counts[name] = out.count()
        names.append(name)
        return out

    monkeypatch.setattr(op5_topk, "stage", counted)
    rnd = np.random.default_rng(9)
    middle = rnd.standard_normal((12, 16)) * 4
    rows = [(i, (middle[i * 7 % 12] / np.linalg.norm(middle[i * 7 % 12]) + rnd.standard_normal(16) * 0.02).tolist(), 0) for i in range(2400)]
    assert sorted(tuple(r) for r in op5_topk.top_k(frame(spark, rows)).collect()) == brute_top(rows)
    assert counts["replicated"] < counts["data"]  # to all other query groups it would be 11 times the data


def brute_links(rows, threshold=0.93):
    ok = [(i, np.array(v + [0.0] * (12 - len(v))), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for x, (i, a, l) in enumerate(ok):
        for j, b, m in ok[x + 1 :]:
            if l == m and float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)) >= threshold:
                links.append((i, j))
    ids = [i for i, _, _ in rows if i is not None]
    low = closed(ids, links)
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], low[i], low[i] == i) for i in ids}


def test_near_duplicates(spark):
    rows = vectors(300, copies=200, seed=2) + ODD + [(9200, [0.0] * 12, 1), (9201, vectors(1)[0][1], None)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op8_embeddings.near_duplicates(frame(spark, rows)).collect() if r.vec_id is not None}
    assert got == brute_links(rows)


def test_large_cells_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(op8_embeddings, "CHUNK", 16)
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal(12)
    rows = [(i, (base + rnd.standard_normal(12) * 0.2).tolist(), 1) for i in range(150)] + [(200 + i, (base * 3).tolist(), 1) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op8_embeddings.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_empty_and_repeated(spark):
    assert op8_embeddings.near_duplicates(frame(spark, [])).count() == 0
    got = op8_embeddings.near_duplicates(frame(spark, [(1, [1.0, 2.0], 1)] * 3 + [(None, None, None)])).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [("1", 2, 1, True)] * 3 + [("None", 0, None, True)]


def test_pigeonhole_budgets_cover_the_distance():
    for dim in (1, 3, 8, 12, 64, 65):
        plan = op8_embeddings.layout(dim, 0.93)
        assert plan[0][0] == 0 and plan[-1][1] == dim and sum(r * r for _, _, r in plan) >= 2 * 0.07


def test_spanning_edges_join_what_all_edges_do():
    rnd = np.random.default_rng(4)
    low, edges, used = np.arange(200), [], []
    for _ in range(5):
        u, v = rnd.integers(0, 200, 90), rnd.integers(0, 200, 90)
        found = op8_embeddings.spanning(low, u, v)
        edges += zip(u.tolist(), v.tolist(), strict=True)
        used += zip(u[found].tolist(), v[found].tolist(), strict=True)
        want = closed(range(200), edges)
        assert low.tolist() == [want[i] for i in range(200)] and closed(range(200), used) == want
        assert len(used) == 200 - len(set(want.values()))


def test_matrix():
    import pyarrow as pa

    rows, x = matrix(pa.array([[1.0, 2.0], None, [3.0], [None, 1.0], []], pa.list_(pa.float32())))
    assert rows.tolist() == [0, 2, 4] and x.tolist() == [[1, 2], [3, 0], [0, 0]]

