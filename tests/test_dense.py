"""Blocked products against plain ones: ties, copies, several keys, vectors that have no product."""

import random

import pytest

from corpusloom.operators import search as sx
from corpusloom.operators.dense import nearest


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_blocks_lose_nothing(spark, limit):
    rng = random.Random(limit % 7)
    vector = lambda: [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]
    same = vector()
    docs = [(f"p{i:03}", same if i % 3 == 0 else vector()) for i in range(300)] + [("null", None), ("hole", [1.0, None, 0.0, 0.0]), ("nan", [float("nan"), 1.0, 1.0, 1.0]), ("short", [1.0, 1.0]), ("empty", [])]
    read = [(k, p) for p, _ in docs for k in ("a", "b") if k == "a" or rng.random() < 0.3]
    asked = [(i, rng.choice("ab"), vector()) for i in range(40)] + [(90, "c", vector()), (91, "a", None), (92, "a", [1.0, 2.0]), (93, "a", [float("inf")] * 4)]
    q, e, r = spark.createDataFrame(asked, "qid long, acl_key string, qv array<double>"), spark.createDataFrame(docs, "path string, embedding array<float>"), spark.createDataFrame(read, "acl_key string, path string")
    known, allowed = {p: v for p, v in docs if v and None not in v and v[0] == v[0]}, set(read)
    want = []
    for i, key, v in asked:
        near = [(-sum(a * b for a, b in zip(v, w)), p) for p, w in known.items() if v and len(v) == len(w) and abs(v[0]) < 9 and (key, p) in allowed]
        want += [(i, p, -s, n + 1) for n, (s, p) in enumerate(sorted(x for x in near if -x[0] > 0.1)[:5])]
    seen = e.join(r, "path")
    got = sx.candidate_pool(nearest(q, seen, 0.1, 5, rows=16, questions=8, broadcast_bytes=limit), 5, "cos")
    assert sorted((x.qid, x.path, x.cos, x["rank"]) for x in got.collect()) == sorted(want)
    assert sorted((x.qid, x.path, x.cos, x["rank"]) for x in sx.dense_topk(q, e, r, 0.1, 5).collect()) == sorted(want)
    assert nearest(q, seen, 0.1, 5, rows=16).count() <= 44 * 5 * 30
    assert sx.dense_topk(q.limit(0), e, r).count() == 0 and sx.dense_topk(q, e.limit(0), r).count() == 0
