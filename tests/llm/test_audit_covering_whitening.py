"""Filter audit, covering SimHash and whitening against brute-force versions, and their edge cases."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from corpusloom.llm import covering, filter_audit, whitening
from corpusloom.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, salt string, part string, n string, fp string"


def docs_of(spark, rows):
    """Rows of (doc_id, text[, lang]) beside extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "en")[:3] + ("x",) * 4 for r in rows], DOCS)


# --- op11 ---------------------------------------------------------------------------------------------------------


def failures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t))]


def audited(rows, labels):
    """{(part, order, step): counters} of rows (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    masks = []
    for i, text, lang in rows:
        same = [j for j, other, _ in rows if (other or "") == (text or "") and j is not None]
        masks.append([*failures(text), i is not None and min(same) < i])
    out, total = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for (i, _, lang), mask in zip(rows, masks):
            gone = False
            for step, f in enumerate(order, 1):
                fails = mask["ABCDE".index(f)]
                c = out.setdefault((lang or "", order, step), [0] * 6)
                here = fails and not gone
                for k, x in enumerate((not gone and not fails, here, fails and gone, fails and sum(mask) == 1, here and i in good, here and i in toxic)):
                    c[k] += x
                total[lang or "", f] = total.get((lang or "", f), 0) + here
                gone |= here
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_op11_equals_sql_and_enumeration(spark):
    got = audit_rows(filter_audit.op11_filter_audit(spark, SF))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = {tuple(r[:3]): tuple(r[3:]) for r in con.execute(filter_audit.OP11_SQL).fetchall()}
    assert got == want and len(got) == 600 * len({k[0] for k in got})
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, SF, "documents").select("doc_id", "text", "lang").collect()]
    assert got == audited(rows, [tuple(r) for r in table(spark, SF, "labels").select("doc_id", "quality", "toxic").collect()])


def test_op11_edges(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, None, "en"), (2, "", "en"), (3, long, None), (4, long, ""), (4, long, "en"), (5, "A" * 9, "de"), (None, long, "de"), (None, None, "de"),
        (6, "x " * 100_000, "fr"), (7, "x y " * 250, "fr"), (8, f"{long} #", "fr"), (9, f"{long} #", "en"), (-1, f"{long} #", "en"), (9, f"{long} #", "en"), (10, "  \x0b", "es"),
    ]
    labels = [(5, 1, 0), (5, 0, 1), (9, 1, 1), (4, 2, None), (None, 1, 1), (77, 1, 1)]
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, mask string")
    got = audit_rows(filter_audit.audit(filter_audit.mask_counts(docs_of(spark, rows), marks), "ABCDE"))
    assert got == audited(rows, labels)
    none = filter_audit.mask_counts(docs_of(spark, []), marks.limit(0))
    assert filter_audit.audit(none, "ABCDE").count() == 0


def test_packed_counters_do_not_overflow(spark):
    """Counts of 62 bits stay apart, and so do hot parts added up from many tasks."""
    n = 1 << 60
    rows = [("p", m, True, False, n) for m in (0, 1, 3)] + [(f"q{i}", 2, False, True, i + 1) for i in range(600)]
    counts = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long").repartition(7)
    got = audit_rows(filter_audit.audit(counts, "AB"))
    assert got["p", "AB", 1] == (n, 2 * n, 0, n, 2 * n, 0, 2 * n + n) and got["p", "AB", 2] == (n, 0, n, 0, 0, 0, n)
    assert got["p", "BA", 1] == (2 * n, n, 0, 0, n, 0, n) and got["p", "BA", 2] == (n, n, n, n, n, 0, 3 * n)
    assert all(got[f"q{i}", "BA", 1] == (0, i + 1, 0, i + 1, 0, i + 1, 2 * (i + 1)) for i in range(600))


# --- op12 ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(pairs, nodes):
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_pairs(prints, radius=2):
    x = np.array(prints, np.uint64)
    return [(a, int(b)) for a in range(len(x)) for b in np.flatnonzero(np.bitwise_count(x[a] ^ x[a + 1 :]) <= radius) + a + 1]


def test_covering_masks_cover():
    for radius in (1, 2, 3):
        for positions in (list(range(64)), list(range(5, 40, 3)), [7]):
            masks = covering.covering_masks(positions, radius)
            assert len(masks) == 2 ** (radius + 1) - 1 and all(not m & ~sum(1 << p for p in positions) for m in masks)
            for away in itertools.combinations(positions[:16], min(radius, len(positions))):
                assert any(not m & sum(1 << p for p in away) for m in masks)


def test_op12(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    got = {r.doc_id: r for r in covering.op12_covering_simhash(spark, SF).collect()}
    component = least_reachable([(rows[a].doc_id, rows[b].doc_id) for a, b in near_pairs(prints)], [r.doc_id for r in rows])
    assert len(got) == len(rows) and any(k != v for k, v in component.items())
    for r, p in zip(rows, prints):
        assert got[r.doc_id].fingerprint == f"{p:016x}" and got[r.doc_id].component_id == component[r.doc_id]


@pytest.mark.parametrize("small", [8, 64])
def test_full_buckets_lose_no_link(spark, small):
    """A ball of fingerprints that share most bits goes through several levels of tables."""
    draw = random.Random(small)
    prints = {draw.getrandbits(64)}
    while len(prints) < 400:
        p = draw.choice(sorted(prints))
        for _ in range(draw.choice([1, 2, 3])):
            p ^= 1 << draw.randrange(18)
        prints.add(p)
    prints = sorted(prints | {draw.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in covering.fingerprint_links(df, small=small, salts=3).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    assert least_reachable(links, prints) == least_reachable([(prints[a], prints[b]) for a, b in near_pairs(prints)], prints)


def test_op12_edges(spark):
    long = " ".join(f"w{i % 999}" for i in range(200_000))
    rows = [(3, None), (2, ""), (9, " \t\n"), (7, "one two"), (6, "ONE two"), (5, long), (1, f"{long} end"), (4, long), (4, long), (None, long), (None, None), (8, "a b c d"), (8, "x y"), (-5, "a b c d")]
    got = [tuple(r)[:3] for r in covering.near_fingerprints(docs_of(spark, rows)).collect()]
    assert len(got) == len(rows)
    prints = [plain_fingerprint(t) for i, t in rows if i is not None]
    nodes = [i for i, _ in rows if i is not None]
    # an id with two texts is linked by neither: each of its fingerprints has a component of its own
    named = least_reachable(near_pairs(prints), range(len(nodes)))
    least = {}
    for k, root in named.items():
        least[root] = min(least.get(root, nodes[k]), nodes[k])
    want = sorted((i, p, least[named[k]]) for k, (i, p) in enumerate(zip(nodes, prints)))
    assert sorted((i, p % (1 << 64), c) for i, p, c in got if i is not None) == want
    assert sorted((p % (1 << 64), c) for i, p, c in got if i is None) == sorted((plain_fingerprint(t), None) for i, t in rows if i is None)
    assert covering.near_fingerprints(docs_of(spark, [])).count() == 0
    kept = covering.deduplicate(docs_of(spark, rows)).select("doc_id", "part").collect()
    assert {r.doc_id for r in kept} == {None} | {c for _, _, c in got if c is not None} and all(r.part == "x" for r in kept)


# --- op13 ---------------------------------------------------------------------------------------------------------


def whitened(vectors, weights="one", most=16):
    """n, deviation, projections (up to sign) and shares, by numpy alone."""
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    u, c = np.unique(x, axis=0, return_counts=True)
    c = np.ones_like(c) if weights == "one" else c
    n, s = int(c.sum()), (u * c[:, None]).sum(axis=0)
    d = (n * u - s) / n
    e, v = np.linalg.eigh((d * c[:, None]).T @ d / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(axis=1), (n * x - s) / n @ v / np.sqrt(e), e / ((d * d).sum(axis=1) @ c / n)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_numpy(spark, weights):
    given = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in given] + [(10_000 + i, [float(c) for c in given[i % 3].embedding]) for i in range(300)]
    n, deviation, w, shares = whitened([v for _, v in rows], weights)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, key string")
    got = whitening.whiten(df, weights=weights, salts=4).toPandas()
    assert len(got) == 16 * len(rows) and (got.n == n).all() and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    table_ = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    assert np.allclose(table_ * np.sign(table_[0]), w * np.sign(w[0]), atol=1e-7)
    assert np.allclose(got.groupby("component").explained.first(), shares, rtol=1e-9)
    assert [int(x) for x in got[got.component == 1].set_index("vec_id").deviation.loc[[i for i, _ in rows]]] == deviation.tolist()


def test_op13(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    n, deviation, _, _ = whitened([r.embedding for r in rows])
    got = whitening.op13_whitening(spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    first = {r.vec_id: r for r in got.where("component = 16").collect()}
    assert [first[r.vec_id].deviation for r in rows] == deviation.tolist() and {r.n for r in first.values()} == {n}


def test_op13_edges(spark):
    schema = "vec_id long, embedding array<double>, salt string, x string, n string"
    made = lambda rows: spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema)
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, None), (3, [float("nan"), 1.0]), (4, [2.0, 1e9]), (5, [0.5, -3e13]), (None, [0.0, 0.0]), (7, [1e300, 0.0]), (8, [1.0]), (9, [None, 1.0]), (10, []), (11, [float("inf"), 0.0])]
    got = whitening.whiten(made(rows)).collect()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in rows if i in (1, 4, 5) or v == [0.0, 0.0]]
    u = [list(t) for t in {tuple(v) for v in x}]
    s = [sum(c) for c in zip(*u)]
    want = sorted((i or 0, sum((4 * c - t) ** 2 for c, t in zip(v, s))) for i, v in zip([1, 1, 4, 5, None], x))
    assert sorted((r.vec_id or 0, int(r.deviation)) for r in got if r.component == 1) == want and {r.n for r in got} == {4}
    assert whitening.whiten(made([(1, [1.0, 2.0])] * 3)).count() == 0 and whitening.whiten(made([])).count() == 0
    big = np.array([[2**60, -(2**60)], [2**60 - 1, 5]], np.int64)
    assert whitening.exact_sums(big, np.array([9, 9])).tolist() == [18, 9 * (2**61 - 1), 9 * (5 - 2**60)]
    n, s = 18, [9 * (2**61 - 1), 9 * (5 - 2**60)]
    assert whitening.numerators(big, n, s).tolist() == [[18 * int(c) - t for c, t in zip(row, s)] for row in big]
    with pytest.raises(ValueError):
        whitening.whiten(made(rows), weights="other")


# --- what the stages of the pipeline keep ---------------------------------------------------------------------------


def test_language_stage_follows_the_model(spark):
    """Words decide: text of no learned language goes, whatever its label; code-switched and short texts stay."""
    from corpusloom.llm import langid

    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    long = {r.lang: r.text for r in docs.where("length(text) between 800 and 4000").orderBy("doc_id").collect()}
    mixed = " ".join(w for t in zip(*(long[x].split()[:60] for x in sorted(long))) for w in t)
    rows = [(1, "Это русский текст, он написан кириллицей и ни на одном из языков. " * 2), (2, "这是一个 中文句子 没有空格 也没有字母 " * 6), (3, mixed), (4, "De. Это русский текст"), (5, None), (6, "12 34"), *((10 + i, t) for i, t in enumerate(long.values()))]
    kept = {r.doc_id for r in langid.keep_identified(docs_of(spark, rows), model).collect()}
    assert kept == {3, 4, *range(10, 10 + len(long))}
    assert {r.doc_id for r in langid.keep_identified(docs_of(spark, rows), None).collect()} == {i for i, _ in rows} - {5, 6}


def test_training_rows_are_picked_by_hash(spark):
    from corpusloom.llm import langid

    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    got = langid.training_rows(docs.union(docs.limit(50)), 7, salts=3)
    hashed = docs.where("lang is not null and text is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").selectExpr("lang", "text", "xxhash64(doc_id, 'langid') as h").collect()
    want = [(lang, r.text) for lang in sorted({r.lang for r in hashed}) for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:7]]
    assert [(r.lang, r.text) for r in got] == want
