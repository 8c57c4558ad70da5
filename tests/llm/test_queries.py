"""The registered queries on whole small tables, against brute-force versions of their contracts."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import chain, decontaminate, langid, mixing, onebit, pii_lstm, token_orc, toxicity
from corpusloom.llm.common import scratch_dir, table

SF = "/root/testdata/sf0.001"


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents").collect()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    scores, trans, start = rng.standard_normal((5, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    paths = np.array(np.meshgrid(*[range(3)] * 5, indexing="ij")).reshape(5, -1).T
    weight = np.array([start[p[0]] + scores[range(5), p].sum() + trans[p[:-1], p[1:]].sum() for p in paths])
    chance = np.exp(weight - weight.max()) / np.exp(weight - weight.max()).sum()
    want = np.array([[chance[paths[:, t] == y].sum() for y in range(3)] for t in range(5)])
    assert np.allclose(chain.marginals(scores[:, None], np.array([5]), trans, start)[0][:, 0], want)
    for segment in (1, 2, 3, 64):
        assert np.allclose(chain.flat_marginals(scores, np.array([5]), trans, start, segment), want)
    assert chain.viterbi(scores, trans, start) == paths[weight.argmax()].tolist()


def test_flat_marginals_of_many_sequences():
    rng = np.random.default_rng(3)
    lengths = np.array([0, 1, 7, 200, 0, 64, 65, 3, 128])
    scores, trans, start = rng.standard_normal((lengths.sum(), 4)) * 4, rng.standard_normal((4, 4)) * 2, rng.standard_normal(4)
    got, at = chain.flat_marginals(scores, lengths, trans, start), 0
    for n in lengths:
        if n:
            assert np.allclose(got[at : at + n], chain.marginals(scores[at : at + n, None], np.array([n]), trans, start)[0][:, 0])
        at += n
    assert chain.flat_marginals(np.zeros((0, 2)), np.array([0]), np.zeros((2, 2)), np.zeros(2)).shape == (0, 2)


def test_op1_langid(spark, documents):
    model = langid.fit(table(spark, SF, "documents"))
    got = {r.doc_id: r for r in langid.op1_langid(spark, SF).collect()}
    assert len(got) == len(documents)
    right = []
    for d in documents:
        r, words = got[d.doc_id], langid.words_of(d.text)
        assert r.held_out == (crc(d.doc_id) % 4 == 2)
        if not any(c.isalpha() for c in d.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        model._learn([w for w in dict.fromkeys(words) if w not in model.rows])
        scores = model.table[[model.rows[w] for w in words]].astype(float)
        mean = chain.marginals(scores[:, None], np.array([len(words)]), model.trans, model.start)[0][:, 0].mean(axis=0)
        assert r.lang_pred == model.languages[mean.argmax()] and abs(r.score - mean.max()) < 1e-6
        if r.held_out and d.lang:
            right.append(r.lang_pred == d.lang)
    assert np.mean(right) > 0.9


def test_other_numbers_are_no_letters(spark):
    assert langid.words_of("² ½ ① Ⅷ 12 _") == [] and langid.words_of("a²b É") == ["a", "b", "é"]
    df = spark.createDataFrame([(1, "² ½ ①", "en"), (2, "x²", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.identify(df, langid.fit(df)).collect()} == {1: True, 2: False}


def test_op2_mixing(spark, documents):
    got = collections.defaultdict(list)
    for r in mixing.op2_mixing(spark, SF).collect():
        got[r.doc_id].append(r)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = collections.Counter()
    for d in documents:
        per[d.source] += size(d.text)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight, free = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names)
    goal, rest = {}, 1.5 * sum(per.values())
    while True:
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * per[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * per[s]
        rest, free = 1.5 * sum(per.values()) - sum(goal.values()), free - set(over)
    goal |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    taken = collections.Counter()
    for d in documents:
        for r in got[d.doc_id]:
            assert r.source_size == per[d.source] and r["size"] == size(d.text) and abs(r.target - goal[d.source]) < 1e-6 * max(1, goal[d.source])
            assert 0 <= r.taken <= 2 * r["size"]
            taken[d.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names)


def test_mixing_carries_columns_with_any_name(spark):
    names = ["_hash", "_nth", "_ranges", "_d", "_k", "mix_hash", "mix_nth", "mix_ranges"]
    rows = [(i % 7, f"w{i} x y z", "s", *range(i, i + len(names))) for i in range(40)] + [(1, "same words here", "s", *[k] * len(names)) for k in (5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    out = mixing.mix_documents(df, block=4)
    assert out.columns == df.columns
    known = {(r.doc_id, *[r[n] for n in names]) for r in df.collect()}
    assert all((r.doc_id, *[r[n] for n in names]) in known for r in out.collect())


def test_op4_repeated_ids_are_searched_once(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((61, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, v[20].tolist()), (20, v[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    use = onebit.usable(df)
    found = collections.defaultdict(list)
    for r in onebit.nearest(use, use.where("vec_id % 20 = 0"), k=20, group_rows=2).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert {q: len(x) for q, x in found.items()} == {0: 20, 20: 20, 40: 20, 60: 20}
    assert len(set(found[20])) == 20 and 20 not in found[20]


def test_op4_onebit(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in table(spark, SF, "embeddings").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    found = collections.defaultdict(dict)
    for r in onebit.op4_onebit_ann(spark, SF).collect():
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hit = total = 0
    for q, ranks in found.items():
        score = onebit.exact(rows[q], x)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]].tolist()
        assert sorted(ranks) == list(range(1, 21)) and all(s == score[np.searchsorted(ids, v)] for v, s in ranks.values())
        hit, total = hit + len(set(best) & {v for v, _ in ranks.values()}), total + 20
    assert hit / total >= 0.9


def test_op6_pii(spark, documents):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and pii_lstm.luhn(re.sub(r"\D", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    got = {r.doc_id: r for r in pii_lstm.op6_pii(spark, SF).collect()}
    for d in documents:
        base = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds.values()) for m in re.finditer(p, d.text or "") if ok(m[0]))
        names = list(kinds)
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(text.split(",") if text else []) <= set(spans)
        assert [r[f"n_{n}"] for n in names] == [sum(s.startswith(n + ":") for s in spans) for n in names]


def test_op6_finds_what_patterns_miss():
    net = pii_lstm.fit()
    said = {"call our office on 020 7946 0958 before friday": (3, "020 7946 0958"), "the desk answers at 555-123-4567 all day": (3, "555-123-4567"), "write to anna.smith@ example.org about it": (0, "anna.smith@ example.org"), "paid by 4111/1111/1111/1111 on the phone": (2, "4111/1111/1111/1111"), "server 10 . 0 . 0 . 1 is down again": (1, "10 . 0 . 0 . 1")}
    none = ["version 3.11.2 of the program", "on 24.12.2023 at noon", "order #12345678 has left", "it costs 1,299.00 EUR in all", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" here', "ISBN 978-3-1614-8410-0 is a book"]
    texts = [*said, *none]
    found = pii_lstm.added_spans(net, texts, [pii_lstm.base_spans(t) for t in texts])
    hits = sum((kind, piece) in [(k, t[a:b]) for a, k, b in spans] for (t, (kind, piece)), spans in zip(said.items(), found))
    assert hits >= 4 and not any(found[len(said) :])
    assert pii_lstm.base_spans("000000000000000000000001.2.3.4") == [(0, 1, 30)]


def test_op7_decontaminate(spark, documents):
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for b in table(spark, SF, "benchmark").collect():
        w = words_of(b.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(b.item_id))
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in decontaminate.op7_decontaminate(spark, SF).collect()}
    for d in documents:
        w, hit, items = words_of(d.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    items |= found
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_decontamination_ignores_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, text, ["a"], [1], "k"), (2, "clean words", None, None, None), (3, None, ["b"], [2], "k")], "doc_id long, text string, _items array<string>, _hits array<int>, key string")
    bench = spark.createDataFrame([(1, text), (2, "some other question")], "item_id long, text string")
    for chars in (10_000_000, 50):
        clean = decontaminate.contamination(df, bench, block_chars=chars, drop=True)
        assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3]
        assert {r.doc_id: r.n_hit for r in decontaminate.contamination(df, bench, block_chars=chars).collect()} == {1: 12, 2: 0, 3: 0}


def test_op9_toxicity(spark, documents):
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    scorer = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, SF).collect()}
    assert len(got) == len(documents)
    for d in documents:
        r = got[d.doc_id]
        assert r.held_out == (crc(d.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.5) and abs(r.score - scorer.score(d.text)) < 1e-12
    held = [(got[i].score, y) for i, y in labels.items() if i in got and y is not None and got[i].held_out]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) >= max(np.mean([y == 0 for _, y in held]), 0.8)


def test_toxicity_labels_given_twice(spark):
    docs = spark.createDataFrame([(1, "a zork here"), (1, "another text"), (2, "plain words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).coef == toxicity.fit(docs, labels.orderBy("toxic")).coef
    assert toxicity.copy_weights(["a b c d", "a b c d", "x y z"]) == [0.5, 0.5, 1.0]


def test_orc_files_have_stripes_runs_and_bloom_filters(spark):
    import pyarrow.orc as po

    rows = [(i, "some words " * 30) for i in range(20_000)]
    path = token_orc.write_token_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), scratch_dir(spark, "t"), row_index_stride=1000, stripe_mb=1)
    files = [f for f in table_files(path) if f.endswith(".orc")]
    assert sum(po.ORCFile(f).nrows for f in files) == 20_000
    assert all(po.ORCFile(f).compression == "ZSTD" and po.ORCFile(f).row_index_stride == 1000 for f in files)
    # runs: ids that repeat take a small part of the four bytes each that they would take alone
    n_ids = sum(len(r.ids) for r in token_orc.read_token_ids(spark, path).select("ids").collect())
    assert sum(po.ORCFile(f).content_length for f in files) < n_ids
    got = token_orc.read_token_ids(spark, path).where("doc_id in (7, 19999)").select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == [7, 19_999]


def table_files(path):
    import glob

    return glob.glob(f"{path.removeprefix('file:')}/*")


def test_pipeline(spark, documents):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    named = {n for n, _ in cp.STAGES}
    assert named == {"language", "near_duplicates", "decontamination", "mixture", "token_files"}
    stages = dict(cp.STAGES)
    kept = {r.doc_id for r in stages["language"](spark, docs, SF).collect()}
    assert kept == {d.doc_id for d in documents if any(c.isalpha() for c in d.text or "")}
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    out = cp.run(spark, SF).orderBy("start").collect()
    assert out and {r.doc_id for r in out} <= kept
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
