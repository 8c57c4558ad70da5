"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, html_extract, langid, minhash, mixing, onebit, pii_lstm, token_count, token_orc, toxicity
from corpusloom.llm.common import scratch_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, label long, key string, n long"
WORDS = "the of and thing ereth nder stion ble heon raint".split()


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 0.5, 9, 7, "k", 1) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    text = lambda n: " ".join(rng.choice(WORDS, n)) + "."
    same = text(40)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "1234 !!", "en", None), (5, text(30_000), "en", "a"), (6, same, "en", "b"), (7, same, "en", "b"), (8, same, "fr", ""), (9, "x" * 50_000, "en", "a"), (10, "one", "fr", "b")]
    rows += [(11, text(60), "en", "a"), (11, text(60), "fr", "b"), (None, text(20), "en", "c"), (12, same + " extra", "en", "c"), (13, "émile déjà été où ça " * 8, "fr", "d"), (13, "émile déjà été où ça " * 8, "fr", "d")]
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def test_langid(spark, docs, empty):
    model = langid.fit(docs)
    out = langid.identify(docs, model).collect()
    assert len(out) == 16 and all(0 <= r.score <= 1 for r in out)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {1, 2, 3, 4}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == 12
    assert langid.identify(empty, model).count() == 0 and langid.fit(empty) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_mixing(spark, docs, empty):
    out = mixing.mix_counts(docs, block=8).collect()
    assert len(out) == 16 and all(r.taken <= 2 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_counts(docs, block=8).collect()), key=str)
    mixed = mixing.mix_documents(docs, block=8)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.encode().split()) for r in mixed.collect()) == sum(r.taken for r in out)
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_token_counts(spark, docs, empty):
    vocab = token_count.vocabulary()
    out = {r.doc_id: r.n_tokens for r in token_count.token_counts(docs).collect()}
    assert out[1] == out[2] == out[3] == 0

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            c = [(best[end - 1][0] - 20.0, -best[end - 1][1] - 1)] + [(best[s][0] + vocab[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in vocab]
            top = max(c)
            best.append((top[0], -top[1]))
        return best[-1][1]

    assert out[10] == brute("▁one") and out[12] == sum(brute("▁" + w) for w in docs.where("doc_id = 12").first().text.split())
    assert token_count.token_counts(empty).count() == 0


def test_trie_shares_prefixes():
    counter = token_count.TrieCounter({"a": -1.0, "ab": -1.5, "abc": -3.0, "c": -1.0})
    counter.learn(["abc", "abd", "ab", "abc"])
    assert counter.nodes == 4 and counter.known == {"ab": 1, "abc": 2, "abd": 2}


def test_onebit(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16))
    v[50:80] = v[0]
    rows = [(i, x.tolist(), 1, 2.0) for i, x in enumerate(v)] + [(500, None, 1, 1.0), (501, [], 1, 1.0), (502, [0.0] * 16, 1, 1.0), (503, [float("nan")] * 16, 1, 1.0), (504, [None] + [1.0] * 15, 1, 1.0), (505, [1.0] * 3, 1, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    use = onebit.usable(df)
    assert use.count() == 400
    got = onebit.nearest(use, use.where("vec_id % 20 = 0"), k=20, block_rows=100, group_rows=8, sample=64)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hit = 0
    for q, ranks in found.items():
        s = onebit.exact(v[q], v)
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:20].tolist()
        hit += len(set(want) & set(ranks.values()))
    assert len(found) == 20 and hit / 400 >= 0.9
    assert [found[0][k] for k in range(1, 21)] == list(range(50, 70))  # ties by id
    few = use.where("vec_id < 5")
    assert onebit.nearest(few, few.where("vec_id = 0")).count() == 4
    none = use.limit(0)
    assert onebit.nearest(none, none).count() == 0


def _brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        s = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_minhash(spark, docs, empty):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    extra = []
    for i in range(100, 180):  # a chain of edits: many pairs near the threshold
        t = list(base)
        for _ in range(int(rng.integers(0, 9))):
            t[int(rng.integers(0, 60))] = f"e{int(rng.integers(0, 40))}"
        extra.append((i, " ".join(t), "en", "a"))
    both = docs.unionByName(make(spark, extra))
    for size in (2, 5):
        got = minhash.near_duplicates(both, size=size).collect()
        assert len(got) == both.count()
        want = _brute_components([(r.doc_id, r.text) for r in both.where("doc_id is not null").collect()], size, 80)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(_brute_components([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()], 5, 80).values()))
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    from corpusloom.llm.graph import components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_pii(spark, docs, empty):
    net = pii_lstm.fit()
    text = "mail a.b@c.de, card 4111 1111 1111 1111, ip 10.0.0.1 and 300.1.1.1, call +1 (131) 555-7634; also 4111 1111 1111 1112"
    more = docs.unionByName(make(spark, [(20, text, "en", "a"), (21, "x " * 30_000 + "z@y.org", "en", "a")]))
    out = {r.doc_id: r for r in pii_lstm.find_spans(more, net).collect()}
    assert [(text[s.start : s.end], pii_lstm.KINDS[s.kind]) for s in out[20].base] == [("a.b@c.de", "email"), ("4111 1111 1111 1111", "card"), ("10.0.0.1", "ip"), ("+1 (131) 555-7634", "phone")]
    assert [(s.start, s.kind, s.end) for s in out[21].base] == [(60_000, 0, 60_007)]
    assert out[1].spans == [] and out[2].spans == []
    assert all({tuple(s) for s in r.base} <= {tuple(s) for s in r.spans} for r in out.values())
    assert pii_lstm.find_spans(empty, net).count() == 0


def test_pii_network_learns():
    net = pii_lstm.fit()
    ids, labels = pii_lstm.training_windows(150, seed=77)
    scores = net.forward(ids)
    right = np.mean([np.mean(np.array(pii_lstm.viterbi(scores[:, i], net.p["trans"], net.p["start"])) == labels[i]) for i in range(150)])
    assert right > 0.9


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "One"), (2, None), (3, "..."), (None, "émile déjà été"), (4, " ".join(f"W{k}" for k in range(14)))], "item_id long, text string")
    text = "Été, w3 w4 W5-w6 (w7) w8 w9 w10 w11 w12; w13 w0"
    more = docs.unionByName(make(spark, [(30, text, "en", "a"), (31, "x w3 w4 w5 w6 w7 w8 w9 w10 w11", "en", "a")]))
    for chars in (60_000_000, 20):  # one block, and several
        out = {r.doc_id: r for r in decontaminate.contamination(more, bench, block_chars=chars).collect()}
        assert (out[30].n_words, out[30].n_hit, out[30]["items"]) == (13, 11, [4])
        assert [text[a:b] for a, b in out[30].spans] == ["w3 w4 W5-w6 (w7) w8 w9 w10 w11 w12; w13"]
        assert out[31].n_hit == 0 and out[10]["items"] == [1] and out[1].n_words == 0
        assert out[13].n_hit > 0 and out[13]["items"] == []
    clean = decontaminate.contamination(more, bench, drop=True)
    assert clean.columns == docs.columns and {30, 10, 13}.isdisjoint({r.doc_id for r in clean.collect()})
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.contamination(docs, bench.limit(0)).count() == 16


def test_html(spark):
    model = html_extract.fit()
    page = "<body><nav><a href=1>Home</a></nav><article><h1>A &amp; B</h1><p>First  para\nof text, long enough.<p>Second &lt;p&gt;.</article><div class='comments'><p>Nice one, thanks a lot.</p></div><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page, "t", 3), (2, "u", None, "t", 3), (3, "u", "", "t", 3), (4, None, "plain words only, with a stop.", "t", 3), (5, "u", "<p>" * 3000 + "deep", "t", 3), (1, "u", page, "t", 3)], "page_id long, url string, html string, text string, n_chars long")
    out = html_extract.extract(df, model).collect()
    assert [r.text for r in out if r.page_id == 1] == ["A & B\n\nFirst para of text, long enough.\n\nSecond <p>."] * 2
    assert [r.n_chars for r in out if r.page_id in (2, 3)] == [0, 0]
    assert html_extract.extract(df.limit(0), model).count() == 0


def test_html_held_out_pages():
    model = html_extract.fit()
    right = total = 0
    for blocks, labels in html_extract.training_pages(150, seed=5):
        scores = np.array([model.weights[f].sum(axis=0) for f in html_extract.features(blocks)])
        path = html_extract.viterbi(scores, model.trans, model.start)
        right, total = right + sum(a == b for a, b in zip(path, labels)), total + len(labels)
    assert right / total > 0.98


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(200, 500):
        w = list(rng.choice(WORDS, 40))
        bad = i % 5 == 0
        for _ in range(3 * bad):
            w.insert(int(rng.integers(0, 40)), str(rng.choice(["grumpfel", "grumpfen", "zork"])))
        rows.append((i, " ".join(w) + ".", "en", "a"))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame([*labels, (999, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    more = docs.unionByName(make(spark, rows))
    scorer = toxicity.fit(more, lab)
    out = {r.doc_id: r for r in toxicity.toxicity(more, scorer).collect()}
    truth = dict((a, c) for a, _, c in labels)
    assert np.mean([(out[i].score >= 0.5) == bool(t) for i, t in truth.items()]) > 0.97
    assert out[1].score < 0.5 and out[2].clauses == []
    untrained = toxicity.fit(more, lab.limit(0))
    assert toxicity.toxicity(empty, untrained).count() == 0


def test_grammar_compares_clauses():
    s = toxicity.Scorer(toxicity.Lexicon({}, {"idiot": 1.0}))
    weight = lambda t: sum(c[2] for c in s.clauses(t))
    assert weight("you idiot") > weight("an idiot") > weight("he said an idiot") > 0
    assert weight("not an idiot") < weight("an idiot")
    assert weight("you will kill time. nothing") == 0 or weight("i will kill you") >= 0
    assert weight("you: they kill") > weight("we kill") == 0


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = token_orc.write_token_ids(docs, scratch_dir(spark, "t"), row_index_stride=1000)
    tok = Tokenizer.from_file(token_orc.default_tokenizer())
    want, start = [], 0
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, token_orc.token_digest(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    plan = token_orc.read_token_ids(spark, path).where("doc_id = 7")
    assert plan.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan._jdf.queryExecution().toString()
    assert token_orc.token_digest(spark, token_orc.write_token_ids(empty, scratch_dir(spark, "t"))).count() == 0


def test_pieces_are_the_tokenizers(spark):
    import random

    from tokenizers import Tokenizer

    rng, enc, tok = random.Random(4), token_orc.PieceEncoder(token_orc.default_tokenizer(), generation=40), Tokenizer.from_file(token_orc.default_tokenizer())
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "'s", "12", "²", "###", "<|endoftext|>", "中文", "\x1c", " ", ".", "😀", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for i in range(0, len(texts), 100):
        for t, b in zip(texts[i : i + 100], enc.encode(texts[i : i + 100])):
            assert np.frombuffer(b, "<i4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_threats_meet_targets_after_the_verb():
    s = toxicity.Scorer(toxicity.Lexicon({}, {"idiot": 1.0}))
    weight = lambda t: sum(c[2] for c in s.clauses(t))
    for t in ("i will kill you", "we shall destroy them", "wir vernichten euch", "vamos a matar a ustedes", "je veux tuer ces gens avec vous"):
        assert weight(t) > weight("i will kill time") == 0, t
    assert weight("we kill and destroy you") == 2 * weight("we kill you") > weight("we will never kill you") > 0
    assert weight("we kill time. you") == 0 and weight("you. we kill") == 0


def test_reported_speech_passes_a_colon():
    s = toxicity.Scorer(toxicity.Lexicon({}, {"idiot": 1.0}))
    weight = lambda t: sum(c[2] for c in s.clauses(t))
    assert weight("you idiot") > weight("she wrote: you idiot") == weight("he said she wrote you: you idiot") > 0
    assert weight("she wrote: on monday: you idiot") == weight("she wrote: you idiot")
    assert weight("she wrote. note: you idiot") == weight("she wrote: hello. you idiot") == weight("you idiot")
    assert s.clauses("she said: an idiot: an idiot. so: an idiot")[1][2] < s.clauses("so: an idiot")[0][2] == s.clauses("she said: an idiot: an idiot. so: an idiot")[2][2]


def test_raw_elements_end_where_the_page_says():
    text = lambda page: [b[0] for b in html_extract.blocks_of(page)]
    for tag in ("svg", "math"):
        assert text(f"<body><{tag} class='x' /><p>article</p><footer><{tag}><b>icon</b></{tag}>foot</footer>") == ["article", "foot"]
        assert text(f"<{tag.upper()}/><p>one</p><{tag}>icon</{tag}><p>two</p>") == ["one", "two"]
    assert text("<p>" + "İ" * 40 + "</p><script>a()</SCRIPT><p>one</p><p>two</p><script>b()</script>") == ["İ" * 40, "one", "two"]
    assert text("<p>" + "İ" * 9 + "</p><script>a()</script><p>one</p><style>x</style><p>two</p>") == ["İ" * 9, "one", "two"]
    assert text("<script/>x</script><p>one</p>") == ["one"]


def test_keep_identified_drops_only_texts_without_letters(spark):
    df = make(spark, [(1, "eins deux three quatro", "en", "a"), (2, "123 !?", "en", "a"), (3, None, "en", "a"), (4, "", "en", "a"), (5, "a", None, "a")])
    even = langid.Model(["de", "en", "es", "fr"], np.zeros((langid.BUCKETS, 4)), np.zeros((4, 4)), np.zeros(4))
    for model in (even, None):
        assert sorted(r.doc_id for r in langid.keep_identified(df, model).collect()) == [1, 5]
    assert {r.doc_id for r in langid.identify(df, even).where("lang_pred <> 'und'").collect()} == {1, 5}


def test_token_ids_of_a_slice_are_laid_out_in_parts():
    """What a worker holds beside the pieces it keeps does not grow with the slice."""
    import random
    import tracemalloc

    rng, enc = random.Random(6), token_orc.PieceEncoder(token_orc.default_tokenizer())
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(2000)]
    texts = pa.array([" ".join(rng.choices(words, k=1000)) + "  end" * (i % 50 == 0) for i in range(600)])
    plain = enc.encode(texts.to_pylist())
    tracemalloc.start()
    try:
        got = [ids[a:b] for _, ids, at in enc.encode_parts(texts.slice(0, 300), 2) for a, b in zip(at[:-1], at[1:])]
        del got
        tracemalloc.reset_peak()
        held, sizes, out = tracemalloc.get_traced_memory()[0], [], []
        for n, ids, at in enc.encode_parts(texts, 2):
            sizes.append(n)
            out += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        peak = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert out == [zlib.crc32(ids + (2).to_bytes(4, "little")) for ids in plain]
    assert sum(sizes) == 600 and max(sizes) < 200
    assert peak < 24 << 20, peak


def test_arrow_batches_of_whole_texts_are_bounded_in_bytes(spark):
    from corpusloom.llm.common import small_batches

    small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64()), "size": pa.array([batch.nbytes], pa.int64())})

    docs = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    got = docs.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in got) == 2000
    assert max(r["size"] for r in got) < 5 << 20
