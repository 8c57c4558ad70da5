"""One automaton over many patterns against plain search, with numbers that must not be cut."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.functions import facts as fx
from corpusloom.operators import evaluation as ex
from corpusloom.operators import matching as mx
from corpusloom.operators import quality as qx


def test_occurrences_equal_plain_search(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choices("ab1 2é한", k=n))
    patterns = sorted({make(rng.choice([1, 2, 3])) for _ in range(60)}) + ["", None, "the cat"]
    texts = [(i, rng.choice("st"), make(rng.choice([0, 5, 40]))) for i in range(80)] + [(900, "s", "bathe cat"), (901, "s", None)]
    df, pf = spark.createDataFrame(texts, "id long, space string, text string").repartition(3), spark.createDataFrame([(p,) for p in patterns], "pattern string")

    def held(p, t):
        return any(not (p[0] in "12" and m > 0 and t[m - 1] in "12") and not (p[-1] in "12" and m + len(p) < len(t) and t[m + len(p)] in "12") for m in (m.start() for m in re.finditer(f"(?={re.escape(p)})", t)))

    for whole in (False, True):
        want = {(i, s, p) for i, s, t in texts if t for p in patterns if p and (held(p, t) if whole else p in t)}
        for limit in (mx.LIMIT, 20):  # one automaton, or several passes
            assert {tuple(r) for r in mx.occurring(df, pf, ["id", "space"], whole_numbers=whole, limit=limit).collect()} == want
        rows = [tuple(r) for r in mx.occurring(df, pf, ["space"], whole_numbers=whole).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == {(s, p) for _, s, p in want}
    assert mx.occurring(df, pf.limit(0), ["id"]).count() == 0
    plan = mx.occurring(df, pf, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_foreign_facts_need_no_first_word(spark):
    qa = spark.createDataFrame([("a", ["the cat", "12"], ["x"]), ("b", ["45분", "no"], []), ("c", ["the cat", "45분"], ["12"])], "space string, gold_facts array<string>, leak_facts array<string>")
    texts = spark.createDataFrame([("b", "bathe cat 112"), ("a", "총 45 분, x"), ("c", None), ("b", "12")], "space string, text string")
    got = {(r.space, r.fact): r.ambiguous for r in ex.foreign_facts(qa, texts).collect()}
    # facts of two characters of others do not count, declared ones do
    assert got == {("a", "the cat"): False, ("c", "the cat"): False, ("b", "45분"): False, ("c", "45분"): False, ("a", "x"): True, ("c", "12"): False}
    plan = ex.foreign_facts(qa, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join \w+, .*NOT \(home", plan)
    facts = [r.fact for r in qa.select(F.explode("gold_facts").alias("fact")).collect()]
    naive = {(f, t) for f in facts for t in ("bathe cat 112", "총 45 분, x")}
    df = spark.createDataFrame(list(naive), "fact string, t string")
    plain = {(r.f, r.t) for r in df.where(fx.fact_in("fact", "t")).select(fx.fact_normalize("fact").alias("f"), "t").collect()}
    one = mx.occurring(df.select("t").distinct(), df.select(fx.fact_normalize("fact").alias("pattern")), ["t"], fx.fact_normalize("t"), whole_numbers=True)
    assert {(r.pattern, r.t) for r in one.collect()} == plain


def test_rules_of_several_words(spark):
    docs = spark.createDataFrame([(1, "an idiot\ntrash and clown\nclown"), (2, ""), (3, None), (4, "trashclown idiots idiot")], "doc long, text string")
    rules = spark.createDataFrame([("insult", ["idiot"]), ("both", ["trash", "clown", ""]), ("twice", ["clown", "clown"]), ("nothing", [""]), ("none", None), ("insult", ["idiot"])], "term string, words array<string>")
    assert sorted(map(tuple, qx.absent_terms(docs, rules).collect())) == [(1, 0, "insult"), (1, 1, "both"), (1, 1, "twice"), (1, 2, "twice"), (4, 0, "both"), (4, 0, "insult"), (4, 0, "twice")]
