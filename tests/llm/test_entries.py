"""Registered queries that have no SQL, called whole, against brute-force versions of what they return."""

import collections
import re
import zlib

import pytest

from corpusloom.llm import html_extract, minhash, token_count, token_orc
from corpusloom.llm.common import scratch_dir, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents").select("doc_id", "text").collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_op5_minhash(spark, documents):
    sets = {}
    for d in documents:
        w = words(d.text)
        sets[d.doc_id] = {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        common = collections.Counter(j for x in s for j in holders[x] if j > i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in minhash.op5_minhash(spark, SF).collect()}
    assert len(got) == len(documents) and any(root(i) != i for i in of)
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), root(i), root(i) == i)


def test_op3_token_count(spark, documents):
    got = {r.doc_id: r for r in token_count.op3_token_count(spark, SF).collect()}
    assert len(got) == len(documents)
    counter = token_count.TrieCounter(token_count.vocabulary(None))
    for d in documents:  # a text's tokens are its pre-tokens', each counted alone
        alone = [counter.counts([w])[0][1] for w in (d.text or "").split(" ") if w and not re.search(r"\s", w)] if d.text and not re.search(r"[\t-\r]", d.text) else None
        assert got[d.doc_id].n_pretokens == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        if alone is not None:
            assert got[d.doc_id].n_tokens == sum(alone)
    twice = table(spark, SF, "documents").limit(20)
    counts = collections.Counter((r.doc_id, r.n_tokens) for r in token_count.token_counts(twice.union(twice)).collect())
    assert set(counts.values()) == {2}


def test_op8_html_extract(spark):
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    got = html_extract.op8_html_extract(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        html = pages[r.page_id].html or ""
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == r.text.strip()
        assert "<script" not in r.text and "</" not in r.text
        assert all(block == re.sub(r"\s+", " ", block).strip() and block for block in r.text.split("\n\n")) or not r.text
        assert bool(r.text) or not re.search(r"<p\b", html)


def test_op10_token_orc_ids_stripes_and_bloom_filters(spark, documents):
    from tokenizers import Tokenizer

    encoder, start = Tokenizer.from_file(token_orc.default_tokenizer()), 0
    got = {r.doc_id: r for r in token_orc.op10_token_orc(spark, SF).collect()}
    for d in sorted(documents, key=lambda d: d.doc_id):
        ids = [*encoder.encode(d.text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (start, len(ids), crc)
        start += len(ids)
    # the files' own metadata: stripes, and in each a row index and a Bloom filter of doc_id (column 2)
    path = token_orc.write_token_ids(table(spark, SF, "documents"), scratch_dir(spark, "orc"), row_index_stride=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [f for f in spark.read.format("binaryFile").load(path).select("path").toPandas()["path"] if f.endswith(".orc")]
    seen = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows, stripes = reader.rows(), reader.getStripes()
        assert stripes.size() >= 1 and reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"
        for k in range(stripes.size()):
            streams = rows.readStripeFooter(stripes.get(k)).getStreamsList()
            kinds = {(streams.get(i).getColumn(), streams.get(i).getKind().toString()) for i in range(streams.size())}
            assert (2, "ROW_INDEX") in kinds and (2, "BLOOM_FILTER_UTF8") in kinds
            encodings = rows.readStripeFooter(stripes.get(k)).getColumnsList()
            assert encodings.get(2).getKind().toString() == "DIRECT_V2"  # integer run-length encoding, version 2
            seen += 1
    assert seen >= len(files) > 0
