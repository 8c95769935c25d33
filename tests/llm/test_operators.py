"""Each operator on small rows with nulls, empty and long texts, ties, repeats, empty tables and extra columns, against brute force."""

import hashlib
import random
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from asoflow.llm import jaccard, langid, mixing, quality, sentencepiece_bpe, sharding, urls, vectors, warc
from asoflow.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "a", "a b", "A b c", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "a b c d e f g h i j k x", "Ä ß é \x85 word", "x" * 3000, "lorem ipsum " * 400,
]


def docs_of(spark, texts, source=lambda k: f"s{k % 3}"):
    rows = [(k, t, "en" if k % 2 else "fr", source(k), len(t or ""), "clash", 1.5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string, p double")


def empty(df):
    return df.where("false")


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_jaccard(texts, words, percent):
    sets = {}
    for k, t in enumerate(texts):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    found = Sets(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                found.join(a, b)
    return {k: (len(s), found.find(k)) for k, s in sets.items()}


def copies(seed, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice((4, 30, 120)))) for _ in range(8)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            w[rng.randrange(len(w))] = rng.choice("klmnop")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard_against_brute_force(spark, words, percent):
    texts = TEXTS + copies(percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs_of(spark, texts), words, percent).collect()}
    assert got == brute_jaccard(texts, words, percent)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(empty(docs_of(spark, TEXTS))).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 7), (200, 201), (5, 5), (None, 3), (200, 201)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 1, 200: 200, 201: 200}


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    path = sentencepiece_bpe.default_model()
    return sentencepiece_bpe.PrefixTable(sentencepiece_bpe.read_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdefghinorstu  ▁\n\x00<>=-.,'é漢😀"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_sentencepiece_is_the_librarys(piece, text):
    table, library = piece
    want = library.encode(text, add_bos=True, add_eos=True)
    packed = table.encode(text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want
    assert table.decode(want) == library.decode(want)


def test_sentencepiece_operator(spark, piece):
    texts = [*TEXTS, "a" * 5000, "▁▁ x", "=-" * 900]
    out = sentencepiece_bpe.encode_decode(docs_of(spark, texts), sentencepiece_bpe.default_model(), with_ids=True).collect()
    for r in out:
        ids = piece[1].encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(piece[1].decode(ids).encode()).hexdigest()
    assert len(out) == len(texts)
    back = sentencepiece_bpe.decode_ids(spark.createDataFrame(out).select("doc_id", "ids"), sentencepiece_bpe.default_model()).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {r["doc_id"]: r["decoded"] for r in out}


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, left, target = {s: weights[k % 3] for k, s in enumerate(names)}, float(sum(sizes.values())), {}
    open_ = list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = most * sizes[s]
        open_ = [s for s in open_ if s not in above]
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_mixing(spark):
    rng = random.Random(3)
    texts = TEXTS + ["w " * rng.randint(1, 60) for _ in range(400)]
    docs = docs_of(spark, texts, lambda k: [None, "b", "a", "é", "c", "a"][k % 6] if k % 5 else "a")
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = {}
    for k, t in enumerate(texts):
        sizes[source[k]] = sizes.get(source[k], 0) + len(WORD.findall(t or ""))
    targets, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]] or ""))
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(targets[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 60
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in rows)


def test_sharding(spark):
    rng = random.Random(4)
    texts = TEXTS + ["t" * rng.randint(0, 50) + str(k) for k in range(300)] + ["same text"] * 150 + ["pair"] * 2
    docs = docs_of(spark, texts)
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(texts)
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(loads) - min(loads) <= 2 * max(len(t or "") + 1 for t in texts)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    import zlib

    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + (1 if texts[r["doc_id"]] is not None else 1), zlib.crc32(t))
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "pair"}) == 1
    assert sharding.shard(empty(docs)).count() == 0
    assert sharding.shard(docs.union(docs.limit(5))).count() == len(texts) + 5


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    rows = [(k, base[k % 60] + (rng.standard_normal(16) * 0.05 if k >= 60 else 0), k % 2) for k in range(150)]
    rows = [(k, [float(x) for x in v], c) for k, v, c in rows]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] + [1.0] * 15, 0), (204, [1.0, 2.0], 0), (205, [2.0, 4.0], 0), (206, rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    data = {r["vec_id"]: r["embedding"] for r in df.collect()}
    ok = {k: np.array(v, float) for k, v in data.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    found, links = Sets(data), dict.fromkeys(data, 0)
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95:
                links[a] += 1
                found.join(a, b)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.embedding_near_duplicates(df, recall=0.999999).collect()}
    assert got == {k: (links[k], found.find(k), found.find(k) == k) for k in data}
    assert vectors.embedding_near_duplicates(empty(df)).count() == 0


def test_hot_bucket_is_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_CELL", 16)
    rows = [(k, [1.0, 0.001 * k, 0.5]) for k in range(100)]
    out = vectors.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.999999).collect()
    assert all(r["n_links"] == 99 and r["component_id"] == 0 for r in out)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.standard_normal(20)]) for k in range(300)] + [(k, [1.0] * 20) for k in range(300, 310)] + [(400, None), (401, [0.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and any(v)}
    hits = 0
    for q in [k for k in x if k % 50 == 0]:
        best = sorted(((-round(float(x[q] @ x[k]), 12), k) for k in x if k != q))[:5]
        hits += len({k for _, k in best} & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        for _, v, s in got[q]:
            assert s == pytest.approx(float(x[q] @ x[v]), abs=1e-12)
    assert hits >= 0.99 * 5 * len(got) and 400 not in got
    assert [v for _, v, _ in sorted(got[300])] == [301, 302, 303, 304, 305]
    few = df.where("vec_id in (0, 1, 50)")
    assert vectors.nearest(few, few.where("vec_id = 0")).count() == 2
    assert vectors.nearest(empty(df), empty(df)).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "rain", "walks."]) for _ in range(rng.randint(5, 80))) if k % 4 else " ".join(rng.choice(["###", "BUY!!", "$$$|"]) for _ in range(rng.randint(5, 80))) for k in range(300)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 > 0) if k % 7 else None, 0) for k in range(12, 300)], "doc_id long, quality int, toxic int")
    # rows 12.. were made with k counted from 0
    labels = labels.withColumn("quality", __import__("pyspark").sql.functions.expr("cast(if((doc_id - 12) % 4 = 0, 0, 1) as int)"))
    rows = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(rows) == len(texts)
    held = [r for k, r in rows.items() if k >= 12 and r["held_out"]]
    assert np.mean([r["predicted"] == int((r["doc_id"] - 12) % 4 > 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    assert {r["score"] for r in quality.quality_scores(docs, empty(labels)).collect()} == {0.5}
    assert quality.quality_scores(empty(docs), labels).count() == 0


def test_language(spark):
    rng = random.Random(6)
    words = {"en": ["the", "of", "with", "thing"], "fr": ["le", "une", "être", "pour"], "de": ["der", "und", "für", "nicht"]}
    rows = []
    for k in range(240):
        lang = sorted(words)[k % 3]
        rows.append((k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 40))), lang if k % 5 else None, "clash"))
    rows += [(900, None, "en", ""), (901, "123 !!", "en", ""), (902, "", None, ""), (903, "the thing of", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert all(got[k]["lang_pred"] == sorted(words)[k % 3] for k in range(240))
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902))
    assert got[903]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.fit(empty(docs)) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_urls(spark):
    cases = {
        "http://A.Example.com/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://example.com/de": ("example.com", "/de", "com/", "allow"), "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"), "http://xexample.com/en/": ("xexample.com", "/en/", "com/", "allow"),
        "http://a.com": ("a.com", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "x://h?a/b": ("h", "", None, None), "http://best-casino.example/slots": ("best-casino.example", "/slots", None, "block"),
    }
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(cases)], "page_id long, url string, host string")
    for r in urls.judge_urls(df).collect():
        host, path, rule, verdict = list(cases.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert urls.judge_urls(empty(df)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    import base64

    pages = spark.createDataFrame([(1, "http://a/x", "<html><title>T</title><p>Hé <b>you</b></p><a href='x'>y</a></html>", "clash"), (2, None, None, ""), (3, "http://b", "", ""), (1, "http://a/x", "<p>&amp;lt;</p>", "")], "page_id long, url string, html string, record_id string")
    made = warc.derivatives(warc.responses(pages))
    rows = made.collect()
    assert len(rows) == 8 and {r["warc_type"] for r in rows} == {"metadata", "conversion"}
    for r in rows:
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"].encode()).digest()).decode()
        assert r["content_length"] == len(r["block"].encode())
    assert {r["block"] for r in rows if r["warc_type"] == "conversion" and r["page_id"] == 1} == {"T\nHé you\ny", "&lt;"}
    warc.write_warc(made, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r["record_id"], r["refers_to"], bytes(r["block"]).decode()) for r in back) == sorted((r["record_id"], r["refers_to"], r["block"]) for r in rows)


def test_conversion_reads_all_character_references(spark):
    cases = {
        "<p>&copy; 2024 &middot; caf&eacute; &mdash; it&#8217;s &#x2019;so&#X2019; &hellip;</p>": "© 2024 · café — it’s ’so’ …",
        "a&nbsp;&nbsp;b&#160;c&#xA0;d": "a b c d", "&amp;copy; &amp;#169; &amp;nbsp; AT&T &bogus; &#1600;": "&copy; &#169; &nbsp; AT&T &bogus; ـ",
        "&lt;b&gt; &quot;q&quot; &#39;s&#39; &apos;t&apos; &#x1F600;": "<b> \"q\" 's' 't' 😀", "no reference": "no reference", None: "",
    }
    pages = spark.createDataFrame([(k, f"http://h/{k}", x) for k, x in enumerate(cases)], "page_id long, url string, html string")
    rows = [r for r in warc.derivatives(warc.responses(pages)).collect() if r["warc_type"] == "conversion"]
    assert {r["page_id"]: r["block"] for r in rows} == dict(enumerate(cases.values()))
    for r in rows:
        assert r["content_length"] == len(r["block"].encode())


def test_warc_query_keeps_date_headers_and_block(spark):
    out = warc.op5_warc_derivatives(spark, "/root/testdata/sf0.001").collect()
    assert out and all(r["date"] and r["source_headers"].startswith("HTTP/1.1 200") for r in out)
    assert all(hashlib.sha256(r["block"].encode()).hexdigest() == r["block_sha256"] for r in out)
    assert not any("&copy;" in r["block"] or "&middot;" in r["block"] for r in out if r["warc_type"] == "conversion")


def test_quality_fits_the_whole_ensemble(spark, monkeypatch):
    seen = {}

    def spied(cls):
        def make(**kw):
            seen[cls.__name__] = kw
            return cls(**kw)

        return make

    monkeypatch.setattr(quality, "RandomForestClassifier", spied(quality.RandomForestClassifier))
    monkeypatch.setattr(quality, "LogisticRegression", spied(quality.LogisticRegression))
    rng = random.Random(8)
    rows = [([rng.random() for _ in quality.STATISTICS], k % 2) for k in range(60)]
    labelled = spark.createDataFrame([(*[x + y if j < 3 else x for j, x in enumerate(v)], y) for v, y in rows], [*quality.STATISTICS, "label"])
    fitted = quality.RuleEnsemble.fit(labelled)
    assert seen["RandomForestClassifier"]["numTrees"] == 40 and seen["LogisticRegression"]["maxIter"] == 100 and fitted.rules
    rules = [r for _, r in fitted.rules]
    made = quality.rule_table(labelled.withColumn("label", labelled["label"].cast("double")), rules)
    want = labelled.select(*[quality.rule_column(r).cast("double") for r in rules]).collect()
    assert sorted(tuple(r["x"]) for r in made.collect()) == sorted(map(tuple, want))


def test_mixing_misses_a_source_by_a_document_at_most(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {}
    for r in mixing.mix(docs, carry=["source"]).collect():
        size, target, taken = found.get(r["row"]["source"], (0, r["target"], 0))
        found[r["row"]["source"]] = (max(size, r["size"]), target, taken + r["taken"])
    assert found and all(abs(taken - target) <= size for size, target, taken in found.values())
