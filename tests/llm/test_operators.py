"""Each corpus operator against brute force on small tables, and on nulls, ties, repeats, long texts and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import ann, bm25, langid, licenses, mixing, near_dup, packing, sharding, token_scan, url_filter
from cohortlens.llm.common import Scratch, components
from cohortlens.llm.queries import QUERIES, tokenizer_path
from cohortlens.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k binary, bucket int, label int, shard int, score double, size int, rank int"


def docs(spark, texts, ids=None, langs=None, sources=None):
    """Documents with further columns whose names operators use themselves."""
    n = len(texts)
    ids, langs, sources = ids or list(range(n)), langs or ["en"] * n, sources or ["s"] * n
    rows = [(i, t, l, s, len(t or ""), None, 1, 1, 1, 0.5, 1, 1) for i, t, l, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [None, "", "  \n\t ", "One two three.", "One two three.", "a", "É ü ß 中文 𝒳 <|endoftext|> \x1c", LONG]


# --- tokens and packing


def test_encoder_equals_the_tokenizer():
    enc = Encoder(tokenizer_path())
    random.seed(2)
    signs = "abzABZ019'\"-.,!<|>éÉßÿ×÷ \n\t́  Σσς中ك٣_stdmrevel"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(1, 50))) for _ in range(2000)] + [t for t in ODD if t]
    for text, want in zip(texts, enc.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert list(enc.encode(text)) == want.ids


def check_packing(rows, wanted):
    """Pieces tile the documents, offsets tile the sequences, ids are the tokenizer's, padding is nil."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(wanted)
    for doc, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(wanted[doc])
            assert r["ids_crc32"] == zlib.crc32(np.array(wanted[doc][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(wanted[doc])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark, documents):
    enc = Encoder(tokenizer_path())
    rows = packing.pack_documents(documents, tokenizer_path()).collect()
    wanted = {r["doc_id"]: [*map(int, enc.encode(r["text"])), 1] for r in documents.collect()}
    check_packing(rows, wanted)
    assert all(list(r["ids"]) == wanted[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in rows)


def test_packing_odd_rows(spark):
    enc = Encoder(tokenizer_path())
    df = docs(spark, ODD)
    check_packing(packing.pack_documents(df, tokenizer_path(), with_ids=False).collect(), {i: [*map(int, enc.encode(t)), 1] for i, t in enumerate(ODD)})
    assert packing.pack_documents(df.limit(0), tokenizer_path()).count() == 0
    again = packing.pack_documents(docs(spark, ["a b"] * 5, ids=[7, 7, None, 7, 8]), tokenizer_path()).collect()
    assert sum(r["length"] for r in again) == 15


# --- near duplicates


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                top[b] = a
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, documents, width, percent):
    got = near_dup.near_duplicates(documents, width, percent).collect()
    want, sizes = brute_components([(r["doc_id"], r["text"]) for r in documents.collect()], width, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_one_large_group(spark):
    """Variants of one text at all distances: many collide, some link, many do not."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 14)):
            words[rng.randrange(150)] = f"x{rng.randrange(60)}"
        if rng.random() < 0.2:
            del words[rng.randrange(100) :][:8]
        texts.append(" ".join(words))
    got = near_dup.near_duplicates(docs(spark, texts), 3, 85).collect()
    want, _ = brute_components(list(enumerate(texts)), 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_duplicates_odd_rows(spark):
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs(spark, ODD), 3, 85).collect()}
    assert [got[i]["n_shingles"] for i in range(6)] == [0, 0, 0, 1, 1, 1]
    assert [got[i]["component_id"] for i in range(8)] == [0, 1, 2, 3, 3, 5, 6, 7]
    assert near_dup.near_duplicates(docs(spark, ODD).limit(0)).count() == 0
    twice = near_dup.near_duplicates(docs(spark, ["a b c", "a b c", "a b c", "d"], ids=[5, 5, None, 9])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in twice) == [("5", "5", True), ("5", "5", True), ("9", "9", True), ("None", "None", True)]
    kept = near_dup.keep_one(docs(spark, ODD))
    assert kept.columns == docs(spark, ODD).columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(spark, edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- search


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[300:500] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, []), (None, x[1].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    y = x.astype(float)
    for q in range(0, 900, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        want = sorted((i for i in range(900) if i != q), key=lambda i: (d[i], i))[:10]
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-9 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (r[1], r[0]))
        hits += len({i for i, _ in got[q]} & set(want))
        if q in (0, 300, 350, 400, 450):
            assert [i for i, _ in got[q]] == want
    assert hits >= 0.9 * 10 * 18 and set(got) == set(range(0, 900, 50))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = ann.nearest(df.where("vec_id in (0, 1)"), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["rank"]) for r in few] == [(1, 1)]


def test_nearest_with_norms_of_any_size(spark):
    """A third of the rows 300 times as long, one row 30,000 times, all around a far centre."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)) / 5
    x[::3] *= 300
    x[7] *= 30_000
    x = (x + 40).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    scratch = Scratch(spark, "ann-test")
    classes = scratch.keep(ann.classes_of(df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10))
    graph = defaultdict(set)
    for r in ann.neighbour_graph(classes, 24, ann.SETTLED, scratch).collect():
        graph[r["node"]].add(r["other"])
    y = x.astype(float)
    d = ((y[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for third in range(3):
        hits = [len(graph[i] & set(np.argsort(d[i])[:10].tolist())) for i in range(third, 1500, 3)]
        # The graph alone, before any search.
        assert np.mean(hits) >= 8.0, (third, np.mean(hits))
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & set(np.argsort(d[q])[:10].tolist())) for q in range(0, 1500, 100)]) >= 9.0


def recall(spark, x, step, kind="float"):
    """Mean and worst share of the 10 true nearest of every step-th row that nearest() finds."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % step == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    y, shares = x.astype(float), []
    for q in range(0, len(x), step):
        d = ((y - y[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        shares.append(len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    return np.mean(shares), min(shares)


def test_nearest_in_tight_clusters_far_apart(spark):
    """Clusters a thousandth, and a ten-millionth, as wide as the distance between them."""
    rng = np.random.default_rng(4)
    places = rng.standard_normal((3, 32)) * 10
    own = np.arange(3000) % 3
    mean, worst = recall(spark, (places[own] + rng.standard_normal((3000, 32)) * 0.01).astype(np.float32), 100)
    assert mean >= 0.9 and worst >= 0.5
    mean, worst = recall(spark, places[own] + rng.standard_normal((3000, 32)) * 1e-6, 100, "double")
    assert mean >= 0.9 and worst >= 0.5


def test_nearest_of_several_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 4.0]), (5, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") >= 0).collect())
    assert got == [
        (0, 1, 1, 1.0), (0, 2, 2, 2.0), (1, 1, 0, 1.0), (1, 2, 2, math.sqrt(5)), (2, 1, 0, 2.0), (2, 2, 1, math.sqrt(5)), (3, 1, 4, 1.0), (4, 1, 3, 1.0)
    ]


def brute_bm25(rows, q, k):
    tf = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in rows}
    length = {i: sum(c.values()) for i, c in tf.items()}
    total = sum(1 for n in length.values() if n)
    mean = sum(length.values()) / total
    df = Counter(w for c in tf.values() for w in c)
    out = defaultdict(float)
    for w in tf[q]:
        idf = math.log1p((total - df[w] + 0.5) / (df[w] + 0.5))
        for i, c in tf.items():
            if c[w] and i != q:
                out[i] += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean))
    return sorted(((round(s, 9), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("shard", [40, 1000])
def test_bm25(spark, documents, shard):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = defaultdict(list)
    for r in bm25.top_k(documents, F.col("doc_id") % 20 == 0, shard_docs=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["doc_id"]))
    for q in range(0, 200, 20):
        want = brute_bm25(rows, q, 10)
        assert [i for _, i in got[q]] == [i for _, i in want]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want])


def test_bm25_query_on_whole_tables(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = defaultdict(list)
    for r in QUERIES["op8_bm25"](spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((round(r["score"], 9), r["doc_id"]))
    assert set(got) == {i for i, _ in rows if i % 50 == 0 and brute_bm25(rows, i, 10)}
    for q, found in got.items():
        want = brute_bm25(rows, q, 10)
        assert [i for _, i in found] == [i for _, i in want] and [s for s, _ in found] == pytest.approx([s for s, _ in want])


def test_block_max_wand_passes_blocks_over():
    """Against sums over all postings, ties included, and with fewer postings evaluated than there are."""
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(1, 1 << 63, 900, np.uint64)
    lists = []
    for i in range(3000):
        topic = rng.integers(0, 10)
        own = np.unique(np.concatenate([rng.choice(vocabulary[:60], 12), rng.choice(vocabulary[60 + topic * 80 : 140 + topic * 80], 15)]), return_counts=True)
        lists.append((own[0], own[1].astype(np.int32)) if i % 7 else lists[-1] if i else (own[0], own[1].astype(np.int32)))
    total, mean = len(lists), float(np.mean([n.sum() for _, n in lists]))
    df = Counter(x for t, _ in lists for x in t.tolist())
    index = bm25.Index(list(range(total)), list(lists), np.sort(vocabulary[:60]), mean)
    touched, impact = [0], index.impact
    index.impact = lambda norm, tf: (touched.__setitem__(0, touched[0] + np.count_nonzero(tf)), impact(norm, tf))[1]
    all_postings = 0
    for q in range(0, 3000, 100):
        terms = lists[q][0]
        weight = bm25.idf(np.array([df[x] for x in terms.tolist()]), total)
        sums = np.zeros(total)
        for x, w in zip(terms, weight):
            for d, (t, n) in enumerate(lists):
                at = np.searchsorted(t, x)
                if at < len(t) and t[at] == x:
                    tf = n[at]
                    sums[d] += w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n.sum() / mean))
                    all_postings += 1
        sums[q] = -1
        want = np.lexsort((np.arange(total), -np.round(sums, 9)))[:10]
        docs, scores = index.search(q, terms, weight, 10)
        assert docs.tolist() == want.tolist() and scores == pytest.approx(sums[want])
    assert touched[0] < 0.6 * all_postings


def test_bm25_lists_grow_with_the_queries_alone(spark, monkeypatch):
    """However many indexes and groups of queries there are, a part returns a list a query, and the result stays."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, search_shards = [], bm25.search_shards
    monkeypatch.setattr(bm25, "search_shards", lambda *a: found.append(search_shards(*a)) or found[-1])
    want = sorted(map(tuple, bm25.top_k(documents, F.col("doc_id") % 50 == 0).collect()))
    assert len(want) == 20 * 10
    monkeypatch.setattr(bm25, "GROUP", 1_000, raising=False)
    got = sorted(map(tuple, bm25.top_k(documents, F.col("doc_id") % 50 == 0, shard_docs=10).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])
    assert found[1].count() <= 24 * 20 * 10


def test_bm25_odd_rows(spark):
    found = bm25.top_k(docs(spark, [*ODD, "one"]), F.lit(True)).collect()
    assert {(r["query_id"], r["doc_id"]) for r in found} == {(3, 4), (3, 8), (4, 3), (4, 8), (8, 3), (8, 4)}
    assert bm25.top_k(docs(spark, ODD).limit(0), F.lit(True)).count() == 0
    assert bm25.top_k(docs(spark, [None, ""]), F.lit(True)).count() == 0


# --- language


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = langid.classify(langid.train(df), df)
    rows = judged.select("lang", "lang_pred", langid.fold_of("doc_id").alias("fold"), "score", "rejected").collect()
    held = [r for r in rows if r["fold"] == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.005 * len(rows)
    model = langid.train(df)
    odd = langid.classify(model, docs(spark, [None, "", "12 %%", "the and of " * 30, "Ж҉ " * 40, "qx zkv wqj " * 40, LONG])).collect()
    assert [r["lang_pred"] for r in odd][:4] == ["und", "und", "und", "en"]
    assert [r["rejected"] for r in odd][:6] == [True, True, True, False, True, True]
    assert langid.classify(model, docs(spark, ODD).limit(0)).count() == 0


def test_three_hundred_languages(spark):
    """More languages than a byte can number, each with letters of its own, and texts longer than a task's cells at once."""
    alphabets = [[chr(0x4E00 + 20 * i + j) for j in range(12)] for i in range(300)]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(a, 60)) for a in alphabets for _ in range(6)]
    langs = [f"l{i:03}" for i in range(300) for _ in range(6)]
    model = langid.train(docs(spark, texts, langs=langs))
    learned = set(model.languages)
    assert len(learned) > 256
    asked = ["".join(rng.choice(a, 40)) for a in alphabets] + ["".join(rng.choice(alphabets[9], 60_000))]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.classify(model, docs(spark, asked).select("doc_id", "text")).collect()}
    assert all(got[i] == f"l{i:03}" for i in range(300) if f"l{i:03}" in learned) and (got[300] == "l009" or "l009" not in learned)


def test_language_without_labels(spark):
    df = docs(spark, ["the and of"] * 3, langs=[None] * 3)
    assert {r["lang_pred"] for r in langid.classify(langid.train(df), df).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    """Over all characters that can follow a known context, in each language, with what is left for unknown ones."""
    import pandas as pd

    rng = random.Random(3)
    words = ["ab", "ba", "abc", "cab", "bb"]
    texts = {l: " ".join(rng.choice(words[: 4 + i]) for _ in range(400)) for i, l in enumerate("xy")}
    grams = []
    for lang, text in texts.items():
        padded = chr(langid.START) * 3 + text
        for g, n in Counter(padded[i : i + 4] for i in range(len(padded) - 3)).items():
            grams.append((lang, g, n))
    model = langid.build(pd.DataFrame(grams, columns=["lang", "gram", "n"]))
    start = np.full(3, langid.START, np.uint32)
    for context in ("ab ", "b a"):
        total = np.zeros(2)
        for c in "abc ":
            base = np.array([ord(x) for x in context], np.uint32)
            one, n1 = model.cross_entropy(np.concatenate([start, base]), np.zeros(6, int), 1)
            two, n2 = model.cross_entropy(np.concatenate([start, base, np.array([ord(c)], np.uint32)]), np.zeros(7, int), 1)
            total += np.exp(one[0] * n1[0] - two[0] * n2[0])
        assert np.all(total > 0.9) and np.all(total < 1.0001)


def test_rare_languages_and_short_texts_have_limits_of_their_own():
    """Chinese at 5 nats beside many English rows at 2; words shorter than any calibrated class; junk stays out."""
    import pandas as pd

    rows = [("en", 5, 5000, 2.4, 2.0, 2.5), ("en", 6, 50_000, 2.2, 1.9, 2.3), ("zh", 6, 12, 5.4, 5.0, 5.4)]
    limits = langid.limits_of(pd.DataFrame(rows, columns=["lang", "size", "n", "q", "mean", "top"]), ["en", "xx", "zh"])
    model = langid.Model(["en", "xx", "zh"], limits=limits)
    ask = lambda lang, chars: model.limit(np.array([lang]), np.array([chars]))[0]
    assert ask(0, 70) == 2.2 + langid.MARGIN and ask(0, 40) == 2.4 + langid.MARGIN
    assert ask(2, 70) > 5.4 and ask(2, 40) > ask(2, 70) and ask(2, 500) > 5.4
    assert ask(0, 4) > ask(0, 8) > ask(0, 16) > ask(0, 40) and ask(0, 70) < ask(0, 500) < 4
    assert ask(1, 70) == np.inf


def test_language_models_leave_no_gram_out(spark):
    """130,000 distinct grams of one language, most of them singletons: as in memory, and the same joined as broadcast."""
    import pandas as pd

    rng = np.random.default_rng(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4000)]
    texts = ["".join(rng.choice(letters, 700)) + " " + "的一是不" * 5 for _ in range(185)] + ["the and of " * 20, "a bat and the cab " * 9] * 20
    langs = ["zh"] * 185 + ["en"] * 40
    rows = Counter()
    for text, lang in zip(texts, langs):
        padded = chr(langid.START) * 3 + text
        rows.update((lang, padded[i : i + 4]) for i in range(len(padded) - 3))
    grams = pd.DataFrame([(lang, g, n) for (lang, g), n in rows.items()], columns=["lang", "gram", "n"])
    assert (grams["lang"] == "zh").sum() > 125_000
    want, frame = langid.build(grams), spark.createDataFrame(grams)
    whole = langid.fit_counts(frame, Scratch(spark, "t"), 1 << 30)
    for a, b in zip(want.levels, whole.levels):
        assert np.array_equal(a.keys, b.keys) and np.array_equal(a.contexts, b.contexts)
        assert abs(a.logs - b.logs).max() <= 1 and abs(a.backs - b.backs).max() <= 1
    asked = docs(spark, [*texts[::9], *ODD, "the cab", "的一", texts[0][:3] + "zzz Ж", "the cab"])
    ours = [sorted(map(str, langid.classify(m, asked).select("doc_id", "text", *[c for c in ("lang_pred", "score", "cross_entropy", "chars", "rejected")]).collect()))
            for m in (whole, langid.fit_counts(frame, Scratch(spark, "t"), 1 << 16), langid.fit_counts(frame, Scratch(spark, "t"), 0))]
    assert ours[0] == ours[1] == ours[2]


# --- sharding, mixing, urls, licences, token files


def test_sharding(spark):
    rng = random.Random(4)
    texts = ["hot text"] * 150 + [f"t{rng.randrange(120)}" for _ in range(400)] + [None, None, ""]
    rows = sharding.balanced_shards(docs(spark, texts), 10).collect()
    count = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and set(count) == set(range(10)) and max(count.values()) - min(count.values()) <= 1
    for s in range(10):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(count[s]))
    where = defaultdict(set)
    for r in rows:
        text = texts[r["doc_id"]]
        where[text].add(r["shard"])
        raw = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    cut = sum(len(s) - 1 for t, s in where.items() if t != "hot text")
    assert cut <= 12 and len(where["hot text"]) <= 8
    again = sharding.balanced_shards(docs(spark, texts).repartition(7), 10).collect()
    assert {(r["doc_id"], r["shard"]) for r in rows} == {(r["doc_id"], r["shard"]) for r in again}
    assert sharding.balanced_shards(docs(spark, texts).limit(0), 10).count() == 0
    odd = sharding.balanced_shards(docs(spark, ["a", "a", "a", LONG * 5, LONG * 5, None], ids=[1, 1, None, 2, 3, None]), 4).collect()
    assert sorted(Counter(r["shard"] for r in odd).values()) == [1, 1, 2, 2] and max(r["size"] for r in odd) == len(LONG) * 5 + 16


def test_propagation_decides_the_shards(spark):
    """Chains of links: rounds cut fewer of them than the start does, whatever the input's order, and quotas hold."""
    n, chain = 1200, 30
    frame = docs(spark, [f"document {i} of its own" for i in range(n)])
    links = [F.floor((F.col("doc_id") + k * 3) / 6) for k in (0, 1)]
    cut = {}
    for rounds in (0, 6):
        where = {r["doc_id"]: r["shard"] for r in sharding.balanced_shards(frame.repartition(5), 8, links, rounds=rounds).collect()}
        count = Counter(where.values())
        assert len(where) == n and max(count.values()) - min(count.values()) <= 1
        cut[rounds] = sum(where[a] != where[b] for k in (0, 3) for a in range(n) for b in range(a + 1, min(n, a + 6)) if (a + k) // 6 == (b + k) // 6)
    assert cut[6] < 0.75 * cut[0]


def brute_targets(sizes, weights, ratio, most):
    goal, left, open_ = [0.0] * len(sizes), ratio * sum(sizes), list(range(len(sizes)))
    for _ in range(len(sizes) + 1):
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        for i in open_:
            goal[i] = share[i]
        for i in over:
            goal[i] = most * sizes[i]
            left -= goal[i]
        open_ = [i for i in open_ if i not in over]
        if not over or not open_:
            return goal


def test_mixing(spark, documents):
    rows = mixing.taken_words(documents).collect()
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(mixing.WORD, text[r["doc_id"]] or ""))
        got = sum(d["words"] for d in r["draws"])
        assert got <= 2 * r["size"]
        sizes[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += got
        target[source[r["doc_id"]]] = r["target"]
    order = sorted(sizes)
    want = brute_targets([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2)
    assert [target[s] for s in order] == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert {(r["doc_id"], str(r["draws"])) for r in rows} == {(r["doc_id"], str(r["draws"])) for r in mixing.taken_words(documents.repartition(5)).collect()}


def test_mixing_odd_rows(spark):
    df = docs(spark, [*ODD, "x y z"], sources=[None, "b", "a", "a", None, "c", "c", "d", None])
    rows = mixing.taken_words(df).collect()
    assert len(rows) == 9 and all(r["size"] == len(re.findall(mixing.WORD, [*ODD, "x y z"][r["doc_id"]] or "")) for r in rows)
    assert mixing.taken_words(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    mixed = mixing.mix(docs(spark, ["a b c d"] * 60, sources=["p"] * 20 + ["q"] * 40), shards=4)
    count = Counter(r["source"] for r in mixed.collect())
    assert mixed.columns[: len(df.columns)] == df.columns and abs(count["p"] - 40) <= 1 and abs(count["q"] - 50) <= 1


def test_split_tree_is_exact():
    counts = mixing.split_tree([100, 7, 0, 33], 8, [1])
    assert counts.sum(axis=0).tolist() == [100, 7, 0, 33] and counts.min() >= 0
    assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 3
    inside = mixing.split_tree([60, 40], 8, [1, 0], counts[:, 0])
    assert inside.sum(axis=0).tolist() == [60, 40] and (inside.sum(axis=1) == counts[:, 0]).all()


def test_mixing_query_deals_blocks_as_the_tree_says(spark, monkeypatch):
    """Of the registered query: each shard's blocks of each source are the tree's, blocks are not torn, and draws add up."""
    monkeypatch.setattr(mixing, "GROUP", 2)
    rows = QUERIES["op6_mixing"](spark, SF).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    where, placed = defaultdict(set), defaultdict(Counter)
    for r in rows:
        draws = [tuple(map(int, d.split(":"))) for d in r["draws"].split(",") if d]
        assert len(draws) == r["times"] and sum(w for _, _, w in draws) == r["taken"]
        for number, shard, _ in draws:
            where[source[r["doc_id"]], r["block"], number].add(shard)
    assert all(len(s) == 1 for s in where.values())
    for (own, _, _), (shard,) in where.items():
        placed[own][shard] += 1
    order = sorted(placed)
    counts = mixing.split_tree([sum(sum(placed[s].values()) for s in order[i : i + 2]) for i in range(0, len(order), 2)], mixing.SHARDS, [17])
    for at, part in enumerate(range(0, len(order), 2)):
        inside = mixing.split_tree([sum(placed[s].values()) for s in order[part : part + 2]], mixing.SHARDS, [17, at], counts[:, at])
        for i, s in enumerate(order[part : part + 2]):
            assert [placed[s][k] for k in range(mixing.SHARDS)] == inside[:, i].tolist()


def test_mixing_many_sources(spark):
    """Sources in order, caps and levels against the iteration written out."""
    rng = random.Random(6)
    sizes = {f"s{i:03}": rng.choice([0, 1, 5, 40, 300]) for i in range(60)} | {None: 7}
    frame = spark.createDataFrame([("~" if s is None else f"={s}", n) for s, n in sizes.items()], "mix_source string, words long")
    got = {r["mix_source"]: r for r in mixing.targets(frame, (3, 1, 2), 1.5, 2.0, Scratch(spark, "t")).collect()}
    order = sorted(got, key=lambda s: (s == "~", s))
    assert [got[s]["place"] for s in order] == list(range(61))
    assert [got[s]["target"] for s in order] == pytest.approx(brute_targets([got[s]["words"] for s in order], [(3, 1, 2)[i % 3] for i in range(61)], 1.5, 2))


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://Sub.Example.ORG/es/1?x=1", "http://example.org/en/19#t", "https://a.com/fr/2", "https://a.com/de/2", "https://xcom/fr/", "http://example.org", "https://b.net/en/5?u=://c.org/", "http://b.net?q"]
    df = spark.createDataFrame([(i, u, "x", "y", 0.5) for i, u in enumerate(urls)] + [(3, urls[3], "x", "y", 0.5)], "page_id long, url string, text string, host string, score double")
    rows = url_filter.judge_urls(df).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(urls) + 1
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 1, 2, 3, 8, 9, 10)] == [("", ""), ("", ""), ("", ""), ("sub.example.org", "/es/1"), ("example.org", ""), ("b.net", "/en/5"), ("b.net", "")]
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (3, 4, 5, 6)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert all(got[i]["rule"] is None for i in (0, 1, 2, 7, 8, 9, 10)) and all(r["verdict"] in ("allow", "block") for r in rows)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_grams_of_long_and_odd_urls(spark):
    texts = ["", "ab", "a😀b", "x" * 200_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = defaultdict(Counter)
    for r in url_filter.with_grams(frame, 3).groupBy("n", "full").count().collect():
        got[r["n"]][r["full"]] = r["count"]
    for n, t in enumerate(texts):
        p = "\u0002\u0002" + t + "\u0003"
        assert got[n] == Counter(p[i : i + 3] for i in range(len(p) - 2))


def test_urls_leave_no_gram_out(spark):
    """Models over the bound of the broadcast keep every gram, and judge as broadcast ones do; a url weighs as often as it comes."""
    rng = random.Random(9)
    slug = lambda: "".join(rng.choice("abcdefghijkmnop%0123456789") for _ in range(12))
    urls = [f"http://{h}/{d}/{slug()}" for h in ("a.com", "b.com") for d in ("fr", "de", "en") for _ in range(20)] + ["http://q.com/fr/same"] * 30
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    small, large = (sorted(map(str, url_filter.judge_urls(df, most=m).collect())) for m in (50, 10**6))
    assert small == large and len(small) == len(urls)
    rows = [("ab/x", True, 3), ("ab/y", False, 1)]
    once = spark.createDataFrame(rows, "text string, good boolean, count long")
    each = spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "text string, good boolean")
    one, two = ({r["gram"]: r["ratio"] for r in url_filter.models(x, 4, m, Scratch(spark, "t"))[0].collect()} for x, m in ((once, 3), (each, 10**6)))
    assert one == two and len(one) > 12


def test_url_model_scores_as_counted(spark):
    """The mean log ratio against Witten-Bell smoothing written out."""
    good, bad = ["ab.org/x", "ac.org/y"] * 3, ["zb.net/q", "zz.net/qq"] * 3
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "text string, good boolean")
    model, contexts = url_filter.models(df, 3, 10_000, Scratch(spark, "t"))
    pad = lambda t: "\u0002\u0002" + t + "\u0003"
    counts = {c: Counter() for c in (0, 1)}
    for c, texts in ((1, good), (0, bad)):
        for t in map(pad, texts):
            for i in range(2, len(t)):
                for k in (1, 2, 3):
                    counts[c][t[i - k + 1 : i + 1]] += 1
    pooled = set(counts[0]) | set(counts[1])
    kinds = len({g for g in pooled if len(g) == 1})

    def prob(c, g):
        low = prob(c, g[1:]) if len(g) > 1 else 1 / kinds
        own = {x: n for x, n in counts[c].items() if len(x) == len(g) and x[:-1] == g[:-1]}
        n, t = sum(own.values()), len(own)
        return (own.get(g, 0) + t * low) / (n + t) if n else low

    for text in ("ab.org/q", "zz.com/x"):
        p, total = pad(text), 0.0
        for i in range(2, len(p)):
            # An unseen last character has probability 0 in the pooled models; both then back off alike.
            g = p[i - 2 : i + 1]
            value = 0.0
            for k in (1, 2, 3):
                h = g[-k:]
                if h in pooled:
                    value = math.log(prob(1, h) / prob(0, h))
                elif any(x[:-1] == h[:-1] and len(x) == k for x in pooled):
                    share = []
                    for c in (1, 0):
                        own = [n for x, n in counts[c].items() if len(x) == k and x[:-1] == h[:-1]]
                        share.append(len(own) / (sum(own) + len(own)) if own else 1.0)
                    value += math.log(share[0] / share[1])
            total += value
        got = url_filter.scores(spark.createDataFrame([(text,)], "text string"), model, contexts, 3).first()["score"]
        assert got == pytest.approx(total / (len(p) - 2))


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
    kept = " // The above copyright notice and this permission notice shall be included in all copies.\n"
    end = 'The software is provided "as is", without warranty of any kind.'
    texts = [*ODD, f"Foo.\n# {mit}\n{kept} {end} Released under the MIT License.", f"{mit} {end}", f"{end} {mit}", "#" + " " * 600 + "Released under the MIT License."]
    rows = {r["doc_id"]: r for r in licenses.licence_matches(docs(spark, texts)).collect()}
    assert all(not rows[i]["matches"] for i in range(8)) and rows[0]["sentences"] == 0
    assert [m["rule"] for m in rows[8]["matches"]] == ["mit-text", "mit-notice"]
    assert [m["rule"] for m in rows[9]["matches"]] == ["mit-grant-as-is"] and not rows[10]["matches"]
    assert [m["rule"] for m in rows[11]["matches"]] == ["mit-notice"]
    assert licenses.licence_matches(docs(spark, texts).limit(0)).count() == 0


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


@pytest.mark.parametrize("dressed", ["{}", "# {}", " * {}", "// {}\r", "    {}", "unwrapped"])
def test_licences_as_they_stand_in_files(spark, tmp_path, dressed):
    """Wrapped, commented and on one line, and equal to the SQL."""
    import duckdb

    from cohortlens.llm.queries import ORACLES

    texts = [MIT, BSD, APACHE, GPL, MPL, MIT + "\nint main;\n\n" + BSD, "\n".join([GPL, APACHE, MPL] * 3)]
    if dressed == "unwrapped":
        texts = [re.sub(r"(?<!\n)\n(?!\n)", " ", t) for t in texts]
    else:
        texts = ["\n".join(dressed.format(x) for x in t.split("\n")) for t in texts]
    # A word more, a full stop or an empty line inside a sentence is no match; nor are non-ASCII letters at its edges.
    texts += [MIT.replace("free of charge", "free of all charge")[:600], "Released under\n\nthe MIT License.", "Released under. The MIT License.", "éReleased under the MIT License", "released under the\nmit\nlicense", "." * 100_000, " " * 100_000, *ODD]
    df = docs(spark, texts)
    rows = {r["doc_id"]: [m["rule"] for m in r["matches"]] for r in licenses.licence_matches(df).collect()}
    want = ["mit-full", "bsd-3-text", "apache-2.0-header-full", "gpl-3-header", "mpl-2-header"]
    assert [rows[i] for i in range(5)] == [[w] for w in want] and rows[5] == want[:2] and rows[6] == [want[3], want[2], want[4]] * 3
    assert [rows[7 + i] for i in range(5)] == [[], [], [], [], ["mit-notice"]] and not any(rows[i] for i in range(12, len(texts)))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = QUERIES["op3_licenses"](spark, str(tmp_path)).collect()
    names = ("doc_id", "sentences", "identifiers", "rules")
    assert sorted(tuple(r[n] for n in names) for r in ours) == sorted(con.sql(ORACLES["op3_licenses"]).select(*names).fetchall())


BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
     This product includes software developed by the University.
"""
NAMED = [
    "3. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n",
    "   * Neither the name of Google Inc. nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n",
    "    * Neither the names of the LLVM Team, University of Illinois at\n      Urbana-Champaign, nor the names of its contributors may be used to\n      endorse or promote products derived from this Software without specific\n      prior written permission.\n",
    "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n",
    "3. The name of Example, S.A. may not be used to endorse or promote products derived from this software without prior permission of the holder.\n",
]


@pytest.mark.parametrize("dressed", ["{}", " * {}"])
def test_bsd_texts_with_named_holders(spark, tmp_path, dressed):
    """No text with an endorsement clause is told as the more permissive licence, whoever is named; equal to the SQL."""
    import duckdb

    from cohortlens.llm.queries import ORACLES

    far = "Neither the name\n" + "of nobody in particular, and so on. " * 20 + "\nbe used to endorse or promote products derived\n"
    texts = [*[BSD_HEAD + n for n in NAMED], BSD_HEAD, BSD_HEAD + ADVERT + NAMED[0], BSD_HEAD + ADVERT, BSD_HEAD + far, NAMED[1], *NAMED[:1] * 2]
    texts = ["\n".join(dressed.format(x) for x in t.split("\n")) for t in texts]
    df = docs(spark, texts)
    rows = {r["doc_id"]: [m["licence"] for m in r["matches"]] for r in licenses.licence_matches(df).collect()}
    assert [rows[i] for i in range(5)] == [["BSD-3-Clause"]] * 5
    assert [rows[i] for i in range(5, 12)] == [["BSD-2-Clause"], ["BSD-4-Clause"], ["BSD-4-Clause"], ["BSD-2-Clause"], [], [], []]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours = QUERIES["op3_licenses"](spark, str(tmp_path)).collect()
    names = ("doc_id", "sentences", "identifiers", "rules")
    assert sorted(tuple(r[n] for n in names) for r in ours) == sorted(con.sql(ORACLES["op3_licenses"]).select(*names).fetchall())


def test_whole_licences_by_their_titles(spark):
    title = lambda *lines: "\n\n".join(f"          {x}" for x in lines) + "\n\n Everyone is permitted to copy.\n"
    texts = [
        title("GNU LIBRARY GENERAL PUBLIC LICENSE", "Version 2, June 1991"), title("GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"), title("GNU GENERAL PUBLIC LICENSE", "Version 1, February 1989"),
        title("GNU Free Documentation License", "Version 1.3, 3 November 2008"), title("MOZILLA PUBLIC LICENSE Version 1.1"), title("Creative Commons Legal Code", "CC0 1.0 Universal"), title("GNU GENERAL PUBLIC LICENSE", "Version 9, May 2030"),
    ]
    rows = {r["doc_id"]: [m["licence"] for m in r["matches"]] for r in licenses.licence_matches(docs(spark, texts)).collect()}
    assert [rows[i] for i in range(7)] == [["LGPL-2.0"], ["LGPL-3.0"], ["GPL-1.0"], ["GFDL-1.3"], ["MPL-1.1"], ["CC0-1.0"], []]


def test_token_counts(spark, documents, tmp_path):
    enc = Encoder(tokenizer_path(), special_as_text=True)
    odd = docs(spark, [*ODD, "a"], ids=[0, 1, 2, 3, 3, None, 6, 7, 8]).select("doc_id", "text")
    for at, df in enumerate((documents.select("doc_id", "text"), odd)):
        got = token_scan.document_token_counts(df, f"file://{tmp_path}/{at}", tokenizer_path(), 49_407).collect()
        want = Counter((r["doc_id"], len(enc.encode(r["text"]))) for r in df.collect())
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
        again = token_scan.document_token_counts(df, f"file://{tmp_path}/{at}-again", tokenizer_path(), 49_407, one_order=True).collect()
        assert Counter((r["doc_id"], r["n_tokens"]) for r in again) == want
    assert token_scan.document_token_counts(odd.limit(0), f"file://{tmp_path}/none", tokenizer_path(), 49_407).count() == 0


def test_token_counts_of_a_plan_without_an_order(spark, tmp_path):
    """Texts that every scan of the documents would draw anew: written once, so ids and counts fit."""
    drawn = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', cast(rand() * 50 as int))").alias("text")).orderBy(F.rand())
    got = token_scan.document_token_counts(drawn, f"file://{tmp_path}/t", tokenizer_path(), 49_407).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))


@pytest.mark.parametrize("row", [1, 600, 1 << 28])
def test_large_token_files_are_read_in_ranges(spark, tmp_path, row):
    wanted = {}
    for at, n in enumerate((700, 1, 250, 0)):
        ids = np.random.default_rng(at).integers(0, 30, n).astype("<u2")
        ids.tofile(tmp_path / f"part-{at:05}")
        for i in range(0, n, 64):
            wanted[at, i // 64] = ids[i : i + 64].tobytes()
    got = token_scan.read_blocks(spark, f"file://{tmp_path}", 2, 64, row).collect()
    assert {(int(r["path"][-5:]), r["block"]): bytes(r["ids"]) for r in got} == wanted and len(got) == len(wanted)


@pytest.mark.parametrize("block", [1, 3, 64, 10_000])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    ids = np.random.default_rng(1).integers(0, 30, 700).astype("<u2")
    ids[-3:] = 1
    ids.tofile(tmp_path / "part-00000")
    ends = np.flatnonzero(ids == 7)
    got = token_scan.count_tokens(token_scan.read_blocks(spark, f"file://{tmp_path}", 2, block), 7).orderBy("ordinal").collect()
    assert [r["n_tokens"] for r in got if r["ended"]] == (np.diff(np.r_[-1, ends]) - 1).tolist()
    assert [(r["start"], r["n_tokens"]) for r in got if not r["ended"]] == [(ends[-1] + 1, 699 - ends[-1])]


def test_many_rows_of_one_id_and_text_spread(spark):
    """4,000 rows of one id and text among 6,000 others: units stay small, so no task of the placement gets them all."""
    rows = docs(spark, ["same " * 50] * 4000 + [f"text {i}" for i in range(6000)], ids=[5] * 4000 + list(range(10, 6010)))
    hashed = rows.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("same"), F.xxhash64(F.monotonically_increasing_id()).alias("pick"))
    units = sharding.units_of(hashed, 125).groupBy("unit").count().agg(F.max("count")).first()[0]
    assert units < 4 * 125
    shards = Counter(r["shard"] for r in sharding.balanced_shards(rows, 10).collect())
    assert len(shards) == 10 and set(shards.values()) == {1000}


def test_vectors_broadcast_or_shuffled_give_one_graph(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(700)], "node long, vector array<float>")
    one, two = ({(r["node"], r["other"]) for r in ann.neighbour_graph(df, 8, 0.005, Scratch(spark, "graph"), small=b).collect()} for b in (0, 1 << 20))
    assert len(one & two) >= 0.99 * len(one) and len(one) == len(two)


def test_short_posting_lists_are_taken_together(monkeypatch):
    """Sums of postings are the same however many of a query's lists are taken by one step, and short lists are no slices of their own."""
    from cohortlens.llm import bm25

    rng = np.random.default_rng(8)
    lists = [(np.unique(rng.integers(0, 3000, 60)).astype(np.uint64), None) for _ in range(400)]
    lists = [(t, rng.integers(1, 5, len(t)).astype(np.int32)) for t, _ in lists]
    array, low = np.arange(900), rng.integers(0, 800, 50)
    high = low + rng.integers(0, 90, 50)
    for some in (slice(0, 50), slice(0, 0)):
        assert bm25.runs(array, low[some], high[some]).tolist() == bm25.slices(array, low[some], high[some]).tolist()
    sliced, found, plain = [], [], bm25.slices
    monkeypatch.setattr(bm25, "slices", lambda array, low, high: sliced.append((array.dtype, len(low))) or plain(array, low, high))
    for few in (0, 10, 1 << 20):
        monkeypatch.setattr(bm25, "FEW", few)
        index = bm25.Index(list(range(400)), list(lists), np.empty(0, np.uint64), 60.0)
        asked = bm25.Asked([7], [lists[7][0].copy()], [np.ones(len(lists[7][0]))], index.frequent)
        found.append(bm25.Search(index, asked, 0, bm25.places(index.terms, asked.terms)).sums())
    assert np.allclose(found[0], found[1], rtol=1e-6) and np.allclose(found[0], found[2], rtol=1e-6) and found[0][7] > 0
    assert [n for kind, n in sliced if kind == np.int64][::2] == [len(lists[7][0]), 0]
