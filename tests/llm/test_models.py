"""Learned operators: held-out accuracy on the driver's tables, recall against brute force, odd rows."""

import os

import numpy as np
import pytest

from llm import ann, langid, toxicity

DATA = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@given
def test_language_of_held_out_documents(spark):
    docs = read(spark, "documents")
    out = langid.predictions(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.95 * len(out)


def test_language_scores_equal_plain_naive_bayes(spark):
    """Each text's log odds by plain loops over its n-grams, in the buckets that the operator names."""
    rows = [(1, "the house and the dog", "en"), (2, "das Haus und der Hund", "de"), (3, "la casa y el perro", "es"), (4, "der Garten", "de"), (5, "a dog in the garden, the big one", "en"), (6, "el 9 perro!", None), (7, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.train(docs)).collect()}

    def buckets(text):
        cps = [ord(c) if c.isalpha() else 0 for c in "\0" + text.lower() + "\0"]
        out = []
        for k in range(len(cps) - 1):  # pairs that aren't all border, then triples around a letter
            if cps[k] or cps[k + 1]:
                out += langid.grams(np.array(cps[k : k + 2] + [0], np.uint32))[0][0][:1].tolist()
        for k in range(len(cps) - 2):
            if cps[k + 1]:
                out += langid.grams(np.array(cps[k : k + 3], np.uint32))[1][0].tolist()
        return out

    langs, size = ["de", "en", "es"], 1 << langid.BITS
    counts = {x: np.full(size, 0.5) for x in langs}
    for _, t, x in rows:
        if x:
            for b in buckets(t):
                counts[x][b] += 1
    share = {x: sum(r[2] == x for r in rows) / 5 for x in langs}
    for i, t, _ in rows:
        own = buckets(t)
        sums = [sum(np.log(counts[x][b] / counts[x].sum()) for b in own) for x in langs]
        mean = np.array([v / len(own) * min(len(own), langid.EVIDENCE) + np.log(share[x]) for v, x in zip(sums, langs, strict=True)])
        odds = np.exp(mean - mean.max())
        best = int(np.argmax([v + np.log(share[x]) for v, x in zip(sums, langs, strict=True)]))
        assert got[i][0] == langs[best] and got[i][1] == pytest.approx(odds[best] / odds.sum(), rel=1e-4)


def test_empty_tables_have_no_scores(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    some = spark.createDataFrame([(1, "a house", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert langid.identify(none, langid.train(some)).count() == langid.predictions(none).count() == toxicity.scores(none, labels).count() == 0


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !?", "en"), (3, "the house", "en"), (3, "the house", None), (None, "das Haus", "de"), (4, "das Haus und der Hund", "de")], "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as LANG_PRED")
    model = langid.train(docs)
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {(r["doc_id"], r["text"]): r["lang_pred"] for r in out.collect()}
    assert by == {(1, None): "und", (2, "123 !?"): "und", (3, "the house"): "en", (None, "das Haus"): "de", (4, "das Haus und der Hund"): "de"}
    assert out.count() == 6
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def ranking(score, label):
    """Probability that a toxic text scores above another one."""
    one, other = score[label == 1][:, None], score[label == 0][None, :]
    return ((one > other) + 0.5 * (one == other)).mean()


@given
def test_toxicity_of_held_out_labels(spark):
    # sf0.1: sf0.01 has but 14 toxic texts held out
    labels, docs = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("labels", "documents"))
    labels = labels.where("toxic is not null")
    got = toxicity.scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    score, label = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    assert ranking(score, label) >= 0.9
    predicted = np.array([r["predicted"] for r in got])
    assert (predicted == (score >= 0.3)).all()
    assert predicted[label == 1].mean() >= 0.9 and predicted[label == 0].mean() <= 0.01


def test_misspelled_terms_match():
    a = toxicity.compile_lexicon([("grumble", False), ("snark", True)])
    cps, inside, _ = toxicity._points(["grumble grumbel grumle gruumble grxmble rumble snarky snork grumbling"])
    start, end = toxicity._words(cps, inside)
    word, term, distance = toxicity.matches(a, cps, start, end)
    found = dict(zip(word.tolist(), zip(term.tolist(), distance.tolist(), strict=True), strict=True))
    assert found == {0: (0, 0), 2: (0, 1), 3: (0, 1), 4: (0, 1), 6: (1, 0)}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matches_equal_plain_distances():
    """Every word against every term: equal, or one error away with the first letter right for terms of five letters or more."""
    r = np.random.default_rng(4)
    word = lambda: "".join("abc"[k] for k in r.integers(0, 3, r.integers(3, 9)))
    terms = sorted({word() for _ in range(12)})
    words = [word() for _ in range(600)] + terms
    cps, inside, _ = toxicity._points([" ".join(words)])
    found = {w: (t, d) for w, t, d in zip(*(x.tolist() for x in toxicity.matches(toxicity.compile_lexicon([(t, False) for t in terms]), cps, *toxicity._words(cps, inside))), strict=True)}
    for k, w in enumerate(words):
        near = [plain_distance(w, t) if w == t or (len(t) >= 5 and t[0] == w[0]) else 9 for t in terms]
        least = min(near)
        assert (k in found) == (least <= 1)
        if k in found:
            assert found[k][1] == least and near[found[k][0]] == least


def test_quotations_count_apart():
    a = toxicity.compile_lexicon([("grumble", False)])
    w = np.ones((1, 2))
    own, quoted, said = toxicity.features(["you grumble", 'they: "grumble" indeed', "he said grumble"], a, w)
    assert own[1] > 0 and own[2] == 0
    assert quoted[1] == said[1] == 0 and quoted[2] > 0 and said[2] > 0


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x")], "doc_id long, text string").selectExpr("*", "1 as SCORE")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 4 and {(r["score"], r["predicted"]) for r in out} == {(0.0, 0)}


def exact(vectors, every=20, k=20):
    """query -> scores of the k nearest, by all pairs."""
    out = {}
    for q, x in vectors:
        if q % every == 0:
            scored = sorted(((-float(np.dot(x, y)), i) for i, y in vectors if i != q))
            out[q] = scored[:k]
    return out


@given
def test_recall_of_nearest_neighbours(spark):
    df = read(spark, "embeddings")
    vectors = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect() if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"]) and any(r["embedding"])]
    want, got = exact(vectors), {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(got) == set(want)
    hit = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    known = dict(vectors)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[0], x[1]))
        for score, i in found:
            assert score == pytest.approx(float(np.dot(known[q], known[i])), rel=1e-12)


def test_search_leaves_a_part_without_links_to_the_neighbours(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 4))
    q, scale = ann.quantised(x)
    pairs = [(a, b) for part in (range(20), range(20, 40)) for a in part for b in part if a != b]
    u, v = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
    row = ann._row(ann.GRAPH, 0, *(c.tobytes() for c in (u, v, q[v], scale[v]))).to_pylist()
    graph = spark.createDataFrame([tuple(d.values()) for d in row], ann.SCHEMA)
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in range(5)], "id long, embedding array<double>").coalesce(1)
    found = ann.search(graph, queries, 4, 40, 1).collect()
    for k in range(5):
        assert {f["class"] for f in found if f["query_class"] == k} == set(range(40))


@given
def test_recall_on_more_vectors_than_a_pool_holds(spark):
    sf = DATA.replace("0.01", "0.1")
    vectors = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert len(vectors) > 2 * ann.POOL
    want, got = exact(vectors), {}
    for r in ann.nearest(spark.read.parquet(f"{sf}/embeddings.parquet")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len({i for _, i in want[q]} & got[q]) for q in want) >= 0.95 * sum(map(len, want.values()))


@given
def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    df = spark.read.parquet(f"{DATA.replace('0.01', '0.1')}/embeddings.parquet").where("vec_id < 1500")
    vectors = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    want, got = exact(vectors), {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len({i for _, i in want[q]} & got[q]) for q in want) >= 0.95 * sum(map(len, want.values()))


def test_few_odd_and_equal_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [-1.0, 0.5]), (20, [1.0, 0.0]), (40, [0.0, 0.0]), (8, [1.0, 2.0, 3.0]), (1, [2.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as rank")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(1, 2.0), (2, 2.0), (20, 1.0), (7, -1.0)], 20: [(1, 2.0), (2, 2.0), (0, 1.0), (7, -1.0)]}
    assert ann.nearest(df.limit(0)).count() == 0
