"""The corpus pipeline's stages, each against a brute-force version on its own input."""

import random
import re

import pytest
from test_ngram_join import brute as components_of
from test_suffix_dedup import brute as repeats_of
from test_tokenizers import check_packing
from texts import ODD

import corpus_pipeline
from llm import suffix_dedup

WORDS = {
    "en": "the house stands near river and people walk there every morning with their dogs while children play games".split(),
    "de": "das haus steht neben dem fluss und menschen gehen dort jeden morgen mit ihren hunden während kinder spielen".split(),
}
TERM = "grumblefink"


def documents():
    """Prose of two languages, some with the toxic term, copies, passages of over 50 words that repeat, and odd rows."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(160):
        lang = r.choice(["en", "de"])
        words = [r.choice(WORDS[lang]) for _ in range(r.randint(80, 160))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                words.insert(r.randrange(len(words)), TERM)
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    for i in range(1, 40, 4):  # copies, near copies and passages of clean documents
        text = rows[i][1]
        rows += [(500 + i, text, rows[i][2]), (600 + i, text + " again", rows[i][2]), (700 + i, " ".join(rows[i + 1][1].split()[:30] + text.split()[10:70]), None)]
    rows += [(i, t, None) for i, t in ODD if not t or len(t) < 1000]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = documents()
    out = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, lang, "web", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    rows, labels = documents()
    texts = {i: t for i, t, _ in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs.collect())
    clean, known, single, cut, packed = kept
    # toxicity: all toxic documents go, all clean ones stay
    assert {r["doc_id"] for r in clean} == {i for i, t in texts.items() if TERM not in (t or "")}
    # language ID: texts without letters go, prose stays
    ids = {r["doc_id"] for r in known}
    assert not any(i in ids for i, t in texts.items() if not re.search("[a-z]", t or ""))
    assert ids >= {r["doc_id"] for r in clean if r["doc_id"] < 900_000}
    # one document of each group of near duplicates
    groups = components_of([(r["doc_id"], r["text"]) for r in known])
    assert sorted(r["doc_id"] for r in single) == sorted({root for _, _, root in groups})
    # bytes of repeated passages go
    want = {r[0]: r for r in repeats_of([(r["doc_id"], r["text"]) for r in single])}
    assert len(cut) == len(single) and sum(r[2] for r in want.values()) > 0
    assert {r["doc_id"]: len(r["text"].encode()) for r in cut} == {i: r[1] - r[2] for i, r in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    assert suffix_dedup.digests(docs.limit(0).selectExpr("doc_id", "'' as text")).count() == 0
    # every document that is left is packed
    check_packing(packed, [(r["doc_id"], r["text"]) for r in cut])


def test_own_replacement_characters_stay(spark):
    passage = "p" * 49 + "é"
    rows = [(1, "a � b"), (2, "x" + passage + "y"), (3, "� z" + passage[:-1] + "è �"), (4, "w" + "p" * 49 + "é� v")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.repeats(spark, docs, "").collect()}
    assert got[1] == ("a � b", 5)
    assert got[2] == ("x" + passage + "y", 52)
    # the passage and half a character go
    assert got[3] == ("� z �", 5)
    assert got[4] == ("w� v", 4)


def test_run_applies_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sum(r["length"] for r in rows) > 0
    whole = {r["doc_id"] for r in rows}
    assert not any(TERM in (t or "") for i, t, _ in documents()[0] if i in whole)


def test_no_documents(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
