"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are letters, lower-cased; any run of others is one border. Pairs and triples of
neighbouring characters, unless all border, hash into ``1 << BITS`` buckets. Training adds up the bucket counts by language
over all given texts in one grouped sum; the model is a matrix of log probabilities and the languages' log priors (their shares of the documents), whose
size depends on the number of languages alone, and is broadcast. Scoring gathers the matrix rows of
a batch's n-grams and adds them up by document in numpy, onto the priors.

Texts that are null or hold no letter are ``und`` with score 0; with nothing to learn from, so is every text. Ties go to the language that sorts first.
Rows keep their other columns; repeated rows stay repeated. Languages that are null teach nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .spark_io import extended, in_lanes, lean

BITS = 14
#: The score is the posterior of as many n-grams as this at most: neighbouring n-grams aren't independent.
EVIDENCE = 64
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, 0 for all but letters and before each text and at the end; offsets of texts."""
    low = [t.lower() for t in texts]
    cps = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.cumsum([1, *(len(t) + 1 for t in low)])
    letter = _LETTER[np.minimum(cps, 0xFFFF)]
    for i in np.flatnonzero(cps > 0xFFFF):
        letter[i] = chr(cps[i]).isalpha()
    return np.where(letter, cps, np.uint32(0)), off


def grams(cps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, places) of all pairs that aren't all border, and of all triples around a letter, in text order."""
    c = K.mix(cps.astype(np.uint64)).astype(np.uint32)
    two = (c[:-1] * np.uint32(0x85EBCA6B)) ^ (c[1:] * np.uint32(0xC2B2AE35))
    two_on = (cps[:-1] != 0) | (cps[1:] != 0)
    three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (c[2:] * np.uint32(0x165667B1))
    at_two, at_three = np.flatnonzero(two_on), np.flatnonzero(cps[1:-1])
    return [(h[at] >> np.uint32(32 - BITS), at) for h, at in ((two, at_two), (three, at_three))]


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    _, off = K.flat(column)
    for a, b in K.blocks(off, 1 << 19):
        cps, at = code_points([t or "" for t in column.slice(a, b - a).to_pylist()])
        yield a, b, cps, at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, cps, at in _chunks(batch.column("text")):
            names = sorted(set(langs[a:b]))
            own = np.array([names.index(x) for x in langs[a:b]])
            got = np.zeros(len(names) << BITS, np.int64)
            for bucket, place in grams(cps):
                doc = np.searchsorted(at[1:-1], place + 1, "right")
                got += np.bincount((own[doc] << BITS) + bucket, minlength=len(got))
            got = got.reshape(len(names), -1)
            for k, name in enumerate(names):
                counts[name] = counts.get(name, 0) + got[k]
                docs[name] = docs.get(name, 0) + int((own == k).sum())
    names = list(counts)
    packed = [zlib.compress(counts[x].astype("<i8").tobytes(), 1) for x in names]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([docs[x] for x in names], pa.int64()), pa.array(packed, pa.binary())], ["lang", "docs", "counts"])


def _total(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in parts["counts"])
    docs = sum(parts["docs"].to_pylist())
    return pa.table({"lang": parts["lang"][:1].cast(pa.string()), "docs": pa.array([docs], pa.int64()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log probabilities (one column a language, a row a bucket) and log priors from ``docs(text, lang)``."""
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    schema = "lang string, docs long, counts binary"
    rows = sorted(in_lanes(known.mapInArrow(lean(_count), schema), "lang", _total, schema).collect())  # a row a language
    counts = np.array([np.frombuffer(zlib.decompress(bytes(r["counts"])), "<i8") for r in rows], float).reshape(len(rows), 1 << BITS) + 0.5
    of = np.array([r["docs"] for r in rows], float)
    return [r["lang"] for r in rows], np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32), np.log(of / of.sum())


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of that language (0 to 1)."""
    source, schema = extended(docs, lang_pred="string", score="double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, prior = sent.value
        table = np.ascontiguousarray(table, np.float32)
        for batch in batches:
            for a, b, cps, at in _chunks(batch.column(batch.schema.get_field_index("text"))):
                n = b - a
                total, count = np.zeros((n, len(names))), np.zeros(n)
                for bucket, place in grams(cps):
                    if len(place):
                        doc = np.searchsorted(at[1:-1], place + 1, "right")
                        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                        total[doc[first]] += np.add.reduceat(table[bucket], first, axis=0, dtype=np.float64)
                        count[doc[first]] += np.diff(np.append(first, len(doc)))
                if names:
                    mean = total / np.maximum(count, 1)[:, None] * np.minimum(count, EVIDENCE)[:, None] + prior
                    total += prior
                    odds = np.exp(mean - mean.max(1, keepdims=True))
                    best = total.argmax(1)
                    score = odds[np.arange(n), best] / odds.sum(1)
                letters = np.add.reduceat((cps != 0).astype(np.int64), at[:-1]) if n else np.zeros(0)
                known = (letters > 0) & bool(names)
                pred = [names[best[i]] if known[i] else UNKNOWN for i in range(n)]
                yield batch.slice(a, n).append_column("lang_pred", pa.array(pred, pa.string())).append_column("score", pa.array(np.where(known, score, 0.0) if names else np.zeros(n)))

    return source.mapInArrow(lean(run), schema)


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, predict all: (doc_id, held_out, lang_pred, score)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang", is_held_out().alias("held_out"))
    model = train(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
