"""Toxicity scores from a learned lexicon, matched with misspellings, weighed by context.

Training takes at most ``SAMPLE`` labelled rows (those of the least hashed ids, so the choice is the same at every run). Words, and word
beginnings that many different words share, which occur far more often in toxic rows than in others make the lexicon, ``TERMS`` at most.

The lexicon is a trie. Its product with the Levenshtein automata of distance one (for terms of five letters or more)
is compiled into one deterministic table over character classes, of which all words of a batch are driven
in step, one numpy gather a character; words that match nothing die after a few. Each match is scored by
the ``WINDOW`` words around it: quotation marks on both sides or words of reporting make it a quotation, otherwise it counts as abuse.
A logistic model over a text's sums, fitted to the sample, gives the score.

Texts of any length are scored whole, in blocks of texts. TERMS, SAMPLE and the length of words that may be terms bound the model, never what is scored:
every word of every text is driven through the automaton. Ties among terms go to the term that sorts first, and a word's exact match goes before a misspelled one.

Null and empty texts have the score of a text without matches. With nothing to learn from, all scores are 0. Rows keep
their other columns; repeated rows stay repeated. Labels that are null, or of ids that no text has, teach nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .spark_io import extended, lean

SAMPLE, TERMS, WINDOW = 20_000, 1_000, 8
#: Texts that a term must be toxic in, lower bound of its log odds, and different words below a shared beginning.
SEEN, ODDS, SPREAD = 5, 1.5, 6
THRESHOLD = 0.3
#: Signs written for letters; the second of each pair.
WRITTEN = str.maketrans("013457@$", "oieastas")
QUOTES = "\"“”«»„‟"
#: Words of reporting that mark a quotation, in the languages at hand.
REPORTING = frozenset("said says wrote quoted quote called sagte schrieb zitat dijo escribió cita dit écrit citation".split())

_WORD = np.array([chr(c).isalnum() for c in range(0x10000)])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with a 0 before, between and after; which are of words; offsets of texts."""
    low = [t.lower().translate(WRITTEN) if any(c in t for c in "013457@$") else t.lower() for t in texts]
    cps = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, _WORD[np.minimum(cps, 0xFFFF)], np.cumsum([1, *(len(t) + 1 for t in low)])


def _words(cps: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(inside.astype(np.int8))
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


@dataclass
class Automaton:
    """Deterministic table: ``step[state * classes + class]``; state 0 is dead. Match of a state: term and distance, or -1."""

    classes: np.ndarray  # of code points below 0x10000; 0 for others and for non-letters of the lexicon
    n_classes: int
    step: np.ndarray
    whole: np.ndarray  # term matched if the word ends in this state
    stem: np.ndarray  # term whose letters the word began with when it entered this state
    distance: np.ndarray


def compile_lexicon(terms: list[tuple[str, bool]]) -> Automaton:
    """terms: (letters, whether it is a beginning). Beginnings match exactly; whole terms of five letters or more with one error."""
    children: list[dict[str, int]] = [{}]
    term_at, fuzzy = [[-1, -1]], [False]
    for k, (word, is_stem) in enumerate(terms):
        v = 0
        for c in word:
            if c not in children[v]:
                children[v][c] = len(children)
                children.append({})
                term_at.append([-1, -1])
                fuzzy.append(False)
            v = children[v][c]
            fuzzy[v] |= not is_stem and len(word) >= 5
        term_at[v][is_stem] = k
    fuzzy[0] = any(not s and len(w) >= 5 for w, s in terms)
    alphabet = sorted({c for w, _ in terms for c in w})
    classes = np.zeros(0x10000, np.int32)
    for i, c in enumerate(alphabet):
        if ord(c) < 0x10000:
            classes[ord(c)] = i + 2
    n_classes = len(alphabet) + 2  # 0 stands for other letters, 1 isn't used in words

    def closed(items: dict[int, int]) -> frozenset:
        """Deletions: a trie letter that the word leaves out."""
        out = dict(items)
        for v, e in items.items():
            if e == 0:
                for w in children[v].values():
                    if fuzzy[w]:
                        out[w] = min(out.get(w, 1), 1)
        return frozenset(out.items())

    def after(state: frozenset, c: str | None) -> frozenset:
        out: dict[int, int] = {}

        def put(v: int, e: int) -> None:
            out[v] = min(out.get(v, e), e)

        for v, e in state:
            if c in children[v] and (e == 0 or fuzzy[children[v][c]]):
                put(children[v][c], e)
            if e == 0:
                if fuzzy[v] and v:
                    put(v, 1)  # a letter too many
                for d, w in children[v].items():
                    if d != c and fuzzy[w] and v:  # the first letter must be right
                        put(w, 1)
        return closed(out)

    first = closed({0: 0})
    first = frozenset(x for x in first if x[0] == 0)
    numbers, queue, rows = {frozenset(): 0, first: 1}, [frozenset(), first], []
    whole, stem, distance = [], [], []
    for state in queue:
        row = np.zeros(n_classes, np.int32)
        for i, c in enumerate([None, None, *alphabet]):
            nxt = after(state, c) if i != 1 else frozenset()
            if nxt not in numbers:
                numbers[nxt] = len(queue)
                queue.append(nxt)
            row[i] = numbers[nxt]
        rows.append(row)
        ends = sorted((e, term_at[v][0]) for v, e in state if term_at[v][0] >= 0)
        exact = [term_at[v][1] for v, e in state if e == 0 and term_at[v][1] >= 0]
        whole.append(ends[0][1] if ends else -1)
        distance.append(ends[0][0] if ends else 0)
        stem.append(exact[0] if exact else -1)
    return Automaton(classes, n_classes, np.concatenate(rows), np.array(whole), np.array(stem), np.array(distance, np.int64))


def matches(a: Automaton, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, term, distance) of the words that match, whole terms before beginnings."""
    classes = a.classes[np.minimum(cps, 0xFFFF)]
    word, state, at = np.arange(len(start)), np.ones(len(start), np.int32), start.copy()
    stem = np.full(len(start), -1)
    out = []
    while len(word):
        state = a.step[state * a.n_classes + classes[at]]
        got = (a.stem[state] >= 0) & (stem[word] < 0)
        stem[word[got]] = a.stem[state[got]]
        at = at + 1
        alive = state != 0
        word, state, at = word[alive], state[alive], at[alive]
        ended = at == end[word]
        full = ended & (a.whole[state] >= 0)
        out.append(np.stack([word[full], a.whole[state[full]], a.distance[state[full]]], 1))
        word, state, at = word[~ended], state[~ended], at[~ended]
    whole = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    begun = np.flatnonzero(stem >= 0)
    begun = begun[~np.isin(begun, whole[:, 0])]
    found = np.concatenate([whole, np.stack([begun, stem[begun], np.zeros(len(begun), np.int64)], 1)]).astype(np.int64)
    found = found[np.argsort(found[:, 0], kind="stable")]
    return found[:, 0], found[:, 1], found[:, 2]


#: What the logistic model sees: a constant, abuse, quotation, the strongest abuse, and abuse by length.
FEATURES = 5


def features(texts: list[str], automaton: Automaton, weights: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers a text. weights: a row a term, for exact and for misspelled matches."""
    cps, inside, off = _points(texts)
    start, end = _words(cps, inside)
    word, term, distance = matches(automaton, cps, start, end)
    out = np.zeros((len(texts), FEATURES))
    out[:, 0] = 1
    if not len(word):
        return out
    doc = np.searchsorted(off, start[word], "right") - 1
    quoting = np.isin(cps, [ord(c) for c in QUOTES])
    marks = np.concatenate([[0], np.cumsum(quoting)])
    weight = weights[term, distance]
    doc, word, weight = doc[weight > 0], word[weight > 0], weight[weight > 0]
    first_word = np.searchsorted(start, off[:-1])
    last_word = np.searchsorted(start, off[1:])
    abuse, quoted, most = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for w, d, x in zip(word.tolist(), doc.tolist(), weight.tolist(), strict=True):
        lo, hi = max(w - WINDOW, first_word[d]), min(w + WINDOW, last_word[d] - 1)
        before = marks[start[w]] - marks[start[lo]]
        after = marks[end[hi]] - marks[end[w]]
        reported = False
        if not (before and after):
            near = "".join(map(chr, cps[start[lo] : end[hi]])).split()
            reported = not REPORTING.isdisjoint(near)
        if (before and after) or reported:
            quoted[d] += x
        else:
            abuse[d] += x
            most[d] = max(most[d], x)
    rate = np.log1p(100 * abuse / (last_word - first_word + 20))
    out[:, 1], out[:, 2], out[:, 3], out[:, 4] = np.log1p(abuse), np.log1p(quoted), most, rate
    return out


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: np.ndarray
    coefficients: np.ndarray


#: Words and beginnings that a task counts before it sends them on.
COUNTED = 200_000


def _counted(counts: dict[int, Counter]) -> pa.RecordBatch:
    terms = sorted(set(counts[0]) | set(counts[1]))
    return pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()), *(pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0))],
        ["term", "is_stem", "toxic", "other"],
    )


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other rows of the task hold each word and each beginning of four to eight letters; in parts, so that none is large."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            cps, inside, _ = _points([text or ""])
            start, end = _words(cps, inside)
            flat = "".join(map(chr, cps))
            own = {flat[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)}
            own = {w for w in own if 3 <= len(w) <= 24}
            counts[int(toxic)].update((w, False) for w in own)
            counts[int(toxic)].update((w[:n], True) for w in own for n in range(4, min(9, len(w))))
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield _counted(counts)
                counts = {0: Counter(), 1: Counter()}
    yield _counted(counts)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit to ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; None if either class is missing."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    # SAMPLE ids at most, so this side may be broadcast whatever the tables' sizes
    sample = docs.join(F.broadcast(chosen), "doc_id").select(F.col("text").cast("string").alias("text"), "toxic")
    sample = sample.where("text is not null").persist()
    try:
        totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if len(totals) < 2:
            return None
        counted = sample.mapInArrow(lean(_vocabulary), "term string, is_stem boolean, toxic long, other long").groupBy("term", "is_stem").agg(F.sum("toxic").alias("t"), F.sum("other").alias("c"))
        odds = F.log((F.col("t") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("c") + 0.5) / (totals[0] + 1.0))
        sure = odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
        telling = counted.where(F.col("t") >= SEEN).select("term", "is_stem", "t", odds.alias("odds"), sure.alias("sure")).where(F.col("sure") > ODDS)
        rows = telling.orderBy(F.desc("sure"), "term", "is_stem").limit(8 * TERMS).collect()  # at most 8 * TERMS rows
        terms = _lexicon(rows)
        automaton = compile_lexicon([(t, s) for t, s, _ in terms])
        exact = np.array([w for *_, w in terms])
        n = len(terms)

        def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of the task, by class and term, that hold a misspelling of the term."""
            seen = np.zeros((2, n), np.int64)
            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    cps, inside, _ = _points([text])
                    _, term, distance = matches(automaton, cps, *_words(cps, inside))
                    seen[toxic, np.unique(term[distance > 0])] += 1
            at = np.flatnonzero(seen.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], ["term", "t", "c"])

        found = sample.mapInArrow(lean(misspelled), "term long, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()  # a row a term
        near = 0.7 * exact
        for r in found:  # misspellings that are words of their own must prove themselves
            near[r["term"]] = min(near[r["term"]], np.log((r["t"] + 1) / (totals[1] + 1)) - np.log((r["c"] + 0.5) / (totals[0] + 1)) - ODDS)
        weights = np.stack([exact, near], 1).reshape(n, 2)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b in K.blocks(K.flat(batch.column("text"))[1], 1 << 19):
                    f = features(batch.column("text").slice(a, b - a).to_pylist(), automaton, weights)
                    yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k]) for k in range(1, FEATURES)), batch.column("toxic").slice(a, b - a)], [*(f"f{k}" for k in range(1, FEATURES)), "toxic"])

        got = np.array(sample.select("text", "toxic").mapInArrow(lean(measured), ", ".join(f"f{k} double" for k in range(1, FEATURES)) + ", toxic int").collect(), float)  # SAMPLE rows at most
        order = np.lexsort(got.T)
        x, y = np.column_stack([np.ones(len(got)), got[order][:, :-1]]), got[order][:, -1]
        return Model([(t, s) for t, s, _ in terms], weights, _logistic(x, y))
    finally:
        sample.unpersist()


def _lexicon(rows: list) -> list[tuple[str, bool, float]]:
    """Beginnings that stand for more than their most common word, and the words that none of them covers."""
    words = {r["term"]: r for r in rows if not r["is_stem"]}
    best: dict[str, int] = {}
    for w, r in words.items():
        for n in range(4, min(9, len(w))):
            best[w[:n]] = max(best.get(w[:n], 0), r["t"])
    stems: list = []
    for r in sorted((r for r in rows if r["is_stem"]), key=lambda r: (-r["sure"], r["term"])):
        spread = r["t"] > 1.5 * best.get(r["term"], SEEN - 1) and r["t"] >= 2 * SPREAD
        if spread and not any(r["term"].startswith(s["term"]) or s["term"].startswith(r["term"]) for s in stems):
            stems.append(r)
    covered = lambda w: any(w.startswith(s["term"]) for s in stems)
    kept = [(r["term"], True, r["odds"]) for r in stems] + [(w, False, r["odds"]) for w, r in words.items() if not covered(w)]
    return sorted(kept, key=lambda k: (-k[2], k[0]))[:TERMS]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return b


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= THRESHOLD)."""
    source, schema = extended(docs, score="double", predicted="int")
    sent = docs.sparkSession.sparkContext.broadcast(model and (compile_lexicon(model.terms), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for a, b in K.blocks(K.flat(column)[1], 1 << 19):
                p = np.zeros(b - a)
                if sent.value:
                    automaton, model = sent.value
                    f = features([t or "" for t in column.slice(a, b - a).to_pylist()], automaton, model.weights)
                    p = 1 / (1 + np.exp(-np.clip(f @ model.coefficients, -30, 30)))
                yield batch.slice(a, b - a).append_column("score", pa.array(p)).append_column("predicted", pa.array((p >= THRESHOLD).astype(np.int32)))

    return source.mapInArrow(lean(run), schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out, score all: (doc_id, held_out, score, predicted)."""
    from .langid import is_held_out

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), is_held_out().alias("held_out"))
    model = train(docs.where("not held_out"), labels.select("doc_id", "toxic").where(~is_held_out()))
    return score(docs, model).drop("text")
