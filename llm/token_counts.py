"""Token counts by a piece model, without making the tokens: by its merges, and count-only Viterbi over its scores.

The given model, piece_bpe_32k, is BPE: its scores are ranks of merges, not log probabilities. Its own count, the one that the tokenizer's library gives,
is that of the merges: of all neighbours whose concatenation is a piece, those of the highest score, of equal ones the leftmost, are
joined first. Viterbi is for unigram models; over ranks it gives the best sum of ranks, which is no shipped tokenizer's count.
Runs of the mark have a placeholder score of -1e9 in the given model. It is taken as it stands, so the best path avoids them; with a plain score in its
place, the counts are those of the library's own unigram model over the same pieces (tests/llm/test_unigram.py).

Viterbi:

Spaces become the mark U+2581, and one more stands before the text. An Aho-Corasick automaton of the vocabulary enumerates the pieces that end at each
character; dynamic programming carries, for each place, the best sum of scores and the number of pieces of that
path. Among equal sums the piece that starts first stays, as in the reference algorithm, which takes a later candidate only
if it is strictly better. A character that is no piece itself may be unknown, at ten below the least score; it counts a token for each of its
UTF-8 bytes.

A text of any length and without any space is counted whole. No piece holds the mark after another character, so a text is cut before each mark that follows one, and a task keeps the
counts of the parts it has met in a bounded table. Null and empty texts have no tokens. Rows keep their other
columns; repeated rows stay repeated; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import repeat
from operator import add

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as K
from .spark_io import extended, lean

MARK, UNKNOWN_BELOW = "▁", 10.0
#: Parts whose counts a worker keeps, and their letters; beyond either it starts anew.
KEPT, LETTERS, CHUNK = 400_000, 6_000_000, 1 << 19
#: Longest part whose best pair is looked for anew after each merge.
SHORT = 48


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a SentencePiece model, without control, unknown and byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))}


class Counter:
    def __init__(self, pieces: dict[str, float]):
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece holds the mark after another character")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pieces = pieces
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_BELOW
        self.kept: dict[str, tuple[int, int, float]] = {}
        self.letters = 0

    def part(self, text: str) -> tuple[int, float]:
        """Number of pieces and score of the best path."""
        best, count = [0.0] + [None] * len(text), [0] * (len(text) + 1)
        at = 0  # places up to here are settled
        single, unknown = self.single, self.unknown

        def settle(end: int) -> None:
            """The unknown character before each place up to end comes last of its candidates."""
            nonlocal at
            while at < end:
                c = text[at]
                if c not in single:
                    score = best[at] + unknown
                    if best[at + 1] is None or score > best[at + 1]:
                        best[at + 1], count[at + 1] = score, count[at] + len(c.encode())
                at += 1

        for last, (size, own) in self.automaton.iter(text):
            if last > at:
                settle(last)
            start, end = last + 1 - size, last + 1
            score = best[start] + own
            if best[end] is None or score > best[end]:  # longer pieces come first
                best[end], count[end] = score, count[start] + 1
        settle(len(text))
        return count[-1], best[-1]

    def merged(self, text: str) -> int:
        """Number of pieces that the merges leave."""
        pieces, own = self.pieces, list(text)
        if len(own) <= SHORT:
            get, none = pieces.get, float("-inf")
            scores = list(map(get, map(add, own, own[1:]), repeat(none)))
            best = max(scores, default=none)
            while best != none:
                k = scores.index(best)  # the leftmost
                both = own[k] = own[k] + own.pop(k + 1)
                del scores[k]
                if k:
                    scores[k - 1] = get(own[k - 1] + both, none)
                if k < len(scores):
                    scores[k] = get(both + own[k + 1], none)
                best = max(scores, default=none)
            return sum(1 if len(p) > 1 or p in self.single else len(p.encode()) for p in own)
        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        waiting: list[tuple[float, int, int, str]] = []

        def meet(a: int, b: int) -> None:
            if a >= 0 and b < len(own):
                both = own[a] + own[b]
                score = pieces.get(both)
                if score is not None:
                    heapq.heappush(waiting, (-score, a, b, both))

        for b in range(1, len(own)):
            meet(b - 1, b)
        while waiting:
            _, a, b, both = heapq.heappop(waiting)
            if not own[a] or not own[b] or len(own[a]) + len(own[b]) != len(both):
                continue  # one of them has been joined to another since
            own[a], own[b] = both, ""
            after[a] = after[b]
            if after[a] < len(own):
                before[after[a]] = a
            meet(before[a], a)
            meet(a, after[a])
        return sum(1 if len(p) > 1 or p in self.single else len(p.encode()) for p in own if p)

    def count(self, text: str) -> tuple[int, float]:
        """Viterbi's number of pieces and their score."""
        return self.counts(text)[1:]

    def counts(self, text: str) -> tuple[int, int, float]:
        """Number of pieces by the merges; by Viterbi, and their score."""
        if not text:
            return 0, 0, 0.0
        parts = [MARK + p for p in text.split(" ")]
        if "" in text.split(" ") or MARK in text:
            parts = self._cut(MARK + text.replace(" ", MARK))
        if len(self.kept) > KEPT or self.letters > LETTERS:
            self.kept, self.letters = {}, 0
        m, n, total, kept = 0, 0, 0.0, self.kept
        for p in parts:
            got = kept.get(p)
            if got is None:
                self.letters += len(p)
                got = kept[p] = (self.merged(p), *self.part(p))
            m += got[0]
            n += got[1]
            total += got[2]
        return m, n, total

    @staticmethod
    def _cut(marked: str) -> list[str]:
        cuts = [0, *(i for i in range(1, len(marked)) if marked[i] == MARK != marked[i - 1]), len(marked)]
        return [marked[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_counters: dict[str, Counter] = {}


def _appended(docs: DataFrame, pieces: dict[str, float], counted, **columns: str) -> DataFrame:
    """``docs`` with columns of what ``counted(counter, text)`` gives. pieces: of fixed size, sent to each executor once."""
    source, schema = extended(docs, **columns)
    kinds = {"long": pa.int64(), "double": pa.float64()}
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    name = hashlib.sha256(repr(sorted(pieces.items())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(sent.value)
        counter = _counters[name]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for a, b in K.blocks(K.flat(column)[1], CHUNK):
                got = zip(*(counted(counter, t or "") for t in column.slice(a, b - a).to_pylist()), strict=True)
                out = batch.slice(a, b - a)
                for (column_name, kind), values in zip(columns.items(), got, strict=True):
                    out = out.append_column(column_name, pa.array(values, kinds[kind]))
                yield out

    return source.mapInArrow(lean(run), schema)


def token_counts(docs: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """``docs`` with Viterbi's ``n_tokens`` and ``log_score`` of each text: a tokenizer's count if the scores are of a unigram model."""
    return _appended(docs, pieces, Counter.count, n_tokens="long", log_score="double")


def merge_counts(docs: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """``docs`` with ``n_tokens`` by the merges, which is a BPE model's own count, and Viterbi's ``n_viterbi`` and ``log_score``."""
    return _appended(docs, pieces, Counter.counts, n_tokens="long", n_viterbi="long", log_score="double")
