"""What changed between two texts, told line by line.

A line that either text holds once is the same line in both; a longest rising sequence of such pairs keeps those that stand
in one order. Kept pairs cut both texts into gaps, and the next round looks for lines that are single within a gap. Where a gap shares only repeated
lines, the first of each text is taken for the first of the other, and so on. Rounds end when no gap shares a line, so nothing that stands in the same place is
reported, whatever the texts' length: no table of all pairs of lines is made, and none is given up on.

A changed line and the one that takes its place are compared again by the same rounds, their words in the place of lines.

Both texts of a pair stand in one row, so lines and words meet there (``matched``) and only changed lines become rows; words never do. What is held for one pair of texts fits where the texts themselves do: a row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that stay on either side of what a line leaves out (a fixed value); stretches that wouldn't get shorter by it stay whole.
ANCHOR = 40


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising sequence, by piles: each value goes on the first pile whose top isn't below it, and remembers the top before."""
    tops: list[int] = []
    top_at: list[int] = []
    before = []
    for at, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(top_at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [value]
        top_at[pile : pile + 1] = [at]
    out, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def matched(old: list[str], new: list[str]) -> tuple[list[tuple[int, int]], dict[int, tuple[list[int], list[int]]]]:
    """(old place, new place) of units with a mate, in order, and of each gap the places on either side of units without one. A gap is named by the old place of the kept unit before, or -1."""
    kept, lone = [], {}
    todo = [(-1, range(len(old)), range(len(new)))]
    while todo:
        gap, olds, news = todo.pop()
        at_old: dict[str, list[int]] = {}
        at_new: dict[str, list[int]] = {}
        for k in olds:
            at_old.setdefault(old[k], []).append(k)
        for k in news:
            if new[k] in at_old:
                at_new.setdefault(new[k], []).append(k)
        pairs = [(at_old[x][0], ks[0]) for x, ks in at_new.items() if len(ks) == 1 and len(at_old[x]) == 1]
        pairs = sorted(pairs or [pair for x, ks in at_new.items() for pair in zip(at_old[x], ks, strict=False)])
        if not pairs:
            lone[gap] = list(olds), list(news)
            continue
        pairs = [pairs[k] for k in longest_rising([n for _, n in pairs])]
        kept += pairs
        name, a, b = gap, 0, 0
        for o, n in [*pairs, (len(old), len(new))]:
            to_a, to_b = bisect_left(olds, o, a), bisect_left(news, n, b)
            if to_a > a or to_b > b:
                todo.append((name, olds[a:to_a], news[b:to_b]))
            name, a, b = o, bisect_right(olds, o, to_a), bisect_right(news, n, to_b)
    return sorted(kept), lone


def _changed(rows: DataFrame) -> DataFrame:
    """rows(key, old, new) to (key, gap, rank, old_at, new_at, old, new): a changed line and the one that took its place, or null, null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (old, new) in enumerate(zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True)):
                a, b = old.split("\n"), new.split("\n")
                told = [(gap, rank, x, y) for gap, sides in matched(a, b)[1].items() for rank, (x, y) in enumerate(zip_longest(*sides), 1)]
                if told:
                    gap, rank, x, y = (pa.array(c, pa.int32()) for c in zip(*told, strict=True))
                    texts = (pa.array([None if t[side] is None else text[t[side]] for t in told], pa.string()) for side, text in ((2, a), (3, b)))
                    key = batch.column("key").take(pa.array([k] * len(told)))
                    yield pa.RecordBatch.from_arrays([key, gap, rank, x, y, *texts], ["key", "gap", "rank", "old_at", "new_at", "old", "new"])

    differ = rows.where(F.coalesce("old", F.lit("")) != F.coalesce("new", F.lit(""))).select("key", F.coalesce("old", F.lit("")).alias("old"), F.coalesce("new", F.lit("")).alias("new"))
    return differ.dropDuplicates(["key"]).mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, gap int, rank int, old_at int, new_at int, old string, new string")


def changed_lines(rows: DataFrame, old: str, new: str) -> DataFrame:
    """(key, gap, rank, side, at, line): lines that only one of the two texts has in their place. rows: (key, old, new), null counts as empty; equal keys have equal texts.

    gap: the old place of the kept line before, or -1. rank: the line's number among its side's changed lines in the gap, so that what was
    there and what took its place have the same.
    """
    both = _changed(rows.select("key", F.col(old).alias("old"), F.col(new).alias("new")))
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(f"{c}_at").alias("at"), F.col(c).alias("line"))
    return both.select("key", "gap", "rank", F.inline(F.array(side(0, "old"), side(1, "new")))).where("at is not null")


def _cuts(old: str, new: str, anchor: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Of two lines the stretches that are left out: runs of words that both hold, without ``anchor`` characters beside each change."""
    words = [re.findall(r"\w+|\s+|[^\w\s]", x, re.ASCII) for x in (old, new)]
    ends = [[0, *accumulate(map(len, x))] for x in words]
    out: tuple[list, list] = [], []
    runs: list[list[tuple[int, int]]] = []
    for pair in matched(*words)[0]:
        if runs and runs[-1][-1] == (pair[0] - 1, pair[1] - 1):
            runs[-1].append(pair)
        else:
            runs.append([pair])
    for run in runs:
        for side, line in enumerate((old, new)):
            start, end = ends[side][run[0][side]], ends[side][run[-1][side] + 1]
            a, b = start + (anchor if start else 0), end - (anchor if end < len(line) else 0)
            if end - start >= 2 * anchor and b > a:
                out[side].append((a, b))
    return out


def _shortened(pairs: DataFrame, anchor: int) -> DataFrame:
    """pairs with ``old`` and ``new`` cut."""
    keep = pairs.columns
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True)
            # a stretch that is left out has two anchors' length at least
            cuts = [_cuts(a, b, anchor) if min(len(a or ""), len(b or "")) >= 2 * anchor else ([], []) for a, b in lines]
            sides = (pa.array([[{"start": a, "end": b} for a, b in x[side]] for x in cuts], kind) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sides], [*keep, "_old", "_new"])

    piece = lambda text, a, b: F.substring(text, a + 1, b - a)

    def short(line: str) -> Column:
        step = lambda acc, c: F.struct(F.concat(acc["out"], piece(F.col(line), acc["at"], c["start"]), F.lit("…")).alias("out"), c["end"].alias("at"))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(f"_{line}", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(line), acc["at"] + 1, F.char_length(line))))

    spans = "array<struct<start:int,end:int>>"
    told = pairs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), f"_old {spans}", f"_new {spans}"]))
    return told.withColumns({"old": short("old"), "new": short("new")}).select(*keep)


def shortened(pairs: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """(key, side, line) of pairs(key long, old, new): lines without the long stretches of words that both hold, of which ``anchor`` characters stay beside each change."""
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("line"))
    return _shortened(pairs, anchor).select("key", F.inline(F.array(side(0, "old"), side(1, "new"))))


def with_diffs(versions: DataFrame, old: str, new: str, name: str = "diff") -> DataFrame:
    """Adds what ``new`` lost and gained against ``old``: a line for each, ``- `` or ``+ `` before it, what took a line's place right after it.

    Lines that both hold aren't told, nor any places. Equal texts (null counts as empty) have an empty diff. Rows may repeat.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    # equal pairs of texts have one key and one diff; the length sets the two texts apart
    source = versions.drop(name).withColumn("_key", F.unhex(F.md5(F.concat(F.char_length(text(old)).cast("string"), F.lit(" "), text(old), text(new)))))
    told = _shortened(_changed(source.select(F.col("_key").alias("key"), F.col(old).alias("old"), F.col(new).alias("new"))), ANCHOR)
    both = F.concat_ws("\n", F.concat(F.lit("- "), "old"), F.concat(F.lit("+ "), "new"))
    lines = told.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("gap", "rank", both.alias("text")))).alias("_lines"))
    out = F.coalesce(F.array_join(F.col("_lines.text"), "\n"), F.lit(""))
    return source.join(lines, "_key", "left").withColumn(name, out).drop("_key", "_lines")
