"""Main text of web pages by a tree-structured graphical model, trained from labelled pages.

A page becomes a tree of elements and texts (``html_tree``). Every node is content or not: what is known of it (tag, class and id words, amount of text,
links, sentences, place) gives its own potential, and each edge one for its parent's and its own label. Messages up and down the tree give each
node's exact probability (``html_model``), and the texts that are more likely content than not are the result: white space within a block is one
space, blocks are joined by an empty line. Nothing else drops or cuts a text, but for what no reader sees: scripts, styles, templates, and controls of forms.

Labelled pages have the attribute ``data-label`` ("1" or "0") on elements; what lies within takes it over. There are none among the given tables, so ``labelled``
makes them: texts of ``documents`` of the least hashes of their ids, SAMPLE of them and no more than LETTERS long, set in pages of many kinds (``html_pages``).
The model is learned from these at the driver, whose memory SAMPLE and LETTERS bound; with no labelled page every weight is 0, and all text is kept.

A null html counts as empty and gives an empty text. Pages are handled one by one, whole, whatever their length or depth; repeated rows give repeated rows; an
empty table gives none. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .html_model import Forest, Model, fit
from .html_pages import labelled_page
from .html_tree import Tree, features, joined, kind
from .spark_io import lean

#: Documents that labelled pages are made of, and the longest.
SAMPLE, LETTERS = 800, 4000
#: Bytes of html whose trees are one forest.
CHUNK = 1 << 18


def labelled(documents: DataFrame, sample: int = SAMPLE, letters: int = LETTERS) -> DataFrame:
    """(html): labelled pages made of the ``sample`` documents of least hash, of at most ``letters`` code points each."""
    fit_ = documents.where((F.char_length("text") > 0) & (F.char_length("text") <= letters)).select(F.xxhash64("doc_id", "text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = map(labelled_page, batch.column("text").to_pylist(), batch.column("h").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([p for p in pages if p], pa.string())], ["html"])

    return fit_.orderBy("h", "text").limit(sample).mapInArrow(lean(run), "html string")


def forest(trees: list[Tree]) -> tuple[list[list[str]], Forest]:
    """Features of all nodes of the trees, and the trees as one forest."""
    parent, kinds, rows = [], [], []
    for tree in trees:
        at = len(rows)
        parent += [p + at if p >= 0 else -1 for p in tree.parent]
        kinds += map(kind, tree.tag)
        rows += features(tree)
    return rows, Forest(np.array(parent, np.int64), np.array(kinds, np.int64))


def labels(tree: Tree) -> list[int]:
    """A text's own label; for an element, that of most letters in it."""
    size = [0] * len(tree.tag)
    content = [0] * len(tree.tag)
    for i in range(len(tree.tag) - 1, -1, -1):
        if tree.tag[i] == "#":
            size[i] = len(tree.piece[i].strip())
            content[i] = size[i] * tree.label[i]
        if i:
            size[tree.parent[i]] += size[i]
            content[tree.parent[i]] += content[i]
    return [int(2 * c > s) if s else own for c, s, own in zip(content, size, tree.label, strict=True)]


def train(pages: DataFrame) -> Model:
    """A model of labelled pages (html), which are gathered: bound them before."""
    trees = [Tree(r["html"]) for r in pages.collect()]
    rows, trees_together = forest(trees)
    return fit(rows, trees_together, np.array([x for tree in trees for x in labels(tree)], np.int64))


def main_texts(htmls: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [Tree(h) for h in htmls]
    rows, together = forest(trees)
    kept = model.content(rows, together) >= 0.5
    bounds = np.cumsum([0, *(len(t.tag) for t in trees)])
    return [joined(t, kept[a:b].tolist()) for t, a, b in zip(trees, bounds[:-1], bounds[1:], strict=True)]


def extracted(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars): each page's main text."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # as large as the features of the labelled sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            for a, b in K.blocks(K.flat(column)[1], CHUNK):
                texts = main_texts([h or "" for h in column.slice(a, b - a).to_pylist()], sent.value)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
