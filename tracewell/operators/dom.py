"""The recorded page as rows: lifetimes of its nodes, and what an event's target was at that moment: tag, class, followed address, shown text.

A snapshot begins a new page (``epoch``). A node named in it or added later is an *instance* from that event on. Its parent is fixed then: whoever has
another parent has been added again. It ends at its own removal, when it is added again, or with its parent; the ends of all ancestors come together by pointer doubling, in
as many rounds as the depth has binary digits, and so does the nearest anchor above. An instance whose parent isn't there, or that is its own ancestor, never lives.

What events said of nodes, and what is asked of them, meets by page in one shuffle, sorted by page. Tasks take whole pages from it, many at a time, as arrays (``_Played``): states by node and
moment, in which a binary search finds the last one at a moment. A page's rows are all that a task holds beside one batch, and only what was asked for leaves it. Taking an event's JSON
tree apart and numbering nodes in document order are loops; there is no mirror that replays a slice.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import exprs as X
from tracewell.operators.slices import KEYS, ORDER

# Numbers of node types and event kinds in the recording format, elements that make links, and those that show no text.
ELEMENT, TEXT, SNAPSHOT, INCREMENTAL, MUTATION = 2, 3, 2, 3, 0
ANCHORS = ("a", "area")
UNSHOWN = ("script", "style", "noscript", "template", "head", "title", "meta", "link", "defs", "symbol", "clippath", "mask", "lineargradient", "radialgradient", "pattern", "metadata", "desc")
#: Words of a target's text are cut at so many characters (a fixed value).
TEXT_CAP = 80
#: Texts of an element that are looked at together (a fixed value).
STRETCH = 32
#: Bytes of events' texts that are taken apart together, and nodes that are taken out of arrays together (fixed values).
TEXTS, NODES = 1 << 23, 1 << 18
#: An end that never comes.
NEVER = (1 << 62) - 1
PAGE = (*KEYS, "epoch")
_NODE = {
    "node_id": pa.int64(), "tag": pa.string(), "class": pa.string(), "href": pa.string(), "value": pa.string(), "parent": pa.int64(), "next": pa.int64(), "kind": pa.int32(), "said": pa.string(), "place": pa.int32(),
}
_TYPES = {"node_id": "long", "tag": "string", "class": "string", "href": "string", "value": "string", "parent": "long", "next": "long", "kind": "integer", "said": "string", "place": "integer"}


def _number(x: object) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) else None


def _text(attributes: dict, name: str) -> str | None:
    value = attributes.get(name)
    return value if isinstance(value, str) else None


def _added(trees: list[tuple[dict, int | None, int | None]]) -> Iterator[tuple]:
    """Rows of trees with the ids that they hang from, and those that they stand before; within a tree in page order."""
    stack = [t for t in reversed(trees) if isinstance(t[0], dict)]
    while stack:
        node, parent, next_ = stack.pop()
        i, kind, tag = _number(node.get("id")), _number(node.get("type")), node.get("tagName")
        if i is None:
            continue
        attributes = node.get("attributes")
        class_, href = (_text(attributes, "class"), _text(attributes, "href")) if attributes and isinstance(attributes, dict) else (None, None)
        yield i, tag.lower() if kind == ELEMENT and isinstance(tag, str) else None, class_, href, _text(node, "textContent") if kind == TEXT else None, parent, next_, kind, "add"
        if below := node.get("childNodes"):
            stack += [(c, i, None) for c in reversed(below) if isinstance(c, dict)]


def _told(i: object, said: str, class_: str | None = None, href: str | None = None, value: str | None = None) -> tuple:
    return _number(i), None, class_, href, value, None, None, None, said


def _rows(raw: str) -> Iterator[tuple]:
    """What an event's JSON text says of nodes, in the order of ``_NODE`` without the place."""
    try:
        event = json.loads(raw)
    except ValueError:
        return
    if not isinstance(event, dict):
        return
    data = event["data"] if isinstance(event.get("data"), dict) else {}
    each = lambda name: (x for x in data.get(name) or [] if isinstance(x, dict)) if isinstance(data.get(name) or [], list) else ()
    if event.get("type") == SNAPSHOT:
        yield from _added([(data.get("node"), None, None)])
    elif event.get("type") == INCREMENTAL and data.get("source") == MUTATION:
        for x in each("removes"):
            yield _told(x.get("id"), "remove")
        yield from _added([(x.get("node"), _number(x.get("parentId")), _number(x.get("nextId"))) for x in each("adds")])
        for x in each("texts"):
            yield _told(x.get("id"), "text", value=_text(x, "value"))
        for x in each("attributes"):
            yield _told(x.get("id"), "attributes")
            told = x.get("attributes") if isinstance(x.get("attributes"), dict) else {}
            if "class" in told:
                yield _told(x.get("id"), "class", class_=_text(told, "class"))
            if "href" in told:
                yield _told(x.get("id"), "href", href=_text(told, "href"))
    elif event.get("type") == INCREMENTAL:
        ids = [data.get("id"), *(x.get("id") for x in each("positions")), *(x.get(c) for x in each("ranges") for c in ("start", "end"))]
        for i in dict.fromkeys(map(_number, ids)):
            if i is not None and i >= 1:
                yield _told(i, "refer")


def with_epochs(events: DataFrame) -> DataFrame:
    """Adds ``epoch``, how many snapshots of its slice stand before or at each event, and ``at``, the event's number in its slice. events: with type."""
    w = Window.partitionBy(*KEYS).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("epoch", F.sum((F.col("type") == SNAPSHOT).cast("int")).over(w)).withColumn("at", F.count("*").over(w))


def nodes(events: DataFrame, raw: str = "raw", more: tuple[str, ...] = ()) -> DataFrame:
    """What each event said of nodes: ``events`` with epochs to (keys, epoch, at, timestamp, node_id, tag, class, href, value, parent, next, kind, place, said), and ``more`` columns of the events."""
    return _taken_apart(events, raw, more, None, tuple(_NODE), False)


def packed(events: DataFrame, raw: str = "raw", more: tuple[str, ...] = (), only: tuple[str, ...] | None = None, needs: tuple[str, ...] = tuple(_TYPES)) -> DataFrame:
    """``nodes`` with one row an event: what is said of nodes, of the kinds in ``only`` and with the columns in ``needs``, stands in arrays. The operators below take either; rows of arrays are far fewer to move and to sort."""
    return _taken_apart(events, raw, more, only, tuple(c for c in _NODE if c in needs or c in ("node_id", "said", "place")), True)


def _taken_apart(events: DataFrame, raw: str, more: tuple[str, ...], only: tuple[str, ...] | None, columns: tuple[str, ...], as_arrays: bool) -> DataFrame:
    keep = [*PAGE, "at", "timestamp", *more]
    source = events.where(F.col("type").isin(SNAPSHOT, INCREMENTAL)).select(*keep, F.col(raw).alias("raw"))
    schema = _schema(source, keep, ", ".join(f"`{c}` {f'array<{_TYPES[c]}>' if as_arrays else _TYPES[c]}" for c in columns))
    fields = list(_NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stretches(batch, pc.binary_length(batch.column("raw")), TEXTS):
                code = part.column("raw").dictionary_encode()  # texts that are repeated are taken apart once
                each = [[(*row, k) for k, row in enumerate(x for x in _rows(text) if x[0] is not None) if only is None or row[-1] in only] if text else [] for text in code.dictionary.to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, each)]), pa.int32())
                values = list(zip(*(row for own in each for row in own), strict=True)) or [()] * len(fields)
                said = {c: pa.ListArray.from_arrays(ends, pa.array(values[fields.index(c)], _NODE[c])).take(code.indices) for c in columns}
                out = pa.RecordBatch.from_arrays([*part.select(keep).columns, *said.values()], [*keep, *columns])
                out = out.filter(pc.greater(pc.fill_null(pc.list_value_length(said["said"]), 0), 0))
                yield from [out] if as_arrays else _as_rows(out)

    return source.mapInArrow(run, schema)


def _stretches(batch: pa.RecordBatch, sizes: pa.Array, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of rows whose sizes come to little more than limit."""
    part = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for start, stop in zip(starts, [*starts[1:], len(part)], strict=True):
        yield batch.slice(start, stop - start)


def _as_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch with what events said in arrays, as one of what they said; as it is if it has no arrays."""
    if not pa.types.is_list(batch.column("said").type):
        yield batch
        return
    for part in _stretches(batch, pc.list_value_length(batch.column("said")), NODES):
        row = pa.array(np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("said")).to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([c.flatten() if n in _NODE else c.take(row) for n, c in zip(part.schema.names, part.columns, strict=True)], part.schema.names)


# ------------------------------------------------------------------ pages in tasks
def _page_numbers(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """A number for each row's page, from 0; rows of a page stand together."""
    fresh = np.zeros(rows.num_rows, bool)
    for c in PAGE:
        column = rows.column(c)
        codes = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(fresh)


def _by_page(rows: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of whole pages, many at a time. Rows meet by page in one shuffle; the last page of a batch waits for its other rows."""
    key = lambda batch, k: [batch.column(c)[k].as_py() for c in PAGE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (rows for packed_rows in batches for rows in _as_rows(packed_rows)):
            if not batch.num_rows:
                continue
            page = _page_numbers(batch)
            start = int(np.searchsorted(page, page[-1]))
            if start or (held and key(held[-1], -1) != key(batch, 0)):
                yield from f(pa.Table.from_batches([*held, batch.slice(0, start)])).to_batches()
                held = []
            held.append(batch.slice(start))
        if held:
            yield from f(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, schema)


def _schema(rows: DataFrame, columns: list[str], more: str = "", types: dict[str, str] | None = None) -> str:
    return ", ".join([*(f"`{c}` {(types or {}).get(c) or rows.schema[c].dataType.simpleString()}" for c in columns), *([more] if more else [])])


def _is_packed(told: DataFrame) -> bool:
    return told.schema["said"].dataType.typeName() == "array"


def _of_kinds(told: DataFrame, says: tuple[str, ...]) -> DataFrame:
    """Without other kinds, which aren't asked for; arrays keep them, as they hold those that ``packed`` was asked for."""
    return told if _is_packed(told) else told.where(F.col("said").isin(*says))


def _picked(values: pa.ChunkedArray, at: np.ndarray) -> pa.ChunkedArray:
    """values at these places; null where a place is below 0."""
    return values.take(pa.array(at, pa.int64(), mask=at < 0))


def _at(values: np.ndarray, places: np.ndarray, none: int = -1) -> np.ndarray:
    """values at these places; none where a place is below 0."""
    out = np.full(len(places), none, values.dtype)
    out[places >= 0] = values[places[places >= 0]]
    return out


class _Played:
    """Whole pages' rows as arrays: instances by node and birth, each a place in ``row``, ``born``, ``ends``, ``up``, ``anchor`` (places too, -1 for none), and searches by node and moment."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.page, self.at, self.place = _page_numbers(rows), self.ints("at"), self.ints("place")
        self.is_said = {said: pc.fill_null(pc.equal(rows["said"], said), False).to_numpy() for said in ("add", "remove", "class", "href", "text", "attributes", "refer", "ask")}
        self.no_tag = rows["tag"].is_null().to_numpy()
        own = np.flatnonzero(self.is_said["add"] | self.is_said["remove"])
        self.ids = np.unique(self.ints("node_id")[own])
        self.keys = np.unique(self._key("node_id")[own])
        self.node, self.parent = self.named("node_id"), self.named("parent")
        self.span = int(self.at.max()) + 2
        self._instances(own)
        self._close()

    def ints(self, column: str) -> np.ndarray:
        return pc.fill_null(self.rows[column], 0).to_numpy().astype(np.int64)

    def _key(self, column: str) -> np.ndarray:
        """A number for each row's page and the id in column, of those that were ever added or removed; else -1."""
        if not len(self.ids):
            return np.full(self.rows.num_rows, -1)
        value = self.ints(column)
        code = np.minimum(np.searchsorted(self.ids, value), len(self.ids) - 1)
        known = (self.ids[code] == value) & self.rows[column].is_valid().to_numpy()
        return np.where(known, self.page * len(self.ids) + code, -1)

    def named(self, column: str) -> np.ndarray:
        """The number of the node that column names on its row's page, or -1."""
        if not len(self.keys):
            return np.full(self.rows.num_rows, -1)
        key = self._key(column)
        code = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[code] == key) & (key >= 0), code, -1)

    def _last(self, nodes: np.ndarray, moments: np.ndarray, node: np.ndarray, at: np.ndarray, before: bool = False) -> np.ndarray:
        """The place of a node's last state at ``at`` (or before it), or -1. nodes, moments: of the states, in order."""
        found = np.searchsorted(nodes * self.span + moments, node * self.span + at, "left" if before else "right") - 1
        return np.where((node >= 0) & (_at(nodes, found) == node), found, -1)

    def _instances(self, own: np.ndarray) -> None:
        adds = self.is_said["add"]
        own = own[np.lexsort((self.place[own], adds[own], self.at[own], self.node[own]))]  # a removal goes before an add in one event
        state = np.stack((self.node[own], self.at[own], adds[own]))
        own = own[np.append((state[:, 1:] != state[:, :-1]).any(0), True)] if len(own) else own
        node, at = self.node[own], self.at[own]
        ends = np.full(len(own), NEVER)
        follows = np.flatnonzero(node[1:] == node[:-1])
        ends[follows] = at[follows + 1]
        kept = adds[own]
        self.row, self.ends = own[kept], ends[kept]
        self.born, self.of = self.at[self.row], self.node[self.row]
        # the parent's instance is the last one that was there by then
        self.up = self._last(self.of, self.born, self.parent[self.row], self.born)
        lost = (self.up < 0) & self.rows["parent"].is_valid().to_numpy()[self.row]
        self.ends[lost] = self.born[lost]

    def _close(self) -> None:
        # of the stretch from a node, exclusive, to where its pointer leads, inclusive: the nearest anchor, and whether a document shuts off what is beyond it
        is_anchor = pc.fill_null(pc.is_in(self.rows["tag"], pa.array(ANCHORS)), False).to_numpy()[self.row]
        to = self.up.copy()
        anchor = np.where(_at(is_anchor, to, False), to, -1)
        shut = _at(self.no_tag[self.row], to, True)
        for _ in range(len(to).bit_length() + 1):
            a = np.flatnonzero(to >= 0)
            if not len(a):
                break
            b = to[a]
            ends, found, closed, to_ = np.minimum(self.ends[a], self.ends[b]), np.where((anchor[a] < 0) & ~shut[a], anchor[b], anchor[a]), shut[a] | shut[b], to[b]
            self.ends[a], anchor[a], shut[a], to[a] = ends, found, closed, to_
        self.ends[to >= 0] = self.born[to >= 0]  # pointers that never leave the page go round
        self.ends, self.anchor = np.maximum(self.ends, self.born), anchor
        self.living = np.flatnonzero(self.ends > self.born)

    def alive(self, node: np.ndarray, at: np.ndarray, before: bool = False) -> np.ndarray:
        """The instance of a node that lives at ``at``, or -1. One born in the event itself counts; before: one that ends in it."""
        found = self._last(self.of[self.living], self.born[self.living], node, at, before)
        place = _at(self.living, found)
        return np.where(_at(self.ends, place) + before > at, place, -1)

    def told(self, rows: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A search for the last of these rows (a mask) that names a node, up to and with a moment."""
        states = np.flatnonzero(rows & (self.node >= 0))
        states = states[np.lexsort((self.place[states], self.at[states], self.node[states]))]
        nodes, moments = self.node[states], self.at[states]

        def search(node: np.ndarray, at: np.ndarray) -> np.ndarray:
            return _at(states, self._last(nodes, moments, node, at))

        return search

    def numbered(self, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all instances of these pages: number in document order, that after the last one below, and the number of the nearest element from it upward that shows no text, or -1.

        Over all that ever lived in a page. What was added before a sibling stands right before it.
        """
        of_pages = np.flatnonzero(np.isin(self.page[self.row], pages))
        of_pages = of_pages[np.lexsort((self.place[self.row[of_pages]], self.born[of_pages], self.page[self.row[of_pages]]))]
        unshown = pc.fill_null(pc.is_in(self.rows["tag"], pa.array(UNSHOWN)), False).to_numpy()[self.row].tolist()
        up, next_, of = self.up.tolist(), self.named("next")[self.row].tolist(), self.of.tolist()
        before: dict[int, list[int]] = {}
        below: dict[int, list[int]] = {}
        last: dict[int, int] = {}
        for k in of_pages.tolist():
            last[of[k]] = k
            sibling = last.get(next_[k]) if next_[k] >= 0 else None
            if sibling is not None and sibling != k and up[sibling] == up[k]:
                before.setdefault(sibling, []).append(k)
            else:
                below.setdefault(up[k], []).append(k)
        first, final, shut = [0] * len(up), [0] * len(up), [-1] * len(up)
        count = 0
        todo = [(k, 0) for k in reversed(below.get(-1, []))]
        while todo:
            k, step = todo.pop()
            if step == 0:  # those before it, then itself
                todo.append((k, 1))
                todo += [(x, 0) for x in reversed(before.get(k, []))]
            elif step == 1:
                first[k] = count
                shut[k] = count if unshown[k] else shut[up[k]] if up[k] >= 0 else -1
                count += 1
                todo.append((k, 2))
                todo += [(x, 0) for x in reversed(below.get(k, []))]
            else:
                final[k] = count
        return np.array(first, np.int64), np.array(final, np.int64), np.array(shut, np.int64)

    def links(self, target: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of elements at moments: the rows that told their class last, and the address that a browser follows: their own, else that of the nearest anchor above that has one."""
        node = _at(self.of, target)
        href, is_null = self.told(self.is_said["add"] | self.is_said["href"]), self.rows["href"].is_null().to_numpy()
        address = href(node, at)
        anchor = _at(self.anchor, target)
        while len(open_ := np.flatnonzero((anchor >= 0) & ((address < 0) | is_null[address]))):
            address[open_] = href(self.of[anchor[open_]], at[open_])
            anchor[open_] = self.anchor[anchor[open_]]
        return self.told(self.is_said["add"] | self.is_said["class"])(node, at), address

    def shown(self, target: np.ndarray, at: np.ndarray, cap: int) -> list[str | None]:
        """The texts below elements at moments, in page order; no more of them once there are more than ``cap`` characters that are no white space. Some at a time of each element."""
        parts: list[list[str]] = [[] for _ in target]
        length = np.zeros(len(target), np.int64)
        asked = np.flatnonzero(target >= 0)
        if len(asked):
            first, final, shut = self.numbered(np.unique(self.page[self.row[target[asked]]]))
            is_text = pc.fill_null(pc.equal(self.rows["kind"], TEXT), False).to_numpy()
            texts = self.living[is_text[self.row[self.living]] & (final[self.living] > 0)]
            texts = texts[np.argsort(first[texts], kind="stable")]
            value = self.told(self.is_said["text"] | (self.is_said["add"] & is_text))
            top = _at(first, target, 0)
            start, stop = np.searchsorted(first[texts], top), np.searchsorted(first[texts], _at(final, target, 0))
            while len(asked := asked[(start[asked] < stop[asked]) & (length[asked] <= cap)]):
                some = np.minimum(stop[asked] - start[asked], STRETCH)
                who = np.repeat(asked, some)
                text = texts[np.arange(len(who)) - np.repeat(np.cumsum(some) - some, some) + start[who]]
                seen = (self.born[text] <= at[who]) & (at[who] < self.ends[text]) & (shut[text] < top[who])
                who, text = who[seen], text[seen]
                for k, said in zip(who.tolist(), _picked(self.rows["value"], value(self.of[text], at[who])).to_pylist(), strict=True):
                    if said:
                        parts[k].append(said)
                        length[k] += len("".join(said.split()))
                start[asked] += some
        return ["".join(x) for x in parts]


# ------------------------------------------------------------------ lifetimes
def lifetimes(told: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Each node from each of its adds on: (keys, epoch, node_id, born, ends, parent, parent_born, tag, kind, value, next, place, anchor, anchor_born), or the keys, epoch and these columns.

    ends: by its own removal, the next add or the end of any ancestor, exclusive; those that never live end where they are born. (anchor, anchor_born): the nearest anchor above in its own document.
    """
    asked = lambda names: [c for c in names if columns is None or c in columns]
    as_told, found = [*PAGE, *asked(("node_id", "parent", "tag", "kind", "value", "next", "place"))], asked(("born", "ends", "parent_born", "anchor", "anchor_born"))

    def f(rows: pa.Table) -> pa.Table:
        p = _Played(rows)
        row = pa.array(p.row, pa.int64())
        out = rows.select(as_told).take(row)
        born = pa.chunked_array([pa.array(p.born, pa.int64())])
        more = {
            "born": lambda: born, "ends": lambda: pa.array(p.ends, pa.int64()), "parent_born": lambda: _picked(born, p.up), "anchor": lambda: _picked(rows["node_id"], _at(p.row, p.anchor)), "anchor_born": lambda: _picked(born, p.anchor),
        }
        for name in found:
            out = out.append_column(name, more[name]())
        return out

    needs = dict.fromkeys(("at", "said", *as_told, "node_id", "parent", "tag", "place"))
    return _by_page(_of_kinds(told, ("add", "remove")).select(*needs), f, _schema(told, as_told, ", ".join(f"{c} long" for c in found), _TYPES))


# ------------------------------------------------------------------ targets
def _asked(clicks: DataFrame, told: DataFrame, says: tuple[str, ...], needs: tuple[str, ...], f: Callable[[_Played, np.ndarray], dict[str, pa.Array]], found: str) -> DataFrame:
    """clicks with what f finds of them: clicks travel to the rows of their page, and come back alone. f: of pages and the clicks' places among their rows."""
    columns = clicks.columns
    of_nodes = ["node_id", "said", "place", "tag", "parent", *needs]
    ask = {"node_id": F.col("target_id"), "said": F.lit("ask")}
    asks = {c: ask.get(c, F.lit(None)).cast(_TYPES[c]) for c in of_nodes}
    if _is_packed(told):
        asks = {c: F.array(x) for c, x in asks.items()}
    asks = clicks.select(*PAGE, "at", *(x.alias(c) for c, x in asks.items()), F.struct(*columns).alias("ask"))
    both = _of_kinds(told, says).select(*PAGE, "at", *of_nodes).unionByName(asks, allowMissingColumns=True)

    def run(rows: pa.Table) -> pa.Table:
        p = _Played(rows)
        places = np.flatnonzero(p.is_said["ask"])
        own = rows["ask"].combine_chunks().take(pa.array(places, pa.int64()))
        return pa.Table.from_pydict({**dict(zip(columns, own.flatten(), strict=True)), **f(p, places)})

    return _by_page(both, run, _schema(clicks, columns, found))


def _targets(p: _Played, clicks: np.ndarray) -> np.ndarray:
    """The living elements that clicks meant, or -1."""
    target = p.alive(p.node[clicks], p.at[clicks])
    return np.where(_at(p.no_tag[p.row], target, True), -1, target)


def _links(p: _Played, clicks: np.ndarray) -> dict[str, pa.Array]:
    target = _targets(p, clicks)
    class_, href = p.links(target, p.at[clicks])
    return {"tag": _picked(p.rows["tag"], _at(p.row, target)), "class": _picked(p.rows["class"], class_), "href": _picked(p.rows["href"], href)}


def _texts(cap: int) -> Callable[[_Played, np.ndarray], dict[str, pa.Array]]:
    return lambda p, clicks: {"text": pa.array(p.shown(_targets(p, clicks), p.at[clicks], cap), pa.string())}


#: What the operators below need to be told, for ``packed``: kinds, and columns.
_LINK_SAYS, _TEXT_SAYS = ("add", "remove", "class", "href"), ("add", "remove", "text")
_LINK_NEEDS, _TEXT_NEEDS = ("class", "href"), ("kind", "value", "next")
OF_LINKS = {"only": _LINK_SAYS, "needs": ("tag", "parent", *_LINK_NEEDS)}
OF_TEXTS = {"only": _TEXT_SAYS, "needs": ("tag", "parent", *_TEXT_NEEDS)}
OF_BOTH = {"only": (*_LINK_SAYS, "text"), "needs": ("tag", "parent", *_LINK_NEEDS, *_TEXT_NEEDS)}
OF_LIVES = {"only": ("add", "remove"), "needs": ("tag", "parent")}


def _cut(clicks: DataFrame, cap: int) -> DataFrame:
    return clicks.withColumn("text", F.nullif(X.truncate_words(X.collapse("text"), cap), F.lit("")))


def followed(clicks: DataFrame, told: DataFrame, lives: DataFrame | None = None) -> DataFrame:
    """Clicks with tag, class and the address that the browser follows: the target's own, else that of the nearest anchor above it that has one; null without a living element.

    clicks: with epoch, at and target_id. ``lives`` isn't needed: what was told has all of it, and is played where it meets the clicks.
    """
    return _asked(clicks.drop("tag", "class", "href"), told, _LINK_SAYS, _LINK_NEEDS, _links, "tag string, class string, href string")


def with_text(clicks: DataFrame, told: DataFrame, lives: DataFrame | None = None, cap: int = TEXT_CAP) -> DataFrame:
    """Clicks with ``text``, what their living elements show then: the texts below them in page order, white space collapsed, cut at whole words; null if nothing. ``lives`` isn't needed.

    Nodes are numbered in document order, so what is below a node is a range of numbers.
    """
    return _cut(_asked(clicks.drop("text"), told, _TEXT_SAYS, _TEXT_NEEDS, _texts(cap), "text string"), cap)


def seen(clicks: DataFrame, told: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """``followed`` and ``with_text`` at once."""
    texts = _texts(cap)
    out = _asked(clicks.drop("tag", "class", "href", "text"), told, (*_LINK_SAYS, "text"), (*_LINK_NEEDS, *_TEXT_NEEDS), lambda p, at: {**_links(p, at), **texts(p, at)}, "tag string, class string, href string, text string")
    return _cut(out, cap)


# ------------------------------------------------------------------ references
#: What is said of a name that leads nowhere (fixed values), in the order in which a mutation's parts are asked.
FAULTS = {"remove": "remove of unknown node", "text": "text change on unknown node", "attributes": "attribute change on unknown node", "add": "add never resolved of node", "refer": "event references unknown node"}


def unresolved(told: DataFrame, lives: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, epoch, at, timestamp, node_id, said, more): what events name that doesn't live then. ``lives`` isn't needed.

    A removal names a node that must have lived before; a change of text or attributes, and an act, one that lives then; an add its parent.
    """
    out = [*PAGE, "at", "timestamp", *more, "node_id", "said"]

    def f(rows: pa.Table) -> pa.Table:
        p = _Played(rows)
        add, remove = p.is_said["add"], p.is_said["remove"]
        asked = p.is_said["text"] | p.is_said["attributes"] | p.is_said["refer"] | remove | (add & rows["parent"].is_valid().to_numpy())
        node = np.where(add, p.parent, p.node)
        there = np.where(remove, p.alive(node, p.at, before=True), p.alive(node, p.at)) >= 0
        return rows.select(out).take(pa.array(np.flatnonzero(asked & ~there), pa.int64()))

    return _by_page(_of_kinds(told, tuple(FAULTS)).select(*out, "place", "tag", "parent"), f, _schema(told, out, types=_TYPES))


def refusals(events: DataFrame, runs: DataFrame, raw: str = "raw") -> DataFrame:
    """(visitor_id, recorder_slice, refused_at, reason): slices that can't go on where others ended, as they name what isn't on the page by then, with the first such name.

    events: all of the slices in question, with type. runs: (visitor_id, recorder_slice, into): what would go on, and the slice it would become part of. Each is asked of the
    page that this slice and all of the run before it leave; snapshots of its own don't count.
    """
    of_run = runs.select("visitor_id", "recorder_slice", "into")
    heads = runs.select("visitor_id", F.col("into").alias("recorder_slice"), "into").distinct()
    own = F.col("recorder_slice")
    joined = events.join(of_run.unionByName(heads), list(KEYS)).withColumn("own", own).withColumn("tail", own != F.col("into")).withColumn("recorder_slice", F.col("into"))
    joined = joined.withColumn("type", F.when(F.col("tail") & (F.col("type") == SNAPSHOT), -1).otherwise(F.col("type"))).drop("into")
    bad = unresolved(packed(with_epochs(joined), raw, ("own", "tail"), tuple(FAULTS), ("tag", "parent")), more=("own", "tail")).where("tail")
    order = F.create_map(*(F.lit(x) for k, said in enumerate(FAULTS) for x in (said, k)))
    reason = F.create_map(*(F.lit(x) for pair in FAULTS.items() for x in pair))
    first = bad.groupBy("visitor_id", F.col("own").alias("recorder_slice")).agg(F.min_by(F.struct("timestamp", "said", "node_id"), F.struct("at", order[F.col("said")], "node_id")).alias("f"))
    return first.select("visitor_id", "recorder_slice", F.col("f.timestamp").alias("refused_at"), F.concat_ws(" ", F.concat(F.lit("at "), F.col("f.timestamp").cast("string"), F.lit(":")), reason[F.col("f.said")], F.col("f.node_id").cast("string")).alias("reason"))
