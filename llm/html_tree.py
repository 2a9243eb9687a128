"""Web pages as trees of elements and texts, and what a model is told about each node."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# fixed values: names of HTML elements
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION = frozenset("article main section nav aside header footer form ul ol table dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NOT_P = BLOCK - {"p"}
#: Elements whose text no reader of an article sees.
UNSEEN = frozenset("head script style template noscript title textarea select option datalist button iframe object svg math canvas audio video".split())
#: Elements that end an open one of the same kind, down to the first of the elements behind the bar.
ENDS_OWN = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
LABEL = "data-label"
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)]*$")


class Tree(HTMLParser):
    """A page's nodes in page order; node 0 is the page.

    tag: an element's name, ``#`` for a text, ``_`` for white space between texts. parent: its element. piece: a text as it stands. block:
    texts of one number make up one block. label: 1 or 0 under an element that has the attribute ``data-label``, as labelled pages do.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.names, self.piece, self.block, self.label = ["page"], [-1], [()], [""], [0], [0]
        self.at, self.stack, self.open, self.number, self.unseen = 0, [0], {}, 0, 0
        self.feed(html)
        self.close()

    def _node(self, tag: str, names: tuple, piece: str, label: int | None) -> int:
        self.tag.append(tag)
        self.parent.append(self.at)
        self.names.append(names)
        self.piece.append(piece)
        self.block.append(self.number)
        self.label.append(self.label[self.at] if label is None else label)
        return len(self.tag) - 1

    def _leave(self) -> None:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        self.unseen -= tag in UNSEEN
        self.number += tag in BLOCK
        self.at = self.stack[-1]

    def _end_open(self, ended, within) -> None:
        """Leave the innermost of the ended elements, unless one of within lies inside it."""
        if any(self.open.get(t) for t in ended):
            for k in range(len(self.stack) - 1, 0, -1):
                tag = self.tag[self.stack[k]]
                if tag in ended:
                    while len(self.stack) > k:
                        self._leave()
                    return
                if tag in within:
                    return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data(" ")
        if tag in BLOCK:
            self._end_open(("p",), _NOT_P)
            self.number += 1
        if tag in HEADING and self.tag[self.at] in HEADING:
            self._leave()
        if tag in ENDS_OWN:
            for _ in range(2):  # a row ends its cell and itself
                self._end_open(*ENDS_OWN[tag])
        if tag in VOID:
            return
        names, label = [], None
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                names += [w.lower() for w in _NAME.findall(value)]
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "")):
                names.append("hidden")
            elif name == LABEL:
                label = int(value == "1")
        self.at = self._node(tag, tuple(dict.fromkeys(names)), "", label)
        self.stack.append(self.at)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as HTML has it: only void elements end themselves

    def handle_endtag(self, tag):
        if tag in HEADING and not self.open.get(tag):  # a heading of any rank is ended
            self._end_open(HEADING, BLOCK - HEADING)
        elif self.open.get(tag):
            while self.tag[self.at] != tag:
                self._leave()
            self._leave()
        elif tag in BLOCK:
            self.number += 1

    def handle_data(self, data):
        if self.unseen:
            return
        if self.tag[-1] in "#_" and self.parent[-1] == self.at and self.block[-1] == self.number:
            self.piece[-1] += data
            if not data.isspace():
                self.tag[-1] = "#"
        else:
            self._node("_" if data.isspace() else "#", (), data, None)


def _size(n: int) -> int:
    """A count's order of magnitude: 0 for none, then one step for each fourfold."""
    return (n.bit_length() + 1) // 2


def _share(part: int, of: int) -> int:
    return 0 if not part else 1 + min(3, 4 * part // max(of, 1))


def features(tree: Tree) -> list[list[str]]:
    """What is known of each node: its names, and its amount of text, links and sentences against the page's. No words of any text."""
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    letters, linked, sentences, runs, paragraphs, fields, elements, before = ([0] * n for _ in range(8))
    seen = 0
    for i in range(n):
        before[i] = seen
        if tag[i] == "#":
            letters[i] = len(tree.piece[i].strip())
            sentences[i] = int(_ENDS.search(tree.piece[i].rstrip()) is not None)
            runs[i] = 1
            seen += letters[i]
    for i in range(n - 1, 0, -1):
        up, own = parent[i], tag[i]
        if own == "a":
            linked[i] = letters[i]
        elif own in ("p", "blockquote", "pre"):
            paragraphs[i] += 1
        elif own in ("form", "input", "label", "fieldset"):
            fields[i] += 1
        if own not in "#_":
            elements[up] += 1
        letters[up] += letters[i]
        linked[up] += linked[i]
        sentences[up] += sentences[i]
        runs[up] += runs[i]
        paragraphs[up] += paragraphs[i]
        fields[up] += fields[i]
    out, within = [], [()] * n
    for i in range(n):
        own = tag[i]
        if i:
            up = parent[i]
            within[i] = within[up] if tag[up] not in SECTION or tag[up] in within[up] else (*within[up], tag[up])
        place = f"at {4 * before[i] // max(seen, 1)}"
        share = f"part {_share(letters[i], seen)}"
        if own in "#_":
            up = tag[parent[i]]
            f = ["#", f"# in {up}", f"# {_size(letters[i])}", f"# ends {sentences[i]}", f"# {share}", f"# {place}"]
            if "©" in tree.piece[i]:
                f.append("# ©")
        else:
            links = _share(linked[i], letters[i])
            f = ["<", f"<{own}", f"< {_size(letters[i])}", f"< links {links}", f"<{own} links {links}", f"< {share}", f"< {place}", f"< ends {_share(sentences[i], runs[i])}"]
            f += [f"< paragraphs {_size(paragraphs[i])}", f"< fields {_size(fields[i])}", f"< elements {_size(elements[i])}", f"< run {_size(letters[i] // max(runs[i], 1))}"]
            for name in tree.names[i]:
                f += [f"< .{name}", f"< .{name[:4]}*"]
        f += [f"{f[0]} within {x}" for x in within[i]]
        out.append(f)
    return out


def kind(tag: str) -> int:
    """The kind of a tree's edge, by its child: a text, an inline element, a part of a list or table, another block."""
    return 0 if tag in "#_" else 3 if tag not in BLOCK else 2 if tag in ("li", "ul", "ol", "td", "tr", "th", "dl", "dt", "dd", "tbody", "table") else 1


def joined(tree: Tree, kept) -> str:
    """The kept texts: blocks in page order, white space in each made one space."""
    out, block, pieces = [], None, []
    for i, tag in enumerate(tree.tag):
        if tag == "_" or (tag == "#" and kept[i]):
            if tree.block[i] != block:
                out.append(" ".join("".join(pieces).split()))
                block, pieces = tree.block[i], []
            pieces.append(tree.piece[i])
    out.append(" ".join("".join(pieces).split()))
    return "\n\n".join(b for b in out if b)
