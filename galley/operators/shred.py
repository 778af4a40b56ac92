"""HTML text to node arrays: the one place where rows pass through Python."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galley.functions.dom import RAW_TAGS, VOID_TAGS
from galley.operators.joins import widen
from galley.schemas import NODE

# Which start tags end an open paragraph, item, cell or option, and where that stops.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center dd dir div dl dt fieldset figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
ENDS_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# An end tag does not close through an open element of higher rank.
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
            "table": 190, "head": 200, "body": 200, "html": 220}
HEAD_TAGS = frozenset(["title", "meta", "link", "base", "script", "style", "noscript", "template"])
BLOCKS = ENDS_PARAGRAPH | {"body", "html", "head", "caption"}

ROWS_PER_BATCH = 64

# Executors need not have this package installed: the shredder travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Shredder(HTMLParser):
    """Collects the nodes of one page in document order; tolerant of missing end tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.stack: list[int] = []
        self.body_seen = False

    def _add(self, kind: str, tag: str | None, attrs: list, text: str | None) -> int:
        pre = len(self.nodes)
        parent = self.stack[-1] if self.stack else -1
        self.nodes.append([pre, pre, parent, len(self.stack), kind, tag, attrs, text])
        return pre

    def _pop_to(self, depth: int) -> None:
        last = len(self.nodes) - 1
        while len(self.stack) > depth:
            self.nodes[self.stack.pop()][1] = last

    def _open_tags(self) -> list[str]:
        return [self.nodes[i][5] for i in self.stack]

    def _close_nearest(self, tags: set[str], stop: set[str] | frozenset[str]) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.nodes[self.stack[depth]][5]
            if tag in tags:
                self._pop_to(depth)
                return
            if tag in stop:
                return

    def _make_room(self, tag: str) -> None:
        """Open html, head and body where the page leaves them out."""
        if not self.stack:
            self.stack.append(self._add("elem", "html", [], None))
        if self.nodes[self.stack[-1]][5] == "head" and tag not in HEAD_TAGS:
            self._pop_to(len(self.stack) - 1)
        if len(self.stack) == 1 and tag not in ("head", "body"):
            wanted = "head" if tag in HEAD_TAGS and not self.body_seen else "body"
            self.body_seen = self.body_seen or wanted == "body"
            self.stack.append(self._add("elem", wanted, [], None))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            if self.stack or self.nodes:
                return
        else:
            self._make_room(tag)
            if tag == "body":
                if self.body_seen:
                    return
                self.body_seen = True
        if tag in ENDS_PARAGRAPH:
            self._close_nearest({"p"}, BLOCKS - {"p"})
        if tag in ENDS_SIBLING:
            self._close_nearest(*ENDS_SIBLING[tag])
        kept: dict[str, str] = {}
        for name, value in attrs:
            kept.setdefault(name, value or "")
        if "class" in kept:
            kept["class"] = " ".join(kept["class"].split())
        pre = self._add("elem", tag, list(kept.items()), None)
        if tag not in VOID_TAGS:
            self.stack.append(pre)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and self.stack and self.nodes[self.stack[-1]][5] == tag:
            self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        rank = END_RANK.get(tag, 100)
        for depth in range(len(self.stack) - 1, -1, -1):
            open_tag = self.nodes[self.stack[depth]][5]
            if open_tag == tag:
                if tag not in ("html", "body"):
                    self._pop_to(depth)
                return
            if END_RANK.get(open_tag, 100) > rank:
                return

    def handle_data(self, data: str) -> None:
        if len(self.stack) < 2 or self.nodes[self.stack[-1]][5] == "head":
            if not data.strip():
                return
            self._make_room("#text")
        last = self.nodes[-1]
        raw = self.nodes[self.stack[-1]][5] in RAW_TAGS
        if last[4] in ("text", "raw") and last[2] == self.stack[-1]:
            last[7] += data
        else:
            self._add("raw" if raw else "text", None, [], data)

    def handle_comment(self, data: str) -> None:
        self._add("comment", None, [], data)


def parse_nodes(html: str | None) -> list[list]:
    shredder = _Shredder()
    if html:
        shredder.feed(html)
        shredder.close()
        shredder._pop_to(0)
    return shredder.nodes


def _node_array(pages: list[str | None]) -> pa.Array:
    """Node lists of several pages as one Arrow list array, built column by column."""
    starts, class_starts, attr_starts = [0], [0], [0]
    columns: list[list] = [[] for _ in range(7)]
    classes: list[str] = []
    keys: list[str] = []
    values: list[str] = []
    for html in pages:
        nodes = parse_nodes(html)
        for pre, post, parent, depth, kind, tag, attrs, text in nodes:
            for column, value in zip(columns, (pre, post, parent, depth, kind, tag, text)):
                column.append(value)
            for name, value in attrs:
                keys.append(name)
                values.append(value)
                if name == "class":
                    classes.extend(value.split())
            class_starts.append(len(classes))
            attr_starts.append(len(keys))
        starts.append(len(columns[0]))
    ints, strings = pa.int32(), pa.string()
    struct = pa.StructArray.from_arrays(
        [
            *[pa.array(c, ints) for c in columns[:4]],
            pa.array(columns[4], strings),
            pa.array(columns[5], strings),
            pa.ListArray.from_arrays(pa.array(class_starts, ints), pa.array(classes, strings)),
            pa.MapArray.from_arrays(pa.array(attr_starts, ints), pa.array(keys, strings), pa.array(values, strings)),
            pa.array(columns[6], strings),
        ],
        names=["pre", "post", "parent", "depth", "kind", "tag", "classes", "attrs", "text"],
    )
    return pa.ListArray.from_arrays(pa.array(starts, ints), struct)


def shred(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``nodes``. Row-local: large inputs are not shuffled, and the markup ends here."""
    kept = [c for c in pages.columns if c != "html"]
    schema = pages.select(*kept).schema.add("nodes", T._parse_datatype_string(f"ARRAY<{NODE}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                piece = batch.slice(start, ROWS_PER_BATCH)
                nodes = _node_array(piece.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in kept] + [nodes], names=[*kept, "nodes"]
                )

    return widen(pages.select(*kept, "html")).mapInArrow(run, schema)


def node_rows(tree: DataFrame) -> DataFrame:
    """Flat node table: one row per node."""
    return tree.select(*[c for c in tree.columns if c != "nodes"], F.inline("nodes"))
