"""Stored HTML pages -> flat ``dom_nodes`` table (one row per element or text run).

This is the one step that needs per-row Python: an HTML tokenizer.  It runs as
``mapInArrow`` over the ``pages`` table, so every task parses its own pages
and nothing passes through the driver.  Everything after it (subtree text,
links, layout, scoring, refinement) is Spark work on the node table.

Rows are numbered in document (pre-order) order; ``subtree_size`` counts the
node and all its descendants, so the descendants of node ``r`` are the ids
``r.node_id .. r.node_id + r.subtree_size - 1`` of the same page.  Text runs
are rows with tag ``#text`` so their order among elements is kept.

Tree building follows the HTML parsing rules that matter for real pages:
void elements, ``<p>`` closed by a following block start, ``<li>`` closed by
the next ``<li>``, headings closed by the next heading, unknown end tags
ignored, and formatting elements (``<b>``, ``<i>`` ...) left open by an
implied close re-opened before the next text, as browsers do.  ``script``,
``style`` and the document head produce no rows (they have no layout box).
The tree starts at ``<body>``, which has depth 1.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element classes used by the tree builder.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_BOX_TAGS = frozenset("script style noscript template head title".split())
CLOSES_P = frozenset(("address article aside blockquote details dialog div dl fieldset figcaption figure footer "
                      "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul").split())
FORMATTING_TAGS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

NODE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("child_idx", T.IntegerType()),
    T.StructField("subtree_size", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("class", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
    T.StructField("href", T.StringType()),
])

_WS = re.compile(r"\s+")


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []      # [parent, depth, child_idx, tag, attrs, text, n_children_el]
        self.stack: list[int] = []       # open element node indexes
        self.active: list[tuple] = []    # formatting elements to re-open (tag, attrs)
        self.in_body = False
        self.skip = 0                    # depth inside box-less elements
        self.pending: list[str] = []     # text chunks of the current run

    # -- helpers -------------------------------------------------------------------------
    def _flush(self):
        if not self.pending:
            return
        txt = _WS.sub(" ", "".join(self.pending)).strip()
        self.pending = []
        if txt and self.stack:
            self._reopen_formatting()
            parent = self.stack[-1]
            self.nodes.append([parent, self.nodes[parent][1] + 1, -1, "#text", None, txt, 0])

    def _open(self, tag, attrs):
        parent = self.stack[-1] if self.stack else -1
        depth = self.nodes[parent][1] + 1 if parent >= 0 else 1
        cidx = -1
        if parent >= 0:
            cidx = self.nodes[parent][6]
            self.nodes[parent][6] += 1
        self.nodes.append([parent, depth, cidx, tag, attrs, None, 0])
        idx = len(self.nodes) - 1
        if tag not in VOID_TAGS:
            self.stack.append(idx)
        return idx

    def _pop_until(self, tag):
        """Pop through the nearest open ``tag``; formatting elements popped on the way stay active."""
        for pos in range(len(self.stack) - 1, 0, -1):
            if self.nodes[self.stack[pos]][3] == tag:
                for j in range(len(self.stack) - 1, pos, -1):
                    n = self.nodes[self.stack[j]]
                    if n[3] in FORMATTING_TAGS:
                        self.active.append((n[3], n[4]))
                del self.stack[pos:]
                return True
        return False

    def _open_in_scope(self, tag, stop=()):
        for pos in range(len(self.stack) - 1, 0, -1):
            t = self.nodes[self.stack[pos]][3]
            if t == tag:
                return True
            if t in stop:
                return False
        return False

    def _reopen_formatting(self):
        if not self.active:
            return
        todo, self.active = self.active, []
        for tag, attrs in todo:
            self._open(tag, attrs)

    # -- parser events -------------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        tag = tag.lower()
        if tag == "body":
            if not self.in_body:
                self.in_body = True
                self._open("body", attrs)
            return
        if not self.in_body:
            if tag in ("html", "head") or tag in NO_BOX_TAGS or tag in VOID_TAGS:
                if tag in NO_BOX_TAGS and tag != "head":
                    self.skip += 1
                return
            self.in_body = True           # content before <body>: implied body
            self._open("body", [])
        if self.skip:
            if tag in NO_BOX_TAGS:
                self.skip += 1
            return
        if tag in NO_BOX_TAGS:
            self._flush()
            self.skip += 1
            return
        self._flush()
        if tag in CLOSES_P and self._open_in_scope("p", stop=("button", "table", "td", "th")):
            self._pop_until("p")
        if tag == "li" and self._open_in_scope("li", stop=("ul", "ol")):
            self._pop_until("li")
        if tag in ("dd", "dt"):
            for t in ("dd", "dt"):
                if self._open_in_scope(t, stop=("dl",)):
                    self._pop_until(t)
        if tag in HEADINGS and self.stack and self.nodes[self.stack[-1]][3] in HEADINGS:
            self.stack.pop()
        if tag == "a" and self._open_in_scope("a"):
            self._pop_until("a")
            self.active = [x for x in self.active if x[0] != "a"]
        if tag not in CLOSES_P and tag not in ("li", "dd", "dt"):
            self._reopen_formatting()
        self._open(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        t = tag.lower()
        if t not in VOID_TAGS and self.in_body and not self.skip and self.stack and \
                self.nodes[self.stack[-1]][3] == t:
            self.stack.pop()

    def handle_endtag(self, tag):
        tag = tag.lower()
        if tag in NO_BOX_TAGS:
            if self.skip:
                self.skip -= 1
            return
        if self.skip or not self.in_body or tag in ("body", "html"):
            return
        self._flush()
        if tag == "br":
            return
        if tag in FORMATTING_TAGS:
            for k in range(len(self.active) - 1, -1, -1):
                if self.active[k][0] == tag:
                    del self.active[k]
                    break
        if tag == "p" and not self._open_in_scope("p", stop=("button", "table", "td", "th")):
            self._open("p", [])           # a stray </p> makes an empty paragraph
            self.stack.pop()
            return
        self._pop_until(tag)

    def handle_data(self, data):
        if self.skip or not self.in_body:
            return
        self.pending.append(data)

    def close(self):
        super().close()
        self._flush()


def parse_html(html: str | None) -> list[list]:
    """Pre-ordered node rows for one page: [parent, depth, child_idx, tag, attrs, text, n_children]."""
    b = _TreeBuilder()
    try:
        b.feed(html or "")
        b.close()
    except Exception:  # noqa: BLE001  (a broken page yields what was parsed so far)
        b._flush()
    return b.nodes


def _subtree_sizes(nodes: list[list]) -> list[int]:
    size = [1] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i][0]
        if p >= 0:
            size[p] += size[i]
    return size


def _rows_for_page(page_id, html):
    nodes = parse_html(html)
    sizes = _subtree_sizes(nodes)
    for i, (parent, depth, cidx, tag, attrs, text, _) in enumerate(nodes):
        if tag == "#text":
            yield (page_id, i, parent, depth, None, 1, tag, None, None, None, text, None)
            continue
        amap = {}
        for k, v in attrs or []:
            if k not in amap:
                amap[k] = "" if v is None else v
        yield (page_id, i, None if parent < 0 else parent, depth, None if cidx < 0 else cidx, sizes[i],
               tag, amap.get("id", ""), amap.get("class", ""), amap, None,
               amap.get("href") if tag == "a" else None)


_ARROW = pa.schema([("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()),
                    ("child_idx", pa.int32()), ("subtree_size", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
                    ("class", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
                    ("href", pa.string())])
_ATTRIBUTES = _ARROW.get_field_index("attributes")

#: A worker holds the Python objects of about so many bytes of HTML, and of so many rows, at a time.
HTML_BYTES = 1 << 20
ROWS = 5_000


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    columns[_ATTRIBUTES] = [None if m is None else list(m.items()) for m in columns[_ATTRIBUTES]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _html_to_nodes(batches, html_bytes: int = HTML_BYTES, rows: int = ROWS):
    """Node rows of Arrow batches ``(page_id, html)``, handed on as soon as they come from ``html_bytes`` of HTML or are
    ``rows`` many: the pages of a batch become Python strings one by one, whatever Spark puts into a batch."""
    for batch in batches:
        out, held = [], 0
        for pid, html in zip(batch.column("page_id"), batch.column("html")):
            html = html.as_py()
            held += len(html or "")
            for row in _rows_for_page(pid.as_py(), html):
                out.append(row)
                if len(out) >= rows:
                    yield _record_batch(out)
                    out = []
            if out and held >= html_bytes:
                yield _record_batch(out)
                out, held = [], 0
        if out:
            yield _record_batch(out)


def html_to_nodes(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``pages(page_id, html)`` -> ``dom_nodes`` (see module doc)."""
    from ..session import ship_package
    ship_package(pages.sparkSession)
    src = pages.select(pages[page_id].cast("long").alias("page_id"), pages[html].alias("html"))
    return src.mapInArrow(_html_to_nodes, NODE_SCHEMA)
