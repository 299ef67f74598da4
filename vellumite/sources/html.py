"""HTML pages as a table of nodes.

The parser is a kernel: it runs document by document inside mapInArrow, on the standard library's tokenizer,
with its own tree construction after the HTML standard (void elements, implied ends and table parts, formatting
elements that are opened again in the next block or split around blocks, and content of a table that belongs
before it). Everything after it is relational.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element sets of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCOPE = set("html body table td th caption button object applet marquee template".split())
BLOCKS = CLOSES_P | set("html body caption thead tbody tfoot tr td th".split())
IGNORED = set("head script style template noscript svg canvas select textarea button title".split())

NODE_SCHEMA = "doc_id long, node_id int, parent_id int, ord int, depth int, exit int, tag string, attrs map<string,string>, text string, path array<int>"


# Elements that end the reach of a formatting element (besides blocks), and what stands in tables without being moved out.
SPECIAL = CLOSES_P | SCOPE | set("area base br button col colgroup embed frame head iframe img input link listing meta noscript param plaintext script select source style tbody textarea tfoot thead title tr track wbr xmp".split())
TABLE_PARTS = {"table", "tbody", "thead", "tfoot", "tr"}
IN_TABLE = set("caption colgroup col tbody thead tfoot tr td th script style template".split())


class _Element:
    """A node under construction."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str, attrs: dict, text: str | None = None):
        self.tag, self.attrs, self.text = tag, attrs, text
        self.children: list[_Element] = []
        self.parent: _Element | None = None

    def put(self, node: _Element, before: _Element | None = None) -> None:
        if node.parent is not None:
            node.parent.children.remove(node)
        node.parent = self
        if before is None:
            self.children.append(node)
        else:
            self.children.insert(next(i for i, c in enumerate(self.children) if c is before), node)


class _Tree(HTMLParser):
    """Tree construction: implied starts and ends, formatting that goes on over blocks, and content that does not belong into a table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("#document", {})
        self.stack: list[_Element] = []
        self.active: list[_Element | None] = []  # formatting elements; None where a cell or caption begins
        self.fresh_pre = False  # a line feed right after <pre> is none of its text

    # The stack of open elements.

    def _top(self) -> _Element:
        return self.stack[-1] if self.stack else self.root

    def _place(self, foster: bool, at: _Element | None = None) -> tuple[_Element, _Element | None]:
        """Where a node goes: (parent, the node that it stands before). Foster content of a table goes before the table."""
        at = at or self._top()
        if foster and at.tag in TABLE_PARTS:
            table = next((e for e in reversed(self.stack) if e.tag == "table"), None)
            if table is not None:
                return (table.parent or self.root), table
        return at, None

    def _insert(self, node: _Element, foster: bool = True) -> _Element:
        parent, before = self._place(foster)
        parent.put(node, before)
        return node

    def _open(self, tag: str, attrs: dict) -> _Element:
        self.stack.append(self._insert(_Element(tag, attrs), tag not in IN_TABLE))
        return self.stack[-1]

    def _pop(self) -> None:
        if self.stack.pop().tag in ("td", "th", "caption"):
            while self.active and self.active.pop() is not None:
                pass

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Pops up to the nearest open element of `tags`, unless one of `stop` is nearer."""
        for depth in range(len(self.stack) - 1, -1, -1):
            name = self.stack[depth].tag
            if name in tags:
                while len(self.stack) > depth:
                    self._pop()
                return
            if name in stop:
                return

    def _back_to(self, context: set[str]) -> None:
        """Closes what stands between a part of a table and where it belongs; outside of tables nothing but its like."""
        if self._holds("table"):
            while self._top().tag not in context:
                self._pop()
        else:
            self._close({"td", "th"} if "tr" in context else {"tr", "td", "th"}, SCOPE - {"td", "th"})

    def _holds(self, tag: str) -> bool:
        return any(e.tag == tag for e in self.stack)

    # Formatting elements.

    def _reopen(self) -> None:
        """Opens formatting elements again that a block's end has closed."""
        at = len(self.active)
        while at and self.active[at - 1] is not None and not any(e is self.active[at - 1] for e in self.stack):
            at -= 1
        for k in range(at, len(self.active)):
            old = self.active[k]
            self.active[k] = self._open(old.tag, dict(old.attrs))

    def _remember(self, node: _Element) -> None:
        """At most three equal ones at a time."""
        same = []
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None:
                break
            if (self.active[k].tag, self.active[k].attrs) == (node.tag, node.attrs):
                same.append(k)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append(node)

    @staticmethod
    def _index(where: list, node: _Element) -> int:
        return next((i for i, x in enumerate(where) if x is node), -1)

    def _end_formatting(self, tag: str) -> None:
        """A formatting end tag: where blocks are open inside, they keep what came before it formatted, and go on without it."""
        for _ in range(8):
            begin = next((i + 1 for i in range(len(self.active) - 1, -1, -1) if self.active[i] is None), 0)
            own = next((e for e in reversed(self.active[begin:]) if e.tag == tag), None)
            if own is None:
                return self._close({tag}, SCOPE)
            at = self._index(self.stack, own)
            if at < 0:
                del self.active[self._index(self.active, own)]
                return None
            if any(e.tag in SCOPE for e in self.stack[at + 1 :]):
                return None
            block = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].tag in SPECIAL), None)
            if block is None:
                while len(self.stack) > at:
                    self._pop()
                del self.active[self._index(self.active, own)]
                return None
            furthest, common = self.stack[block], self.stack[at - 1] if at else self.root
            mark, last, k, steps = self._index(self.active, own), furthest, block, 0
            while True:
                k -= 1
                node = self.stack[k]
                if node is own:
                    break
                steps += 1
                held = self._index(self.active, node)
                if steps > 3 and held >= 0:
                    del self.active[held]
                    mark -= held < mark
                    held = -1
                if held < 0:
                    del self.stack[k]
                    continue
                copy = _Element(node.tag, dict(node.attrs))
                self.active[held], self.stack[k] = copy, copy
                if last is furthest:
                    mark = held + 1
                copy.put(last)
                last = copy
            parent, before = self._place(True, common)
            parent.put(last, before)
            copy = _Element(own.tag, dict(own.attrs))
            for child in list(furthest.children):
                copy.put(child)
            furthest.put(copy)
            held = self._index(self.active, own)
            del self.active[held]
            self.active.insert(mark - (held < mark), copy)
            del self.stack[self._index(self.stack, own)]
            self.stack.insert(self._index(self.stack, furthest) + 1, copy)
        return None

    # Tokens.

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.fresh_pre = tag in ("pre", "listing", "textarea")
        if tag in ("html", "body", "head") and self._holds(tag):
            return
        if tag == "body":
            self._close({"head"}, set())
        if tag in CLOSES_P:
            self._close({"p"}, SCOPE)
        if tag in HEADINGS and self._top().tag in HEADINGS:
            self._pop()
        if tag == "li":
            self._close({"li"}, {"ul", "ol", "menu", *SCOPE})
        elif tag in ("dt", "dd"):
            self._close({"dt", "dd"}, {"dl", *SCOPE})
        elif tag in ("option", "optgroup"):
            self._close({"option"}, {"select", *SCOPE})
        elif tag == "button":
            self._close({"button"}, SCOPE - {"button"})
        elif tag in ("tbody", "thead", "tfoot", "colgroup", "caption"):
            self._back_to({"table"})
        elif tag == "tr":
            self._back_to({"tbody", "thead", "tfoot", "table"})
            if self._top().tag == "table":
                self._open("tbody", {})
        elif tag in ("td", "th"):
            self._back_to({"tr", "tbody", "thead", "tfoot", "table"})
            if self._top().tag in ("tbody", "thead", "tfoot", "table"):
                self.handle_starttag("tr", [])
        if tag in ("a", "nobr") and any(e is not None and e.tag == tag for e in self.active):
            self._end_formatting(tag)
        if tag not in BLOCKS and tag not in IGNORED and tag not in ("link", "meta", "base", "colgroup", "col"):
            self._reopen()
        if tag in VOID:
            self._insert(_Element(tag, own), tag not in IN_TABLE)
            return
        node = self._open(tag, own)
        if tag in FORMATTING:
            self._remember(node)
        elif tag in ("td", "th", "caption"):
            self.active.append(None)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.fresh_pre = False
        if tag in FORMATTING:
            self._end_formatting(tag)
        elif tag == "p" and not self._holds("p"):
            self.handle_starttag("p", [])
            self._pop()
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag in HEADINGS:
            self._close(HEADINGS, SCOPE)
        elif tag in ("body", "html"):
            return
        elif tag not in VOID:
            stop = {"html"} if tag == "table" else {"table"} if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup") else SCOPE - {tag}
            self._close({tag}, stop)

    def handle_data(self, data: str) -> None:
        if self.fresh_pre:
            self.fresh_pre = False
            data = data.removeprefix("\r").removeprefix("\n")
        if not data:
            return
        shown = bool(data.strip(" \t\n\r\f"))
        if shown and self._top().tag not in IGNORED:
            self._reopen()
        parent, before = self._place(shown)
        at = self._index(parent.children, before) - 1 if before is not None else len(parent.children) - 1
        if at >= 0 and parent.children[at].tag == "#text":
            parent.children[at].text += data
        else:
            parent.put(_Element("#text", {}, data), before)

    def handle_comment(self, data: str) -> None:
        self._insert(_Element("#comment", {}, data), False)

    def finish(self) -> list[dict]:
        """Rows in document order. `node_id` and `exit` are places in one count of entries and exits."""
        self.close()
        rows: list[dict] = []
        clock = 0
        todo: list[tuple[_Element | None, dict | None, int]] = [(c, None, k) for k, c in reversed(list(enumerate(self.root.children)))]
        while todo:
            node, up, k = todo.pop()
            clock += 1
            if node is None:  # the end of `up`
                up["exit"] = clock
                continue
            row = {"node_id": clock, "parent_id": up["node_id"] if up else None, "ord": k, "depth": up["depth"] + 1 if up else 0, "tag": node.tag, "attrs": node.attrs, "text": node.text, "exit": None, "path": [*up["path"], up["node_id"]] if up else []}
            rows.append(row)
            todo.append((None, row, 0))
            todo += [(c, row, i) for i, c in reversed(list(enumerate(node.children)))]
        return rows


# What is no text, or a character reference with its semicolon, if it has one.
_REFERENCE = re.compile(r"(<(script|style)\b.*?(?:</\2\s*>|\Z)|<!--.*?(?:-->|\Z))|&(#\d+|#x[0-9a-f]+|[a-z][a-z0-9]*)(;?)", re.I | re.S)


def closed_references(html: str) -> str:
    """A page in which only references of a known name or number that end with a semicolon are left as references."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] is not None or (m[4] and (m[3][0] == "#" or f"{m[3]};" in html5)) else f"&amp;{m[0][1:]}", html)


def parse(html: str | None, bare: bool = True) -> list[dict]:
    """`bare`: `&amp` without its semicolon is a reference too, as the HTML standard has it."""
    tree = _Tree()
    tree.feed((html or "") if bare else closed_references(html or ""))
    return tree.finish()


def html_nodes(pages: DataFrame, doc_id: str = "page_id", html: str = "html", bare: bool = True) -> DataFrame:
    """One row per element, text and comment of each page (see NODE_SCHEMA, and parse for `bare`); a null page has none.

    An element is an ancestor of a node where node_id < the node's and exit > it, on the same doc_id.
    """
    names = [c.strip().split(" ")[0] for c in NODE_SCHEMA.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("ord", pa.int32()), ("depth", pa.int32()), ("exit", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("path", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            held = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1)):
                for row in parse(value.as_py(), bare):
                    held.append({n: row.get(n) for n in names} | {"doc_id": key, "attrs": list(row["attrs"].items())})
                if len(held) > 20_000:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInArrow(run, NODE_SCHEMA)


#: Elements that set a run property, and those that keep white space.
RUN_FLAGS = {"bold": ("b", "strong", "h1", "h2", "h3", "h4", "h5", "h6", "th"), "italic": ("i", "em"), "underline": ("u", "ins"), "strike": ("s", "strike", "del")}
_FLAG = {tag: k for k, tags in enumerate(RUN_FLAGS.values()) for tag in tags}
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_SPACE = re.compile(r"white-space\s*:\s*(pre-line|pre-wrap|pre|break-spaces|normal|nowrap)", re.I)
FLOW_SCHEMA = "doc_id long, paragraph int, pos int, text string, space string, bold boolean, italic boolean, underline boolean, strike boolean, href string"


def flow_of(html: str | None, bare: bool = True) -> list[tuple]:
    """Shown texts and line breaks (U+0002) of a page, as FLOW_SCHEMA has them after doc_id. One walk over the parser's rows.

    Every start and end of a block element is a boundary; a paragraph is what stands between two of them.
    """
    out: list[tuple] = []
    stack: list[tuple] = []  # (exit, block, hidden, space, flags, href) of open elements
    paragraph = 0
    for row in parse(html, bare):
        while stack and stack[-1][0] < row["node_id"]:
            paragraph += stack.pop()[1]
        _, _, hidden, space, flags, href = stack[-1] if stack else (0, 0, False, "normal", (False,) * 4, None)
        tag = row["tag"]
        if tag == "#text":
            if not hidden:
                out.append((paragraph, row["node_id"], row["text"], space, *flags, href))
            continue
        if tag == "#comment":
            continue
        if tag == "br" and not hidden:
            out.append((paragraph, row["node_id"], "\x02", space, *flags, href))
        style = row["attrs"].get("style", "")
        block = 1 if tag in BLOCKS else 0
        paragraph += block
        found = _SPACE.search(style)
        space = found[1].lower() if found else "pre" if tag in ("pre", "listing", "xmp") else space
        if tag in _FLAG:
            flags = tuple(f or k == _FLAG[tag] for k, f in enumerate(flags))
        if tag == "a" and "href" in row["attrs"]:
            href = row["attrs"]["href"]
        stack.append((row["exit"], block, hidden or tag in IGNORED or bool(_HIDDEN.search(style)), space, flags, href))
    return out


def html_flow(pages: DataFrame, doc_id: str = "page_id", html: str = "html", bare: bool = True) -> DataFrame:
    """The shown text of each page in order (FLOW_SCHEMA): every page is parsed once, and all that runs and paragraphs want comes along."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            owner: list = []
            for key, value in zip(b.column(0).to_pylist(), b.column(1)):
                found = flow_of(value.as_py(), bare)
                rows += found
                owner += [key] * len(found)
                if len(rows) > 20_000:
                    yield _flow_batch(owner, rows)
                    rows, owner = [], []
            if rows:
                yield _flow_batch(owner, rows)

    return pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(html).alias("html")).mapInArrow(run, FLOW_SCHEMA)


def _flow_batch(owner: list, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
    columns = [pa.array(owner, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "paragraph", "pos", "text", "space", *RUN_FLAGS, "href"])


def read_html_files(spark, path: str) -> DataFrame:
    """(doc_id, html, path) of a folder of HTML files, whole; ids are a hash of the path."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("html"), F.input_file_name().alias("path"))
