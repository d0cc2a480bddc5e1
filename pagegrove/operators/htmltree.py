"""Stdlib HTML tokenizer -> pre-order node list (the body of D1).

Self-contained on purpose (stdlib + pyarrow only): it is shipped to Python
workers by value, so executors need no installed copy of this package.
"""

from collections.abc import Iterator
from html.entities import html5 as _HTML5_ENTITIES
from html.parser import HTMLParser

import pyarrow as pa

# --- Fixed values -----------------------------------------------------------
# Elements that never hold children (HTML void elements plus legacy ones).
VOID_ELEMENTS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
])
# Elements that are removed, with all inside them, before a page's main text is read.
BOILERPLATE_TAGS = ("script", "style", "head", "header", "footer", "nav", "aside")
# Elements whose strings are not ordinary text.
RAWTEXT_CONTAINERS = frozenset(["script", "style", "template", "rt", "rp"])
# Elements inside which whitespace-only strings are kept verbatim.
PRESERVE_WS = frozenset(["pre", "textarea"])
# ASCII whitespace used by the whitespace-only test.
_ASCII_WS = " \n\t\x0c\r"
# Nodes (or as many times 64 characters of HTML) of the parsed pages that a task holds at a time.
CHUNK_NODES = 8192
# One page's nodes in Arrow, as pagegrove.schemas.DOM states them.
NODES = pa.list_(pa.struct([
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("end_id", pa.int32()), ("depth", pa.int32()),
    ("boiler", pa.bool_()), ("li_id", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
]))
# ---------------------------------------------------------------------------


def _charref(name: str) -> str:
    try:
        code = int(name[1:], 16) if name[:1] in ("x", "X") else int(name)
    except ValueError:
        return "�"
    if code < 256:
        try:  # references below 256 are read as windows-1252 first
            ch = bytes([code]).decode("windows-1252")
            if ch:
                return ch
        except UnicodeDecodeError:
            pass
    if 0xD800 <= code <= 0xDFFF:  # half of a pair: no character, and no valid UTF-8
        return "�"
    try:
        return chr(code) or "�"
    except (ValueError, OverflowError):
        return "�"


class _TreeBuilder(HTMLParser):
    """Collects the pre-order node list of one document."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes: list[dict] = []
        self.parents: list[int] = []
        self.open: list[int] = []          # stack of open element ids
        self.names: list[str] = []         # their tag names
        self.buf: list[str] = []
        self._new("#document", None, None)
        self.open.append(0)
        self.names.append("#document")

    def _new(self, tag, attrs, text):
        nid = len(self.nodes)
        parent = self.open[-1] if self.open else None
        self.nodes.append({"node_id": nid, "parent_id": parent, "tag": tag,
                           "attrs": attrs or {}, "text": text})
        self.parents.append(-1 if parent is None else parent)
        return nid

    def _flush(self):
        if not self.buf:
            return
        data = "".join(self.buf)
        self.buf = []
        if not data.strip(_ASCII_WS) and not PRESERVE_WS.intersection(self.names):
            data = "\n" if "\n" in data else " "
        kind = "#rawtext" if RAWTEXT_CONTAINERS.intersection(self.names) else "#text"
        self._new(kind, None, data)

    def handle_starttag(self, tag, attrs):
        self._flush()
        amap = {}
        for k, v in attrs:
            amap[k] = "" if v is None else v
        nid = self._new(tag, amap, None)
        if tag not in VOID_ELEMENTS:
            self.open.append(nid)
            self.names.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._flush()
        amap = {k: ("" if v is None else v) for k, v in attrs}
        self._new(tag, amap, None)

    def handle_endtag(self, tag):
        self._flush()
        for i in range(len(self.names) - 1, 0, -1):
            if self.names[i] == tag:
                del self.open[i:]
                del self.names[i:]
                break

    def handle_data(self, data):
        self.buf.append(data)

    def handle_entityref(self, name):
        ch = _HTML5_ENTITIES.get(name + ";") or _HTML5_ENTITIES.get(name)
        self.buf.append(ch if ch is not None else "&" + name)

    def handle_charref(self, name):
        self.buf.append(_charref(name))

    def handle_comment(self, data):
        self._flush()
        self._new("#comment", None, data)

    def handle_decl(self, decl):
        self._flush()
        self._new("#doctype", None, decl[8:] if decl[:7].upper() == "DOCTYPE" else decl)

    def handle_pi(self, data):
        self._flush()
        self._new("#pi", None, data)

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._new("#text", None, data[6:])
        else:
            self._new("#doctype", None, data)

    def finish(self) -> list[dict]:
        self.close()
        self._flush()
        nodes, parents = self.nodes, self.parents
        n = len(nodes)
        end = list(range(n))
        depth = [0] * n
        for i in range(n - 1, 0, -1):
            p = parents[i]
            if end[i] > end[p]:
                end[p] = end[i]
        boiler = [False] * n
        item: list[int | None] = [None] * n
        for i in range(1, n):
            p, tag = parents[i], nodes[i]["tag"]
            depth[i] = depth[p] + 1
            boiler[i] = boiler[p] or tag in BOILERPLATE_TAGS
            item[i] = i if tag == "li" else item[p]
        for i, node in enumerate(nodes):
            node["end_id"] = end[i]
            node["depth"] = depth[i]
            node["boiler"] = boiler[i]
            node["li_id"] = item[i]
        return nodes


def parse_html(html: str | None) -> list[dict] | None:
    """Node list of one document (also used by tests as a plain function)."""
    if html is None:
        return None
    tb = _TreeBuilder()
    try:
        tb.feed(html)
        return tb.finish()
    except Exception:  # tokenizer failure: an empty document, not a lost row
        return [{"node_id": 0, "parent_id": None, "end_id": 0, "depth": 0,
                 "boiler": False, "li_id": None, "tag": "#document", "attrs": {}, "text": None}]


def dom_chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Arrow arrays of HTML -> arrays of node lists, one list per page in order.

    The arrays given back are cut by their nodes, not by the batches that
    come in: thousands of parsed pages at once would not fit a worker.
    """
    for html in batches:
        held, weight = [], 0
        for page in html:
            text = page.as_py()
            nodes = parse_html(text)
            weight += len(nodes or ()) + len(text or "") // 64
            for node in nodes or ():
                node["attrs"] = list(node["attrs"].items())
            held.append(nodes)
            if weight >= CHUNK_NODES:
                yield pa.array(held, NODES)
                held, weight = [], 0
        if held:
            yield pa.array(held, NODES)
