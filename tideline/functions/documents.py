"""HTML and XML texts as arrays of nodes, and selection on them.

Parsing runs once per text as an Arrow UDF over Python's parsers. A node tells its place in
document order, its parent's place, and where its descendants end, so that all selection
is filters on the array, inside the JVM: descendants of a node are the places after it up
to its end, children those whose parent it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: HTML elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_FIELDS = [("kind", T.StringType(), pa.string()), ("tag", T.StringType(), pa.string()), ("attrs", T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string())), ("text", T.StringType(), pa.string()), ("index", T.IntegerType(), pa.int32()), ("parent", T.IntegerType(), pa.int32()), ("end", T.IntegerType(), pa.int32())]
NODES = T.ArrayType(T.StructType([T.StructField(n, t) for n, t, _ in _FIELDS]))
_ARROW = pa.list_(pa.struct([(n, t) for n, _, t in _FIELDS]))


class _Tree:
    """Collects nodes in document order."""

    def __init__(self):
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def add(self, kind: str, tag: str | None, attrs, text: str | None) -> int:
        i = len(self.nodes)
        self.nodes.append({"kind": kind, "tag": tag, "attrs": list(dict(attrs).items()), "text": text, "index": i, "parent": self.open[-1] if self.open else -1, "end": i + 1})
        return i

    def close(self, tag: str) -> None:
        """Close the nearest open element of that name and all inside it; stray end tags are ignored."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                self.finish(k)
                return

    def finish(self, k: int = 0) -> None:
        for i in self.open[k:]:
            self.nodes[i]["end"] = len(self.nodes)
        del self.open[k:]


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def handle_starttag(self, tag, attrs):
        i = self.tree.add("element", tag, ((k, v or "") for k, v in attrs), None)
        if tag not in VOID:
            self.tree.open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.tree.add("element", tag, ((k, v or "") for k, v in attrs), None)

    def handle_endtag(self, tag):
        self.tree.close(tag)

    def handle_data(self, data):
        self.tree.add("text", None, (), data)

    def handle_comment(self, data):
        self.tree.add("comment", None, (), data)


def html_nodes(text: str) -> list[dict]:
    p = _Html()
    p.feed(text)
    p.close()
    p.tree.finish()
    return p.tree.nodes


def xml_nodes(text: str) -> list[dict] | None:
    """None for malformed XML."""
    tree, p = _Tree(), expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = lambda tag, attrs: tree.open.append(tree.add("element", tag, attrs, None))
    p.EndElementHandler = tree.close
    p.CharacterDataHandler = lambda data: tree.add("text", None, (), data)
    p.CommentHandler = lambda data: tree.add("comment", None, (), data)
    p.ProcessingInstructionHandler = lambda target, data: tree.add("instruction", target, (), data)
    try:
        p.Parse(text, True)
    except expat.ExpatError:
        return None
    tree.finish()
    return tree.nodes


def _parser(f: Callable):
    @F.arrow_udf(NODES)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else f(t) for t in batch.to_pylist()], _ARROW)

    return run


parse_html, parse_xml = _parser(html_nodes), _parser(xml_nodes)


# -- conditions on a node -----------------------------------------------------------------


def tag(name: str) -> Callable:
    return lambda n: F.coalesce(n["tag"] == name, F.lit(False)) & (n["kind"] == "element")


def has_attribute(name: str) -> Callable:
    return lambda n: F.map_contains_key(n["attrs"], name)


def attribute(name: str, value: str, how: str = "exact") -> Callable:
    """how: exact, starts, ends, contains, word (in a blank-separated list) or prefix (up to a hyphen)."""

    def test(n):
        v = F.try_element_at(n["attrs"], F.lit(name))
        ok = {
            "exact": lambda: v == value,
            "starts": lambda: v.startswith(value),
            "ends": lambda: v.endswith(value),
            "contains": lambda: v.contains(value),
            "word": lambda: F.array_contains(F.split(v, r"\s+"), value),
            "prefix": lambda: (v == value) | v.startswith(value + "-"),
        }[how]()
        return F.coalesce(ok, F.lit(False))

    return test


def css_class(name: str) -> Callable:
    return attribute("class", name, "word")


def css_id(name: str) -> Callable:
    return attribute("id", name)


def both(*tests: Callable) -> Callable:
    def test(n):
        out = tests[0](n)
        for t in tests[1:]:
            out = out & t(n)
        return out

    return test


def either(*tests: Callable) -> Callable:
    def test(n):
        out = tests[0](n)
        for t in tests[1:]:
            out = out | t(n)
        return out

    return test


# -- selections ----------------------------------------------------------------------------


def select(nodes: Column, test: Callable) -> Column:
    """Nodes that satisfy the test, in document order."""
    return F.filter(nodes, test)


def elements(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["kind"] == "element")


def comments(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["kind"] == "comment")


def children(nodes: Column, of: Column) -> Column:
    """The child nodes of a selection."""
    return F.filter(nodes, lambda n: F.exists(of, lambda p: n["parent"] == p["index"]))


def descendants(nodes: Column, of: Column) -> Column:
    return F.filter(nodes, lambda n: F.exists(of, lambda p: (n["index"] > p["index"]) & (n["index"] < p["end"])))


def next_siblings(nodes: Column, of: Column) -> Column:
    """The element right after each node of a selection."""
    es = elements(nodes)
    first = lambda p: F.array_min(F.transform(F.filter(es, lambda n: (n["parent"] == p["parent"]) & (n["index"] > p["index"])), lambda n: n["index"]))
    return F.filter(es, lambda n: F.exists(of, lambda p: F.coalesce(first(p) == n["index"], F.lit(False))))


def later_siblings(nodes: Column, of: Column) -> Column:
    return F.filter(elements(nodes), lambda n: F.exists(of, lambda p: (n["parent"] == p["parent"]) & (n["index"] > p["index"])))


def texts(nodes: Column, of: Column) -> Column:
    """The text inside each node of a selection."""
    inside = lambda p: F.filter(nodes, lambda n: (n["kind"] == "text") & (n["index"] >= p["index"]) & (n["index"] < p["end"]))
    return F.transform(of, lambda p: F.array_join(F.transform(inside(p), lambda n: n["text"]), ""))


def attributes(of: Column, name: str) -> Column:
    """The values of an attribute, of the nodes that have it."""
    return F.filter(F.transform(of, lambda n: F.try_element_at(n["attrs"], F.lit(name))), lambda v: v.isNotNull())
