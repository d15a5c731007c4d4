"""One row per element of each page.

``html.parser`` is the one step that needs Python: it turns tag soup into positions, parents and what a
node inherits from its ancestors. It runs on Arrow batches inside Spark tasks, one page at a time, and
everything after it is column expressions.
"""

from __future__ import annotations

import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import any_of
from ..functions.selectors import attr, has_attr
from ..functions.text import squeeze
from ..rules.elements import INTERACTIVE_ROLES, INTERACTIVE_TAGS, MAX_TEXT, SKIP_TAGS

# The parser travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUTSIDE_BODY = frozenset("html head body title base".split())
_SKIP = frozenset(SKIP_TAGS)
# Elements whose end tag may be left out: a new element on the right closes an open one on the left.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
}
SCOPES = frozenset("table ul ol dl select form div section article body".split())
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)|opacity\s*:\s*0(\.0+)?\s*(;|$)", re.I)
_HIDING_ANCESTORS, _GROUP_ANCESTORS = 10, 5
_CLOSES: dict[str, set] = {}
for _name, _tags in CLOSED_BY.items():
    for _tag in _tags:
        _CLOSES.setdefault(_tag, set()).add(_name)
# Elements nested deeper become siblings at this depth, as in browsers; so paths stay bounded.
_MOST_DEPTH = 512

SCHEMA = ("page_id BIGINT, doc_pos BIGINT, parent_pos BIGINT, last_pos BIGINT, depth INT, tag STRING, xpath STRING,"
          " raw_text STRING, attrs MAP<STRING,STRING>, hidden BOOLEAN, region STRING, form_id BIGINT,"
          " group_name STRING, list_depth INT")
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("doc_pos", pa.int64()), ("parent_pos", pa.int64()), ("last_pos", pa.int64()),
    ("depth", pa.int32()), ("tag", pa.string()), ("xpath", pa.string()), ("raw_text", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("hidden", pa.bool_()), ("region", pa.string()),
    ("form_id", pa.int64()), ("group_name", pa.string()), ("list_depth", pa.int32())])


class _Elements(HTMLParser):
    """Rows of one page in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.skipping = [], [], None
        self.count: dict[str, int] = {}  # open elements by tag
        self._add("body", {})

    def _add(self, tag, attrs):
        parent = self.open[min(len(self.open), _MOST_DEPTH) - 1] if self.open else None
        pos = len(self.rows)
        if parent:
            n = parent["_seen"][tag] = parent["_seen"].get(tag, 0) + 1
            xpath = f"{parent['xpath']}/{tag}" + (f"[{n}]" if n > 1 else "")
        else:
            xpath = "/html/body"
        row = {"doc_pos": pos, "parent_pos": parent and parent["doc_pos"], "last_pos": pos,
               "depth": min(len(self.open), _MOST_DEPTH), "tag": tag, "xpath": xpath, "raw_text": "", "attrs": attrs,
               "list_depth": int(tag in ("ul", "ol")), "_seen": {}, "_text": []}
        row["_gone"] = bool("hidden" in attrs or _GONE.search(attrs.get("style", ""))
                            or (tag == "input" and attrs.get("type", "").lower() == "hidden"))
        row["form_id"] = pos if tag == "form" else (parent and parent["form_id"])
        row["hidden"] = (row["_gone"] or attrs.get("aria-hidden") == "true"
                         or any(r["_gone"] for r in self.open[-_HIDING_ANCESTORS:]))
        row["region"] = (_region(parent) or parent["region"]) if parent else "unknown"
        row["group_name"] = next((g for g in map(_group, self.open[:-_GROUP_ANCESTORS - 1:-1]) if g), "")
        self.rows.append(row)
        return row

    def handle_starttag(self, tag, attrs):
        if self.skipping:
            self.skipping[1] += tag == self.skipping[0]
            return
        if tag in _OUTSIDE_BODY:
            if tag == "body":
                self.rows[0]["attrs"] = {k: v or "" for k, v in attrs}
            elif tag == "title":
                self.skipping = [tag, 1]
            return
        if tag in _SKIP:
            if tag not in VOID:
                self.skipping = [tag, 1]
            return
        if any(self.count.get(name) for name in _CLOSES.get(tag, ())):
            for at in range(len(self.open) - 1, 0, -1):
                name = self.open[at]["tag"]
                if tag in CLOSED_BY.get(name, ()):
                    self._close(at)
                    break
                if name in SCOPES:
                    break
        row = self._add(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(row)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        if tag not in _SKIP:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping[0]:
                self.skipping[1] -= 1
                if not self.skipping[1]:
                    self.skipping = None
            return
        if self.count.get(tag):
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at]["tag"] == tag:
                    self._close(at)
                    return

    def handle_data(self, data):
        if not self.skipping:
            self.open[-1]["_text"].append(data)  # joined once, when the element ends

    def _close(self, at):
        while len(self.open) > at:
            row = self.open.pop()
            self.count[row["tag"]] = self.count.get(row["tag"], 0) - 1
            row["last_pos"] = len(self.rows) - 1
            row["raw_text"] = "".join(row["_text"])
            if self.open:
                parent = self.open[-1]
                parent["list_depth"] = max(parent["list_depth"],
                                           row["list_depth"] + (parent["tag"] in ("ul", "ol")))

    def finish(self, html):
        self.open.append(self.rows[0])
        self.feed(html)
        self.close()
        self._close(0)
        return self.rows


def _region(row):
    role = row["attrs"].get("role")
    if row["tag"] in ("header", "nav") or role in ("banner", "navigation"):
        return "header"
    return "footer" if row["tag"] == "footer" or role == "contentinfo" else None


def _group(row):
    attrs, label = row["attrs"], row["attrs"].get("aria-label")
    if row["tag"] == "form":
        return label or attrs.get("name") or attrs.get("id") or "form"
    if attrs.get("role") == "search":
        return label or "search-bar"
    return (label or "dialog") if attrs.get("role") in ("dialog", "alertdialog") else None


_ROWS_PER_BATCH = 20_000


def _batch(columns):
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)


def _parse(batches):
    names = [n for n in _ARROW.names if n not in ("page_id", "attrs")]
    columns = {n: [] for n in _ARROW.names}
    for batch in batches:
        for page_id, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True):
            if html is None:
                continue
            rows = _Elements().finish(html)
            for n in names:
                columns[n] += [r[n] for r in rows]
            columns["attrs"] += [list(r["attrs"].items()) for r in rows]
            columns["page_id"] += [page_id] * len(rows)
            if len(columns["page_id"]) >= _ROWS_PER_BATCH:
                yield _batch(columns)
                columns = {n: [] for n in _ARROW.names}
    if columns["page_id"]:
        yield _batch(columns)


def node_text():
    """Own text of an element: a field's value or placeholder, an image's alt, else its text, cut to 100."""
    def filled(*names):
        return F.coalesce(*[F.nullif(attr(n), F.lit("")) for n in names], F.lit(""))

    own = (F.when(F.col("tag") == "input", filled("value", "placeholder"))
           .when(F.col("tag") == "img", filled("alt")).otherwise(F.col("raw_text")))
    clean = squeeze(own)
    return F.when(F.length(clean) > MAX_TEXT, F.concat(
        F.substring(clean, 1, MAX_TEXT - 3), F.lit("..."))).otherwise(clean)


def node_interactive():
    """The element takes input, by tag, role, handler, tab order or editability."""
    return any_of([
        F.col("tag").isin(INTERACTIVE_TAGS), attr("role").isin(INTERACTIVE_ROLES), has_attr("onclick"),
        F.coalesce(F.regexp_extract(attr("tabindex"), r"^\s*([+-]?\d+)", 1).try_cast("int") >= 0, F.lit(False)),
        has_attr("contenteditable") & (F.lower(attr("contenteditable")) != "false")])


def html_nodes(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` to one row per element below and including body."""
    parsed = pages.select("page_id", "html").mapInArrow(_parse, SCHEMA)
    return parsed.select(
        "page_id", "doc_pos", "parent_pos", "last_pos", "depth", "tag", "xpath", node_text().alias("text"), "attrs",
        (~F.col("hidden")).alias("is_visible"), node_interactive().alias("is_interactive"), "region", "form_id",
        "group_name", "list_depth", F.lit(None).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("w"),
        F.lit(None).cast("bigint").alias("h"))
