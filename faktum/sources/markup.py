"""Markup as a relation of elements, with the columns that syntax nodes have too (see `faktum.sources.scripts`)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from faktum.sources.scripts import tree_batches, tree_schema

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?=</(?P=raw)\b|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.IGNORECASE | re.DOTALL)
_LABEL = re.compile(r"(?:^|\s)(?:id|class)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s'\">]+))", re.IGNORECASE)
#: Elements without content, and which open element an element's start ends, up to which one it is looked for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {x: ("p", "article aside body button caption div footer form header html main nav section td th table".split()) for x in _BLOCKS} | {
    "li": ("li", ["ul", "ol", "menu"]), "dt": ("dt dd", ["dl"]), "dd": ("dt dd", ["dl"]), "tr": ("tr", ["table", "tbody", "thead", "tfoot"]), "td": ("td th", ["tr", "table"]), "th": ("td th", ["tr", "table"]), "option": ("option", ["select", "datalist"]),
}


def tree(html: str) -> list[tuple]:
    """(node, parent, last, depth, kind, name, start) in pre-order: `kind` is the tag, `name` its id or class.  End tags that end nothing are passed over, open elements end with their parent."""
    out: list[list] = [[0, -1, 0, 0, "document", None, 0]]
    open_ = [0]

    def close(k: int) -> None:
        for number in open_[k:]:
            out[number][2] = len(out) - 1
        del open_[k:]

    for found in _TAG.finditer(html):
        tag = (found["raw"] or found["name"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            at = next((k for k in range(len(open_) - 1, 0, -1) if out[open_[k]][4] == tag), 0)
            if at:
                close(at)
            continue
        ended, stops = ENDS.get(tag, ("", ()))
        for k in range(len(open_) - 1, 0, -1):
            own = out[open_[k]][4]
            if own in ended.split():
                close(k)
                break
            if own in stops:
                break
        label = _LABEL.search(found["rest"] or found.group().partition(">")[0])
        number = len(out)
        out.append([number, open_[-1], number, len(open_), tag, next(filter(None, label.groups()), None) if label else None, found.start()])
        if tag not in VOID and not (found["rest"] or "").endswith("/"):
            open_.append(number)
    close(0)
    return [tuple(x) for x in out]


FIELDS = {x: pa.string() if x in ("kind", "name", "op") else pa.int32() for x in "node parent last depth kind name start op".split()}


def nodes(pages: DataFrame, keys: list[str], html: str, fields: list[str] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """keys and node, parent, last, depth, kind, name, start, op (null), or those asked for, of each element, or of those of some kinds."""
    own = {x: FIELDS[x] for x in fields or FIELDS}
    places = {x: k for k, x in enumerate(FIELDS) if x != "op"}
    run = tree_batches(keys, html, tree, places, own, None if kinds is None else frozenset(kinds), lambda rows, _: [None] * len(rows))
    return pages.select(*keys, html).mapInArrow(run, tree_schema(pages, keys, own))
