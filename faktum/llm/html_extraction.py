"""Main text of pages by wrappers inferred for each host.

The wrapper of a host is a union-free regular expression over block-level
elements and text slots.  It grows by aligning page after page: groups of
siblings that repeat become repeated groups, elements that some pages lack
become optional ones, and texts become slots that remember whether they vary.
Every page of the host takes part.  Alignment is merged like a sum: first in
each task, then over salted parts of a host, then over the host, so a host
with a third of all pages meets no single task with more than one wrapper of
each part.  The wrapper decides, for each template of the host (pages with text
in the same containers), which slots hold the article: slots that vary and
aren't mostly links can belong to it, and those in the innermost element that
holds most of such text do.  A line that most pages have in a slot, between
texts that vary, is the site's and goes; paragraphs that copies of an article
share stay.  Rare texts aren't counted, and a wrapper knows by how much a count
can be short; hosts where that could matter are aligned again with the texts in
question counted from the start.  Tags and classes are evidence about slots.  Article and main
elements tell which slots are the article's if they hold a fair share of the
template's text.  Elements that are menus, forms, adverts, comments and the like
by their tag or by nothing but such words go.  A class that may mean furniture
(`notice`, `share`, `related`) is a doubt: its slots are the article's if their
texts vary from page to page and aren't links.  A class that such a word is
only a part of (`share-price`), or that a paragraph has, is no more than a hint.

Nulls: null html is an empty page; a null url or one without a host belongs to
the host ''.  A page without article text has the text ''.  Rows that repeat
come out as often; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm import page, textkit
from faktum.llm.storage import cut, table
from faktum.llm.url_filter import host_of

#: Parts that a host's wrappers are merged in first.
SALTS = 32
#: Hosts whose wrappers a task holds before it passes them on.
HELD = 5_000
#: Wrappers' paths up to this size are broadcast; beyond it pages and wrappers are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

WRAPPER = pa.schema([("host", pa.string()), ("salt", pa.int32()), ("wrapper", pa.binary())])
WRAPPER_DDL = "host string, salt int, wrapper binary"


def _infer(batches):
    held: dict[str, page.Node] = {}
    part = 0

    def out():
        salts = [hash_part(h, part) for h in held]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(salts, pa.int32()), pa.array([pickle.dumps(w) for w in held.values()], pa.binary())], schema=WRAPPER)

    for batch in batches:
        for host, seed, html, pinned in zip(batch.column("host").to_pylist(), batch.column("seed").to_pylist(), batch.column("html"), batch.column("pinned").to_pylist(), strict=True):
            part = part or seed
            _, tree = page.read(html.as_py() or "")
            tree.pinned = frozenset(pinned or ())
            if host in held:
                page.align(held[host], tree)
            else:
                held[host] = tree
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def hash_part(host: str, seed: int) -> int:
    return (page.hash_of(host) + seed) % SALTS


def _merge(rows: pa.Table) -> pa.Table:
    whole = None
    for x in rows["wrapper"]:  # one tree at a time, whatever their number
        tree = pickle.loads(x.as_py())
        if whole is None:
            whole = tree
        else:
            page.align(whole, tree)
    return pa.table([rows["host"][:1], rows["salt"][:1], pa.array([pickle.dumps(whole)], pa.binary())], schema=WRAPPER)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (a pickled tree) of every host of pages (url, html), whose texts in `pinned`, if there is such a column, are counted however rare."""
    pinned = F.col("pinned") if "pinned" in pages.columns else F.lit(None).cast("array<long>")
    rows = pages.select(host_of(F.col("url")).alias("host"), "html", F.spark_partition_id().alias("seed"), pinned.alias("pinned"))
    own = rows.mapInArrow(textkit.tidy(_infer), WRAPPER_DDL)
    own = own.groupBy("host", "salt").applyInArrow(_merge, WRAPPER_DDL)
    return own.groupBy("host").applyInArrow(_merge, WRAPPER_DDL).select("host", "wrapper")


def _paths(batches):
    for batch in batches:
        own = []
        for host, tree in zip(batch.column("host").to_pylist(), batch.column("wrapper"), strict=True):
            whole = pickle.loads(tree.as_py())
            unsure = page.unsure(whole)
            pinned = sorted(unsure | whole.pinned) if unsure else None
            own += [(host, template, *x, pinned) for template, x in page.content(whole).items()]
        host, template, constant, paths, pinned = zip(*own, strict=True) if own else ((), (), (), (), ())
        keys = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(template, pa.int64()), pa.array(constant, keys), pa.array(paths, keys), pa.array(pinned, keys)], names=["host", "template", "constant", "paths", "pinned"])


def _read(batches):
    for batch in batches:
        templates, blocks = [], []
        for html in batch.column("html"):
            own = page.read(html.as_py() or "")[0]
            templates.append(page.template_of(own))
            blocks.append(pickle.dumps([(b.path, b.text) for b in own if b.level != page.OUT]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(templates, pa.int64()), pa.array(blocks, pa.binary())], names=["page_id", "url", "host", "template", "blocks"])


def _extract(batches):
    for batch in batches:
        texts = []
        sets: dict[tuple, frozenset] = {}
        for blocks, constant, paths in zip(batch.column("blocks"), batch.column("constant").to_pylist(), batch.column("paths").to_pylist(), strict=True):
            constant, paths = (sets.setdefault(tuple(x or ()), frozenset(x or ())) for x in (constant, paths))
            own = [page.Block(path, page.NOTHING, False, text, 0) for path, text in pickle.loads(blocks.as_py())]
            texts.append(page.main_text(own, constant, paths))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _content(pages: DataFrame) -> DataFrame:
    """host, template, constant, paths, pinned: what the wrappers say of each template, and, of hosts where counts can be short by something that matters, the texts to be counted whole."""
    return cut(wrappers(pages).mapInArrow(textkit.tidy(_paths), "host string, template long, constant array<long>, paths array<long>, pinned array<long>"))


def _unsure(paths: DataFrame) -> int:
    """The size of what is to be counted whole; 0 for nothing."""
    return paths.agg(F.sum(F.when(F.col("pinned").isNotNull(), 8 * F.size("pinned") + F.octet_length("host") + 64))).first()[0] or 0


def _sent(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    paths = _content(pages)
    while unsure := _unsure(paths):
        again = _sent(paths.filter("pinned IS NOT NULL").groupBy("host").agg(F.first("pinned").alias("pinned")), unsure)
        paths = cut(paths.filter("pinned IS NULL").unionByName(_content(pages.join(again, "host"))))
    paths = paths.drop("pinned")
    size = paths.agg(F.sum(8 * (F.size("constant") + F.size("paths")) + F.octet_length("host") + 64)).first()[0] or 0
    read = pages.mapInArrow(textkit.tidy(_read), "page_id long, url string, host string, template long, blocks binary")
    joined = read.join(_sent(paths, size), ["host", "template"], "left")
    return joined.select("page_id", "url", "blocks", "constant", "paths").mapInArrow(textkit.tidy(_extract), "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
