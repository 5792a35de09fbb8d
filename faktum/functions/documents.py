"""Counts and facts of documents that need no parser: PDF tokens and RTF groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Catalogue features and their names in the file, and weights of the risk score.
FEATURES = {"openaction": "OpenAction", "additional_actions": "AA", "acroform": "AcroForm", "xfa": "XFA", "richmedia": "RichMedia", "3d": "3D"}


def pdf_counts(content: Column) -> dict[str, Column]:
    raw = F.decode(content, "ISO-8859-1")
    count = lambda p: F.regexp_count(raw, F.lit(p))
    token = lambda word: rf"(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])"
    named = F.array(*(F.when(raw.rlike(rf"/{name}(?![A-Za-z0-9])"), F.lit(label)) for label, name in FEATURES.items()))
    return {
        "header_count": count("%PDF-"),
        "eof_count": count("%%EOF"),
        "startxref_count": count("startxref"),
        "object_count": F.least(count(token("obj")), count(token("endobj"))),
        "flate_count": count("/FlateDecode"),
        "stream_count": count(token("stream")),
        "features": F.filter(named, lambda x: x.isNotNull()),
        "javascript_count": count(r"/JavaScript(?![A-Za-z0-9])"),
    }


def pdf_ratios(content: Column) -> dict[str, Column]:
    """Pages, annotations and links, and the latter two by page; without pages there are no ratios."""
    raw = F.decode(content, "ISO-8859-1")
    count = lambda key, name: F.regexp_count(raw, F.lit(rf"/{key}\s*/{name}(?![A-Za-z0-9])"))
    pages, notes, links = count("Type", "Page"), count("Type", "Annot"), count("S", "URI")
    by_page = lambda n: F.when(pages > 0, F.round(n / pages, 6))
    return {"page_count": pages, "annotation_count": notes, "uri_action_count": links, "annotations_per_page": by_page(notes), "uri_actions_per_page": F.when(links > 0, by_page(links))}


def rtf_facts(text: Column) -> dict[str, Column]:
    group = lambda name: F.nullif(F.trim(F.regexp_extract(text, rf"(?s)\{{\\{name} ([^{{}}]*)\}}", 1)), F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p))
    return {"title": group("title"), "author": group("author"), "field_count": count(r"\\field(?![a-z])"), "object_count": count(r"\\objdata(?![a-z])")}
