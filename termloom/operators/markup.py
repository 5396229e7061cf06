"""HTML documents: markup that isn't tagged, earlier annotations that go, and new annotations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.latin import from_latin, latin

# What counts as markup, and the marks that an earlier annotation left.
TAG = re.compile(
    r"<!DOCTYPE[ \t\r\n][^>]*?>|<!--.*?-->|<(head|pre|script)[> \t\r\n].*?</\1[ \t\r\n]*>"
    r"|</?[a-z0-9_]+(([ \t\r\n]+[a-z0-9_:-]+([ \t\r\n]*=[ \t\r\n]*(\".*?\"|'.*?'|[^\"'> \t\r\n]+))?)+[ \t\r\n]*|[ \t\r\n]*)/?>",
    re.IGNORECASE | re.DOTALL,
)
#: Fixed value: the marks of an earlier annotation, by the name in its handlers and blocks, which the caller gives.
EARLIER = r"(<span [^>]*?start{name}PopupTimer.*?>(.*?)</span>|<div [^>]*?{name}_.*?>.*?</div>\n?|</body>|</html>)"


def earlier_marks(name: str) -> re.Pattern:
    """The marks of an earlier annotation by ``name``: spans with a popup timer, blocks, and the ends of the page."""
    return re.compile(EARLIER.format(name=re.escape(name)), re.IGNORECASE | re.DOTALL)


def masked_of(text: str, earlier: re.Pattern) -> tuple[str, list[tuple[int, int]]]:
    """A string with NUL in place of markup, and the spans of earlier annotations to remove (last byte inclusive)."""
    keep: list[str] = []
    removals: list[tuple[int, int]] = []
    at = 0
    while (tag := TAG.search(text, at)) is not None:
        keep.append(text[at : tag.start()])
        if (old := earlier.match(text, tag.start())) is None:
            keep.append("\0" * (tag.end() - tag.start()))
            at = tag.end()
            continue
        at = old.end()
        if old[2] is None:
            removals.append((old.start(), old.end() - 1))
            keep.append("\0" * (old.end() - old.start()))
        else:
            removals += [(old.start(), old.start(2) - 1), (old.end(2), old.end() - 1)]
            keep += ["\0" * (old.start(2) - old.start()), old[2], "\0" * (old.end() - old.end(2))]
    keep.append(text[at:])
    return "".join(keep), removals


def masked(documents: DataFrame, name: str) -> DataFrame:
    """``doc_id, text, removals``: documents with NUL bytes in place of markup, all positions kept, and the spans to remove.

    ``name``: that of earlier annotations, see ``earlier_marks``.
    """
    kind = documents.select("doc_id").schema[0].dataType.simpleString()
    earlier = earlier_marks(name)
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text in batch.column(1).to_pylist():
                out, removals = masked_of((text or "").encode().decode("latin-1"), earlier)
                texts.append(None if text is None else out.encode("latin-1").decode("utf-8", "replace"))
                spans.append([{"start": a, "stop": b} for a, b in removals])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, span)], names=["doc_id", "text", "removals"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, removals array<struct<start:int,stop:int>>")


# The strings of an annotated page. ``name`` is that in its handlers, ``base`` that of its classes.
_SPAN = '<span class="{classes}" style="{style}" {events}>'
_EVENTS = 'onMouseOver="start{name}PopupTimer({quoted})" onMouseOut="stop{name}PopupTimer()" onclick="show{name}Popup({quoted})"'
_ENTITIES = '<div class="{base}_entities" style="display: none;">\n{lists}</div>\n'
_ENTITY = '  <span name="{md5}">{list}</span>\n'
_TYPES = '<div style="display: none;" class="{base}_entity_types">\n{types}</div>\n'
_TYPE = "  <span>{type}</span>\n"
_END = '<div style="display: none;" id="{base}_div_doi">{doc}</div>\n<div name="{lower}_v2" style="display: none;"></div>\n{footer}</body>\n</html>\n'


def _filled(template: str, **values: Column | str) -> Column:
    """The template with columns or strings in place of the names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    cells = [values[p] if k % 2 else p for k, p in enumerate(parts)]
    return F.concat(*(F.lit(c) if isinstance(c, str) else c for c in cells))


def annotated(
    documents: DataFrame, matches: DataFrame, removals: DataFrame | None = None, base: str = "tagger", styles: tuple[tuple[Callable[[Column], Column] | None, str], ...] = (),
    add_events: bool = False, extra_classes: bool = False, force_important: bool = False, footer: str = "", name: str = "Annotation",
) -> DataFrame:
    """``doc_id, html``: documents with their mentions in spans, and the lists of entities and types at the end.

    ``styles`` are (rule, style) in order of priority: a rule is a function from a type's column to a condition, None is
    met by all; the first that any entity of a mention meets is its style. ``name`` is that in the handlers and blocks
    that a page's script looks for. ``removals`` has ``doc_id, removals`` as ``masked`` gives them. A page is joined from
    its pieces at once, in time linear in its length.
    """
    own = lambda e: F.coalesce(e["identifier"], e["serial"].cast("string"))
    code = lambda e: F.concat(e["type"].cast("string"), F.lit("."), own(e))
    met = lambda rule: F.lit(True) if rule is None else F.exists("entities", lambda e: rule(e["type"]))
    style = F.coalesce(*(F.when(met(rule), F.lit(css)) for rule, css in styles), F.lit(""))
    style = F.replace(style, F.lit(";"), F.lit(" !important;")) if force_important else style
    marked = matches.withColumn("list", F.array_join(F.transform("entities", code), ";")).withColumn("md5", F.md5("list"))
    more = F.concat_ws("", F.transform("entities", lambda e: F.concat(F.lit(" "), own(e)))) if extra_classes else F.lit("")
    quoted = _filled("'{md5}','{text}'", md5=F.col("md5"), text=F.col("text"))
    events = _filled(_EVENTS, name=name, quoted=quoted) if add_events else F.lit("")
    opening = _filled(_SPAN, classes=F.concat(F.lit(f"{base}_match"), more), style=style, events=events)
    new = latin(F.concat(opening, F.col("text"), F.lit("</span>")))
    pieces = marked.select("doc_id", F.struct("start", "stop", new.alias("new"), "list", "md5", F.col("entities.type").alias("types")).alias("p"))
    if removals is not None:
        nothing = F.lit(None).cast("string")
        gone = removals.select("doc_id", F.explode("removals").alias("r")).select(
            "doc_id", F.struct("r.start", "r.stop", F.lit("").alias("new"), nothing.alias("list"), nothing.alias("md5"), F.array().cast("array<int>").alias("types")).alias("p")
        )
        pieces = pieces.unionByName(gone)
    per = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    # Bytes are cut from a binary column, where a cut costs its own length and not the way to it.
    joined = documents.select("doc_id", F.encode("text", "UTF-8").alias("b")).join(per, "doc_id", "left").withColumn("p", F.coalesce("p", F.array()))
    cut = lambda at, size: f"decode(substring(t, {at} + 1, {size}), 'ISO-8859-1')"
    begin = "coalesce(get(p, i - 1).stop + 1, 0)"
    # The text is the one element of an array, so that it is bound to ``t`` once and not copied out of its row for every piece.
    body = F.expr(f"""
      transform(array(b), t -> concat(array_join(transform(p, (x, i) -> concat({cut(begin, f"greatest(0, x.start - {begin})")}, x.new)), ''),
        {cut("coalesce(get(p, size(p) - 1).stop + 1, 0)", "length(t)")}))[0]
    """)
    lists = F.array_distinct(F.transform(F.filter("p", lambda x: x["list"].isNotNull()), lambda x: _filled(_ENTITY, md5=x["md5"], list=x["list"])))
    types = F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: x["types"])))), lambda t: _filled(_TYPE, type=t.cast("string")))
    return joined.select(
        "doc_id",
        F.concat(
            from_latin(body), _filled(_ENTITIES, base=base, lists=F.array_join(lists, "")), _filled(_TYPES, base=base, types=F.array_join(types, "")),
            _filled(_END, base=base, doc=F.col("doc_id").cast("string"), lower=name.lower(), footer=footer),
        ).alias("html"),
    )


def with_header(pages: DataFrame, script: str = "", uri: str | None = None) -> DataFrame:
    """Pages (``html``) with a script before the end of the head, and a base address if they have none."""
    html = F.col("html")
    if uri:
        parts = urlsplit(uri)
        base = f'<base href="{parts.scheme}://{parts.netloc}/" />'
        lacks = html.rlike("(?i)<head[^>]*>") & ~html.rlike("(?is)<head[^>]*>.*<base href=.+?>")
        html = F.when(lacks, F.regexp_replace(html, "(?is)^(.*?<head[^>]*>)", "$1" + base.replace("$", r"\$"))).otherwise(html)
    if script:
        html = F.regexp_replace(html, "(?is)^(.*?)(</head>)", "$1" + script.replace("\\", "\\\\").replace("$", r"\$") + "$2")
    return pages.withColumn("html", html)
