"""Semantic chunks of HTML pages.

A page is folded in document order: headings set the section, paragraphs,
info boxes, tables and figures become chunks. One page is one row, so the
fold runs per row inside an Arrow batch; everything after it is columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomlight.functions.text import normalize_source_name, section_content, section_path

MIN_PARAGRAPH = 20  # fixed value: shorter paragraphs are skipped

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_PARAGRAPH = BLOCK - frozenset("body caption html li tbody td tfoot th thead tr".split())
# A new element ends an open one of these kinds, up to the nearest boundary.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
}
PARAGRAPH_BOUNDARY = frozenset(["table", "td", "th", "caption", "button", "html"])
HIDDEN = frozenset(["script", "style"])
_GAPS = re.compile("[ \t\n\f\r\xa0]+")
_WHITE = re.compile("[ \t\n\x0b\f\r]+")
_CONTROL = "".join(map(chr, range(0x21)))

SECTION_SCHEMA = (
    "semantic_id string, chunk_type string, text string, h2 string, h3 string, h4 string, "
    "chunk_order int, image_url string, alt_text string, caption string, figure_index int, "
    "content_hash string"
)


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[_Node]:
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, _Node):
                yield child
                stack.append(iter(child.children))

    def all(self, *tags: str) -> list[_Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> _Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def text(self) -> str:
        parts: list[str] = []
        stack: list[tuple[_Node, Iterator]] = [(self, iter(self.children))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                if node.tag in BLOCK:
                    parts.append(" ")
            elif isinstance(child, str):
                if node.tag not in HIDDEN:
                    parts.append(child)
            else:
                if child.tag in BLOCK or child.tag == "br":
                    parts.append(" ")
                stack.append((child, iter(child.children)))
        return _GAPS.sub(" ", "".join(parts)).strip(" ")


class _Tree(HTMLParser):
    """Element tree with the implied end tags of HTML."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", {})
        self.open = [self.root]

    def _end(self, tags: frozenset, boundary: frozenset) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                del self.open[depth:]
                return
            if tag in boundary:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_PARAGRAPH:
            self._end(frozenset(["p"]), PARAGRAPH_BOUNDARY)
        if tag in IMPLIED_ENDS:
            self._end(*IMPLIED_ENDS[tag])
        node = _Node(tag, {name: value or "" for name, value in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        # A trailing slash has no effect on elements that take content.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end(frozenset([tag]), frozenset())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def table_rows(table: _Node) -> str:
    """Markdown rows; a separator follows the first one."""
    lines = []
    for row in table.all("tr"):
        cells = [cell.text().replace("|", "\\|") for cell in row.all("th", "td")]
        if cells:
            lines.append("| " + " | ".join(cells) + " |")
            if len(lines) == 1:
                lines.append("|" + "---|" * len(cells))
    return "".join(line + "\n" for line in lines)


def infobox_lines(table: _Node) -> str:
    """A bold key and its value per row that has both."""
    lines = []
    for row in table.all("tr"):
        key, value = row.first("th"), row.first("td")
        if key is not None and value is not None and key.text() and value.text():
            lines.append(f"**{key.text()}**: {value.text()}\n")
    return "".join(lines)


def _figure(node: _Node) -> dict | None:
    image = node.first("img")
    if image is None:
        return None
    source, alt = image.attrs.get("src", ""), image.attrs.get("alt", "")
    label = next(
        (n for n in node.walk() if n.tag == "figcaption" or "thumbcaption" in n.classes()), None
    )
    caption = alt if label is None else label.text()
    caption = caption if caption.strip() else "Image without caption"
    return {
        "image_url": "https:" + source if source.startswith("//") else source,
        "alt_text": alt,
        "caption": caption,
        "text": "Image Caption: " + caption,
    }


def page_sections(html: str, title: str) -> Iterator[dict]:
    """Chunks of one page in document order, with their heading texts."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    headings: dict[str, str | None] = {"h2": None, "h3": None, "h4": None}
    lead = True
    stem = title.replace(" ", "_")
    counts = {"p": 0, "info": 0, "table": 0, "img": 0}
    order = 0
    for node in tree.root.walk():
        found: dict | None = None
        if node.tag in headings:
            level = node.tag
            headings = {h: t if h < level else None for h, t in headings.items()}
            headings[level] = node.text()
            lead = lead and level != "h2"
        elif node.tag == "p":
            text = node.text()
            if len(text) >= MIN_PARAGRAPH:
                name = "summary_" if lead else "p"
                found = {"kind": "p", "name": name, "text": text}
                found["chunk_type"] = "LEAD_SECTION" if lead else "PARAGRAPH"
        elif node.tag == "table" or (node.tag == "div" and "thumb" in node.classes()):
            if "infobox" in node.classes():
                found = {"kind": "info", "text": infobox_lines(node), "chunk_type": "INFOBOX"}
            elif "wikitable" in node.classes():
                found = {"kind": "table", "text": table_rows(node), "chunk_type": "WIKITABLE"}
            if found and not found["text"].strip():
                found = None
        elif node.tag == "figure":
            found = _figure(node)
            if found:
                found |= {"kind": "img", "chunk_type": "IMAGE"}
        if found:
            kind = found.pop("kind")
            counts[kind] += 1
            order += 1
            if kind == "img":
                found["figure_index"] = counts[kind]
            found["semantic_id"] = f"{stem}:{found.pop('name', kind)}{counts[kind]}"
            yield found | headings | {"chunk_order": order}


def _document_hash(chunks: list[dict]) -> str:
    """Hash of all chunk texts in order, each followed by a line break."""
    whole = "".join(chunk["text"] + "\n" for chunk in chunks)
    return sha256(_WHITE.sub(" ", whole.strip(_CONTROL)).encode()).hexdigest()


def section_chunks(pages: DataFrame, html: str = "html", title: str = "title") -> DataFrame:
    """One row per semantic chunk; the columns of ``pages`` but the HTML are kept.

    ``title`` names the page in ids and headers.
    """
    kept = [c for c in pages.columns if c != html]
    source = pages.select(*kept, html)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in kept]
        + [SECTION_SCHEMA]
    )
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    sections = [name for name in arrow.names if name not in kept]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, titles = batch.column(html).to_pylist(), batch.column(title).to_pylist()
            source_rows, found = [], []
            for row, (text, name) in enumerate(zip(texts, titles)):
                chunks = list(page_sections(text or "", name or ""))
                digest = _document_hash(chunks)
                source_rows += [row] * len(chunks)
                found += [chunk | {"content_hash": digest} for chunk in chunks]
            take = pa.array(source_rows, pa.int32())
            columns = [batch.column(c).take(take) for c in kept]
            columns += [
                pa.array([c.get(n) for c in found], arrow.field(n).type) for n in sections
            ]
            arrays = [a.cast(arrow.field(n).type) for a, n in zip(columns, arrow.names)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(fold, schema)


def section_index_rows(chunks: DataFrame, title: str = "title") -> DataFrame:
    """Rows for the chunk table from semantic chunks, which keep 0 as their total."""
    path = section_path(F.col("h2"), F.col("h3"), F.col("h4"))
    replaced = ("text", "h2", "h3", "h4", "chunk_order")
    return chunks.select(
        *[c for c in chunks.columns if c not in replaced],
        path.alias("section_path"),
        normalize_source_name(F.col(title)).alias("source_name"),
        F.col("chunk_order").alias("chunk_index"),
        F.lit(0).alias("total_chunks"),
        section_content(F.col(title), path, F.col("text")).alias("content"),
    )
