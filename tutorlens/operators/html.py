"""One pass over the tree of a page, in Arrow batches: what stands where. The rules on it are column expressions (pages.py)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "ul", "ol", "br", "section", "article", "main", "tr", "table", "dd", "dt", "dl", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
CHROME = {"script", "style", "nav", "footer", "noscript", "head", "template"}

PARTS = (
    "title string, text string, headings array<struct<level:int,heading:string>>, "
    "links array<struct<label:string,href:string,raw:string,main:boolean,heading:string>>, media array<string>, frames array<string>, data_ids array<string>, scripts array<string>"
)

_TEXTS = pa.list_(pa.string())
#: The same for Arrow.
ARROW_PARTS = pa.struct({
    "title": pa.string(), "text": pa.string(), "headings": pa.list_(pa.struct({"level": pa.int32(), "heading": pa.string()})),
    "links": pa.list_(pa.struct({"label": pa.string(), "href": pa.string(), "raw": pa.string(), "main": pa.bool_(), "heading": pa.string()})), "media": _TEXTS, "frames": _TEXTS, "data_ids": _TEXTS, "scripts": _TEXTS,
})


def _containers(tag: str, attrs: dict) -> list[int]:
    """Places of the container rules that an element meets: main, article, role main, id content, class main-content, div of
    class contenido."""
    classes = (attrs.get("class") or "").split()
    met = (tag == "main", tag == "article", attrs.get("role") == "main", attrs.get("id") == "content", "main-content" in classes, tag == "div" and "contenido" in classes)
    return [i for i, m in enumerate(met) if m]


class Tree(HTMLParser):
    """Keeps the open elements and the texts that are being read; the first element of each container rule is one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], set()
        self.title, self.lines, self.heads, self.links = [], [], [], []
        self.media, self.frames, self.ids, self.scripts = [], [], [], []

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))  # of a repeated attribute the first counts
        rules = [r for r in _containers(tag, attrs) if r not in self.found]
        self.found.update(rules)
        src = attrs.get("src") or ""
        if src and (tag == "video" or tag == "source" and any(t == "video" for t, *_ in self.open)):
            self.media.append(src)
        if tag == "iframe" and src.strip():
            self.frames.append(src.strip())
        if (attrs.get("data-video") or "").strip():
            self.ids.append(attrs["data-video"].strip())
        kept = None
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            kept = {"level": int(tag[1]), "texts": []}
            self.heads.append(kept)
        elif tag == "a" and attrs.get("href") is not None:
            over = next((h for h in reversed(self.heads) if h["level"] <= 4), None)
            kept = {"href": attrs["href"].strip(), "texts": [], "inside": {r for *_, rs, _ in self.open for r in rs}, "over": over}
            self.links.append(kept)
        elif tag == "script" and attrs.get("type") == "application/ld+json":
            kept = {"texts": []}
            self.scripts.append(kept)
        if tag in BLOCKS:
            self.lines.append(("\n", frozenset(), False))
        if tag not in VOID:
            self.open.append((tag, rules, kept))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.lines.append(("\n", frozenset(), False))
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        tags = {t for t, *_ in self.open}
        for _, _, kept in self.open:
            if kept is not None:
                kept["texts"].append(data)
        if "title" in tags:
            self.title.append(data)
        if not tags & CHROME:
            self.lines.append((data, frozenset(r for _, rs, _ in self.open for r in rs), True))

    def parts(self, base: str) -> tuple:
        best = min(self.found, default=None)
        told = lambda texts: " ".join(s for s in (" ".join(t.split()) for t in texts) if s)
        text = "".join(t for t, inside, words in self.lines if not words or best is None or best in inside)
        lines = [" ".join(x.split()) for x in text.split("\n")]
        links = [(told(k["texts"]), _joined(base, k["href"]), k["href"], best is not None and best in k["inside"], told(k["over"]["texts"]) if k["over"] else None) for k in self.links]
        heads = [(h["level"], told(h["texts"])) for h in self.heads]
        return told(self.title), "\n".join(x for x in lines if x), heads, links, self.media, self.frames, self.ids, ["".join(s["texts"]) for s in self.scripts]


def _joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:  # a host that is none
        return href


#: Characters of pages whose parts are Python objects at a time.
AT_ONCE = 1 << 18


def _stretches(pages: pa.Array) -> Iterator[tuple[int, int]]:
    """Places from and to of runs of pages of about AT_ONCE characters, one page at least."""
    first = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(pages), 0).to_pylist()):
        if i > first and total + n > AT_ONCE:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(pages):
        yield first, len(pages)


def _parts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, urls in batches:
        for first, end in _stretches(pages):
            rows = []
            for page, base in zip(pages[first:end].to_pylist(), urls[first:end].to_pylist(), strict=True):
                tree = Tree()
                try:
                    tree.feed(page or "")
                    tree.close()
                except (AssertionError, ValueError):
                    pass
                rows.append(tree.parts(base or ""))
            yield pa.array(rows, ARROW_PARTS)


def tree_parts(html: Column, url: Column) -> Column:
    """PARTS of a page; a null page has empty ones. A page that cannot be parsed to its end gives what was read before. Of a
    batch, one stretch of pages at a time is read into Python objects and leaves as an Arrow array."""
    return F.arrow_udf(_parts, PARTS)(html, url)


def parsed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) with the columns of PARTS in `parts`."""
    return pages.withColumn("parts", tree_parts(F.col("html"), F.col("url")))
