"""Parsers of feeds, JSON APIs and list pages: bytes in, raw records out.  No network, no Spark."""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

#: A raw record has these keys; what a source lacks is None.
RECORD = ("native_id", "title", "url", "published", "content", "author")


def record(**values: str | None) -> dict[str, str | None]:
    return {k: (v.strip() or None) if isinstance(v := values.get(k), str) else v for k in RECORD}


def plain(markup: str | None, limit: int = 4000) -> str | None:
    """Text of a markup fragment, tags dropped, white space collapsed, cut at the limit."""
    if not markup:
        return None
    text = re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]+>", " ", markup))).strip()
    return text[:limit] or None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def parse_feed(data: bytes) -> Iterator[dict[str, str | None]]:
    """Items of an RSS or Atom document.  Of several dates published goes before updated before created."""
    for node in ET.fromstring(data).iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for child in node:
            name, value = _local(child.tag), (child.text or "").strip()
            if name == "link":
                value = value or child.get("href", "")
                if child.get("rel", "alternate") != "alternate":
                    continue
            if name == "author" and not value:
                value = next((c.text or "" for c in child if _local(c.tag) == "name"), "")
            got.setdefault(name, value)
        when = next((got[n] for n in ("pubdate", "published", "date", "updated", "created") if got.get(n)), None)
        body = next((got[n] for n in ("encoded", "content", "description", "summary") if got.get(n)), None)
        yield record(native_id=got.get("guid") or got.get("id") or got.get("link"), title=plain(got.get("title")), url=got.get("link"), published=when, content=plain(body), author=got.get("author") or got.get("creator"))


def at_path(value: object, path: str) -> object:
    """What a dotted path leads to; None where it ends early.  Whole numbers index lists."""
    for part in filter(None, path.split(".")):
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


def parse_json_api(data: bytes, options: dict[str, str]) -> Iterator[dict[str, str | None]]:
    """Records of a JSON answer.  items_path, title_field, url_field and date_field must lead somewhere, content_field and id_field may; a record without the first three is left out."""
    rows = at_path(json.loads(data), options.get("items_path", ""))
    text = lambda r, k: None if (v := at_path(r, options[k]) if options.get(k) else None) is None else str(v)
    for r in rows if isinstance(rows, list) else []:
        title, url, when = (text(r, k) for k in ("title_field", "url_field", "date_field"))
        if title and url and when:
            yield record(native_id=text(r, "id_field") or url, title=plain(title), url=url, published=when, content=plain(text(r, "content_field")), author=None)


class Node:
    """An element of a parsed page."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        return re.sub(r"\s+", " ", " ".join(c if isinstance(c, str) else c.text() for c in self.children)).strip()

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def fits(self, simple: str) -> bool:
        """One simple selector: tag, .class, #id, [attr], [attr=value], in any combination."""
        m = re.fullmatch(r"([a-zA-Z0-9*]*)((?:[.#][\w-]+|\[[^\]]+\])*)", simple)
        if not m or m[1] not in ("", "*", self.tag):
            return False
        for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
            if part[0] == "." and part[1:] not in self.attrs.get("class", "").split():
                return False
            if part[0] == "#" and self.attrs.get("id") != part[1:]:
                return False
            if part[0] == "[":
                name, eq, value = part[1:-1].partition("=")
                if name not in self.attrs or eq and self.attrs[name] != value.strip("'\""):
                    return False
        return True

    def select(self, selector: str) -> list[Node]:
        """Descendants that fit a selector: simple ones apart by spaces, alternatives by commas; in document order."""
        chains = [s.split() for s in selector.split(",") if s.strip()]
        return [n for n in self.walk() if any(self._under(n, c) for c in chains)]

    def _under(self, node: Node, chain: list[str]) -> bool:
        if not node.fits(chain[-1]):
            return False
        up, rest = node.parent, chain[:-1]
        while rest and up is not None:
            if up.fits(rest[-1]):
                rest = rest[:-1]
            if up is self:
                break
            up = up.parent
        return not rest


class _Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in self.VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        up = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse_html(data: bytes | str) -> Node:
    tree = _Tree()
    tree.feed(data.decode("utf-8", "replace") if isinstance(data, bytes) else data)
    tree.close()
    return tree.root


def json_ld_field(page: Node, names: tuple[str, ...]) -> str | None:
    """The first value under one of the names, anywhere in the page's JSON-LD."""

    def search(v: object) -> str | None:
        if isinstance(v, dict):
            for n in names:
                if isinstance(v.get(n), str) and v[n].strip():
                    return v[n].strip()
            return next((x for x in map(search, v.values()) if x), None)
        if isinstance(v, list):
            return next((x for x in map(search, v) if x), None)
        return None

    for s in page.select("script[type=application/ld+json]"):
        try:
            got = search(json.loads("".join(c for c in s.children if isinstance(c, str))))
        except ValueError:
            continue
        if got:
            return got
    return None


MEDIA = {".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".csv": "text/csv"}


def parse_html_list(data: bytes, base: str, options: dict[str, str]) -> Iterator[dict[str, str | None]]:
    """Entries of a list page.  Selectors: item_selector, link_selector (default a), title_selector, date_selector, content_selector; include and exclude are patterns on an entry's text; each address once."""
    page, seen = parse_html(data), set()
    for item in page.select(options.get("item_selector", "article")):
        text = item.text()
        if options.get("include") and not re.search(options["include"], text, re.I) or options.get("exclude") and re.search(options["exclude"], text, re.I):
            continue
        links = item.select(options.get("link_selector", "a"))
        if not links or not links[0].attrs.get("href"):
            continue
        url = urljoin(base, links[0].attrs["href"])
        if url in seen:
            continue
        seen.add(url)
        first = lambda k: next(iter(item.select(options[k])), None) if options.get(k) else None
        title, day, body = first("title_selector"), first("date_selector"), first("content_selector")
        when = (day.attrs.get("datetime") or day.attrs.get("content") or day.text()) if day else None
        yield record(native_id=url, title=(title or links[0]).text(), url=url, published=when, content=body.text() if body else None, author=None)


def parse_document_index(data: bytes, base: str, options: dict[str, str]) -> Iterator[dict[str, str | None]]:
    """A list page of documents: no content; the media type by suffix, or as the options say, stands in ``author``'s place as media_type."""
    for r in parse_html_list(data, base, options):
        suffix = re.search(r"\.[A-Za-z0-9]+(?=$|[?#])", r["url"] or "")
        yield r | {"content": None, "media_type": options.get("media_type") or MEDIA.get(suffix[0].lower() if suffix else "", "text/html")}


def article_text(data: str | None) -> str | None:
    """The main text of a page: its paragraphs in article or main, else in the body; None without any."""
    if not data:
        return None
    page = parse_html(data)
    for scope in ("article p", "main p", "body p", "p"):
        parts = [t for t in (re.sub(r"\s+", " ", " ".join(c for c in p.children if isinstance(c, str))).strip() for p in page.select(scope)) if t]
        if parts:
            return "\n".join(parts)
    return None


def markdown_table(text: str) -> list[dict[str, str]]:
    """Rows of the first table of a Markdown text, by its header."""
    rows = [[c.strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))] for line in text.splitlines() if line.strip().startswith("|")]
    if len(rows) < 2 or not all(re.fullmatch(r":?-+:?", c) for c in rows[1]):
        return []
    return [dict(zip(rows[0], r, strict=False)) for r in rows[2:]]
