"""Rendering of the small selected brief on the driver, card packing, templates."""

from __future__ import annotations

import html
import json
import re

from .runs import fingerprint


def escape(text: str) -> str:
    return re.sub(r"([\\`*_\[\]<>|])", r"\\\1", text)


def safe_url(url: str | None) -> str:
    return url if url and re.match(r"https?://[^\s()<>]+$", url) else ""


def facts(rows: list[dict], metadata: dict) -> dict:
    """The brief as one document with its hash; every artefact carries the same hash."""
    doc = {"metadata": metadata, "must_read": [r for r in rows if r["part"] == "must_read"], "news": [r for r in rows if r["part"] == "news"]}
    return doc | {"hash": fingerprint(doc)}


def markdown(doc: dict) -> str:
    out = [f"# {escape(doc['metadata'].get('title', 'Brief'))}", "", f"<!-- {doc['hash']} -->", ""]
    for part, name in (("must_read", "Must read"), ("news", "News")):
        out += [f"## {name}", ""]
        for i, r in enumerate(doc[part], 1):
            link = f"[{escape(r['title'])}]({safe_url(r.get('url'))})" if safe_url(r.get("url")) else escape(r["title"])
            out += [f"{i}. {link} ({r.get('final_score', 0):.2f})", ""] + ([f"   {escape(r['summary'])}", ""] if r.get("summary") else [])
        if not doc[part]:
            out += ["Nothing today.", ""]
    return "\n".join(out).rstrip() + "\n"


def page(doc: dict) -> str:
    out = [f"<!-- {doc['hash']} -->", f"<h1>{html.escape(doc['metadata'].get('title', 'Brief'))}</h1>"]
    for part, name in (("must_read", "Must read"), ("news", "News")):
        rows = "".join(f"<li><a href=\"{html.escape(safe_url(r.get('url')))}\">{html.escape(r['title'])}</a> <small>{r.get('final_score', 0):.2f}</small></li>" for r in doc[part])
        out.append(f"<h2>{name}</h2><ol>{rows}</ol>")
    return "\n".join(out) + "\n"


def split_text(text: str, most: int = 18_000) -> list[str]:
    """Pieces of at most ``most`` characters, cut at line ends where there are any."""
    out = []
    while len(text) > most:
        at = text.rfind("\n", 1, most)
        at = at if at > 0 else most
        out.append(text[:at])
        text = text[at:].lstrip("\n")
    return out + [text] if text else out


def packed(elements: list[str], most: int = 25_000) -> list[list[str]]:
    """Elements in order, greedily in cards whose JSON stays under ``most`` characters."""
    cards: list[list[str]] = []
    for e in [p for x in elements for p in split_text(x)]:
        if cards and len(json.dumps([*cards[-1], e], ensure_ascii=False)) < most:
            cards[-1].append(e)
        else:
            cards.append([e])
    return cards


def shorten(text: str, limit: int, split: str) -> str:
    """Whole segments between ``split`` as long as they fit the limit; the first is cut if it doesn't."""
    if len(text) <= limit:
        return text
    out = ""
    for part in text.split(split):
        more = out + (split if out else "") + part
        if len(more) > limit:
            break
        out = more
    return out or text[:limit]


def template(text: str, values: dict[str, str]) -> str:
    """``#{key}``, ``#{key?limit=N&split=S}`` filled in; unknown keys stay as they stand."""

    def fill(m: re.Match) -> str:
        if m[1] not in values:
            return m[0]
        opts = dict(p.partition("=")[::2] for p in (m[2] or "").split("&") if p)
        v = str(values[m[1]])
        return shorten(v, int(opts["limit"]), opts.get("split", "\n").replace("\\n", "\n")) if opts.get("limit", "").isdigit() else v

    return re.sub(r"#\{(\w+)(?:\?([^}]*))?\}", fill, text)


_SECRET = re.compile(r"(?i)(key|token|secret|password|authorization|cookie)")


def redacted(value: object, name: str = "") -> object:
    """A document without secrets: values under telling names, credentials and telling parameters in addresses."""
    if isinstance(value, dict):
        return {k: redacted(v, str(k)) for k, v in value.items()}
    if isinstance(value, list):
        return [redacted(v, name) for v in value]
    if isinstance(value, str):
        if _SECRET.search(name) and not name.endswith("_env"):
            return "***"
        value = re.sub(r"(?<=://)[^/@\s]+@", "***@", value)
        return re.sub(r"([?&])([^=&]*(?:key|token|secret|password)[^=&]*)=[^&#\s]*", r"\1\2=***", value, flags=re.I)
    return value


def expanded(value: object, env: dict[str, str]) -> object:
    """``${NAME}`` in every string of a document, from ``env``; unset names stay."""
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), value) if isinstance(value, str) else value
