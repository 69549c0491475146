"""Reading XML of services: names without prefixes, trimmed text, numbers that may be missing. Documents are untrusted."""

from __future__ import annotations

import math
import re
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

from mapweave.schema import PARSE_ERROR, SERVICE_EXCEPTION, MapError

#: Declared entities are refused (expansion attacks); the document types of old services declare none.
_DECLARED = re.compile(r"<!ENTITY", re.IGNORECASE)


def local(name: str) -> str:
    return name.rpartition("}")[2].rpartition(":")[2]


def parse(body: str | None, what: str = "capabilities document") -> Element:
    if not body or not body.strip():
        raise MapError(PARSE_ERROR, f"the {what} is empty")
    if _DECLARED.search(body[:100_000]):
        raise MapError(PARSE_ERROR, f"the {what} declares entities")
    try:
        root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", body.lstrip("﻿")).strip())
    except ElementTree.ParseError as error:
        raise MapError(PARSE_ERROR, f"the {what} is not valid XML: {error}") from error
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = local(e.tag)
        e.attrib = {local(k): v for k, v in e.attrib.items()}
    return root


def children(node: Element | None, name: str) -> list[Element]:
    return [] if node is None else [c for c in node if c.tag == name]


def child(node: Element | None, *names: str) -> Element | None:
    """The first child of the first name that is there."""
    for name in names:
        if found := children(node, name):
            return found[0]
    return None


def text(node: Element | None) -> str | None:
    return None if node is None else ("".join([node.text or "", *(c.tail or "" for c in node)]).strip() or None)


def child_text(node: Element | None, name: str) -> str | None:
    return text(child(node, name))


def texts(node: Element | None, name: str) -> list[str]:
    return [t for c in children(node, name) if (t := text(c))]


def attr(node: Element | None, name: str) -> str | None:
    return None if node is None else (node.attrib.get(name, "").strip() or None)


def num(value: str | None) -> float | None:
    """The number that a text begins with."""
    found = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", value or "")
    out = float(found[0]) if found else None
    return out if out is not None and math.isfinite(out) else None


def num_attr(node: Element | None, name: str) -> float | None:
    return num(attr(node, name))


def href(node: Element | None) -> str | None:
    return attr(child(node, "OnlineResource"), "href")


def split_list(value: str | None) -> list[str]:
    return [x for x in re.split(r"[\s,]+", value or "") if x]


def raise_reported(root: Element) -> None:
    """Raises if the document is a report of exceptions, old or new."""
    if root.tag == "ServiceExceptionReport":
        found = [t for e in children(root, "ServiceException") if (t := text(e) or attr(e, "code"))]
        raise MapError(SERVICE_EXCEPTION, "; ".join(found) or "unknown service exception")
    if root.tag == "ExceptionReport":
        found = [t for e in children(root, "Exception") for t in texts(e, "ExceptionText")]
        raise MapError(SERVICE_EXCEPTION, "; ".join(found) or "unknown exception report")
