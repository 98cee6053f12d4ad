"""Colour spaces, spot colours and font embedding."""

from __future__ import annotations

from typing import Any

from foliospark.kernels.document import Document, Page
from foliospark.kernels.objects import Name, Stream

NO_SPOT = {"All", "None", ""}
PROCESS = {"Cyan", "Magenta", "Yellow", "Black", "None", "All", ""}


def describe_space(doc: Document, x: Any, depth: int = 0) -> str:
    x = doc.get(x)
    if isinstance(x, Name):
        return str(x)
    if not isinstance(x, list) or not x or depth > 8:
        return "Unknown"
    kind = str(doc.get(x[0]))
    if kind == "Indexed" and len(x) > 1:
        return f"Indexed({describe_space(doc, x[1], depth + 1)})"
    if kind == "Separation" and len(x) > 1:
        return f"Separation({doc.get(x[1])})"
    if kind == "DeviceN" and len(x) > 1:
        return f"DeviceN({','.join(str(doc.get(n)) for n in doc.get(x[1]) or [])})"
    if kind == "ICCBased" and len(x) > 1 and isinstance(s := doc.get(x[1]), Stream):
        return f"ICCBased({doc.get(s.dict.get('N'))})"
    return kind


def spot_names(doc: Document, x: Any, depth: int = 0) -> set[str]:
    x = doc.get(x)
    if not isinstance(x, list) or len(x) < 2 or depth > 8:
        return set()
    kind = doc.get(x[0])
    if kind == "Separation":
        return {str(doc.get(x[1]))} - NO_SPOT
    if kind == "DeviceN":
        return {str(doc.get(n)) for n in doc.get(x[1]) or []} - PROCESS
    return spot_names(doc, x[1], depth + 1) if kind == "Indexed" else set()


def page_spots(page: Page) -> set[str]:
    group = page.doc.get(page.resources.get("ColorSpace"))
    return set().union(*(spot_names(page.doc, x) for x in group.values())) if isinstance(group, dict) else set()


def font_descriptor(doc: Document, font: dict) -> dict | None:
    kids = doc.get(font.get("DescendantFonts"))
    if isinstance(kids, list) and kids and isinstance(k := doc.get(kids[0]), dict):
        font = k
    d = doc.get(font.get("FontDescriptor"))
    return d if isinstance(d, dict) else None


def page_fonts(page: Page) -> list[tuple[str, bool]]:
    """(name, embedded) of the fonts in a page's resources."""
    group = page.doc.get(page.resources.get("Font"))
    out = []
    for x in group.values() if isinstance(group, dict) else []:
        f = page.doc.get(x)
        if isinstance(f, dict):
            d = font_descriptor(page.doc, f) or {}
            out.append((str(page.doc.get(f.get("BaseFont")) or ""), any(k in d for k in ("FontFile", "FontFile2", "FontFile3"))))
    return out
