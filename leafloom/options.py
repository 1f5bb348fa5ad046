"""Options of an extraction and their validation, on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from leafloom.functions.text import PLACEHOLDERS
from leafloom.operators.tables import Options as TableOptions


@dataclass(frozen=True)
class Problem:
    field: str
    message: str
    value: object


@dataclass(frozen=True)
class ExtractOptions:
    text: bool = True
    images: bool = True
    tables: bool = False
    page_markers: bool = True
    marker_format: str = "--- PAGE {page} ---"
    image_ref_format: str = "[IMAGE:{id}]"
    page_offset: int = 0
    pages: tuple[int, ...] | None = None
    batch_size: int = 10
    memory_limit: str = "512MB"
    image_quality: int = 80
    progress_every: int = 5
    table: TableOptions = field(default_factory=TableOptions)


def format_problems(fmt: str) -> list[Problem]:
    """A reference format needs a known placeholder and may have no unknown one."""
    found = re.findall(r"\{([^}]+)\}", fmt)
    out = [Problem("image_ref_format", f"unknown placeholder {{{x}}}", fmt) for x in dict.fromkeys(found) if x not in PLACEHOLDERS]
    return out if found else [*out, Problem("image_ref_format", "no placeholder", fmt)]


def problems(path: str, o: ExtractOptions) -> list[Problem]:
    """Everything that is wrong with a path and options; an empty list if nothing is."""
    out = []
    if not path.strip():
        out.append(Problem("path", "is empty", path))
    elif not re.search(r"\.pdf$|[*?{\[]|/$|^[^.]+$", path, re.I):
        out.append(Problem("path", "is neither a .pdf file, a folder nor a glob", path))
    if not 1 <= o.batch_size <= 100:
        out.append(Problem("batch_size", "must be 1 to 100", o.batch_size))
    if not re.fullmatch(r"\d+(?:KB|MB|GB)", o.memory_limit, re.I):
        out.append(Problem("memory_limit", "must be a number with KB, MB or GB", o.memory_limit))
    if not 1 <= o.image_quality <= 100:
        out.append(Problem("image_quality", "must be 1 to 100", o.image_quality))
    if o.page_offset < 0:
        out.append(Problem("page_offset", "must not be negative", o.page_offset))
    if o.pages is not None and any(p < 1 for p in o.pages):
        out.append(Problem("pages", "must start at 1", o.pages))
    if o.page_markers and "{page}" not in o.marker_format:
        out.append(Problem("marker_format", "has no {page}", o.marker_format))
    if o.images:
        out += format_problems(o.image_ref_format)
    if not (o.text or o.images or o.tables):
        out.append(Problem("text", "nothing is to be extracted", False))
    return out
