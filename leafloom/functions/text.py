"""Column functions over texts: cleaning, counting, references, names, units."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page markers and image references that raw text does not have.
PAGE_MARKERS = (r"--- PAGE \d+ ---\s*", r"🎨 ART BASEL PAGE \d+ 🎨\s*", r"PAGE \d+\s*")
IMAGE_REFS = (r"\[IMG:\w+\]\s*\w*\s*", r"\[IMG-\w+\]\s*[^\[\n]*\s*", r"📷\s*[^-\n]*-\s*Page\s*\d+\s*-\s*Image\s*#\d+\s*", r"🎨\s*Art\s*Basel\s*Image\s*\d+\s*\(Page\s*\d+\)\s*")
MARKER = r"(?:--- PAGE (\d+) ---|🎨 ART BASEL PAGE (\d+) 🎨|PAGE (\d+))"
# What a reference format may hold, and how each looks in a text.
PLACEHOLDERS = {"id": r"[^\s\]]+", "name": r"[^\s\]]+", "page": r"\d+", "index": r"\d+", "path": r"[^\s\]]+"}
# First bytes (hex) of image files, formats, MIME types.
MAGIC = (("FFD8FF", "jpg"), ("89504E47", "png"), ("0000000C6A502020", "jp2"), ("47494638", "gif"), ("424D", "bmp"), ("49492A00", "tif"), ("4D4D002A", "tif"))
MIME = {"jpg": "image/jpeg", "png": "image/png", "jp2": "image/jp2", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff"}


def strip(c: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def raw_text(c: Column) -> Column:
    """Without markers and references; blank lines at most one in a row; trimmed, then runs of blanks as one."""
    c = reduce(lambda t, p: F.regexp_replace(t, p, ""), (*PAGE_MARKERS, *IMAGE_REFS), c)
    return F.regexp_replace(strip(F.regexp_replace(c, r"\n\s*\n\s*\n", "\n\n")), r"[ \t]+", " ")


def clean_text(c: Column) -> Column:
    """All white space as single spaces, trimmed."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def count_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+", -1), lambda w: F.length(w) > 0)).cast("bigint")


def div(a: Column, b: Column) -> Column:
    """Integer division of counts."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def _rounded(total: Column, count: Column, scale: int) -> Column:
    """total * scale / count as an integer, halves up, null for a count of 0."""
    total, count = total.cast("bigint"), count.cast("bigint")
    return F.when(count > 0, div(2 * scale * total + count, 2 * count))


def half_up(total: Column, count: Column) -> Column:
    return _rounded(total, count, 1)


def tenths(total: Column, count: Column) -> Column:
    """total / count to one decimal, halves up, as a string."""
    n = _rounded(total, count, 10)
    return F.concat(div(n, F.lit(10)).cast("string"), F.lit("."), (n % 10).cast("string"))


def hundredths(total: Column, count: Column) -> Column:
    """total / count to two decimals, halves up, as a string."""
    n = _rounded(total, count, 100)
    return F.concat(div(n, F.lit(100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def reading_minutes(words: Column) -> Column:
    return div(words + 199, F.lit(200))


def text_type(size: Column, length: Column) -> Column:
    return F.when(size > 14, "heading").when(length > 100, "paragraph").when(length < 30, "caption").otherwise("text")


def line_pages(text: Column, lines: int = 10) -> Column:
    """Pages of so many lines each; an empty text has one empty page."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    count = F.ceil(F.size(parts) / F.lit(lines)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.array_join(F.slice(parts, p * lines + 1, F.lit(lines)), "\n"))


def marker(fmt: str, page: Column) -> Column:
    """The marker of a page: only the first {page} of the format is filled in."""
    head, found, tail = fmt.partition("{page}")
    return F.concat(F.lit(head), page.cast("string"), F.lit(tail)) if found else F.lit(fmt)


def split_by_markers(text: Column) -> Column:
    """The trimmed texts after each page marker, empty ones too; the whole text where there is no marker."""
    parts = F.split(text, MARKER, -1)
    return F.when(F.size(parts) > 1, F.transform(F.slice(parts, F.lit(2), F.size(parts)), strip)).otherwise(F.array(text))


def page_ranges(spec: Column, total: Column) -> Column:
    """"1-3,7" -> [1, 2, 3, 7]: clamped to 1..total, without repeats, in order."""

    def one(part: Column) -> Column:
        ends = F.split(part, "-")
        low = F.trim(F.get(ends, F.lit(0))).try_cast("int")
        high = F.coalesce(F.trim(F.get(ends, F.lit(1))).try_cast("int"), low)
        first, last = F.greatest(low, F.lit(1)), F.least(high, total)
        return F.when(low.isNotNull() & high.isNotNull() & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), one))))


def format_reference(fmt: str, *, id: Column, page: Column, index: Column, name: Column | None = None, path: Column | None = None) -> Column:
    """An image reference: each placeholder replaced everywhere; name and path default to id."""
    values = {"id": id, "name": id if name is None else F.coalesce(F.nullif(name, F.lit("")), id), "page": page, "index": index, "path": id if path is None else F.coalesce(F.nullif(path, F.lit("")), id)}
    return reduce(lambda t, k: F.replace(t, F.lit("{" + k + "}"), values[k].cast("string")), values, F.lit(fmt))


def placeholders(fmt: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fmt, F.lit(r"\{([^}]+)\}"), F.lit(1)))


def is_valid_format(fmt: Column) -> Column:
    """At least one placeholder, and none that is unknown."""
    found = placeholders(fmt)
    return (F.size(found) > 0) & (F.size(F.array_except(found, F.array(*map(F.lit, PLACEHOLDERS)))) == 0)


def reference_pattern(fmt: str) -> str:
    """A pattern for the references that a format makes."""
    return "".join(PLACEHOLDERS[x[1:-1]] if x[1:-1] in PLACEHOLDERS and x[:1] == "{" else re.sub(r"([^\w\s])", r"\\\1", x) for x in re.split(r"(\{\w+\})", fmt))


def remove_references(text: Column, fmt: str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, reference_pattern(fmt), ""), r"\n\s*\n", "\n"))


def count_references(text: Column, fmt: str) -> Column:
    return F.regexp_count(text, F.lit(reference_pattern(fmt))).cast("bigint")


def file_size(size: Column) -> Column:
    """1536 -> 1.5 KB; to the unit that leaves less than 1024, GB at most."""
    out = None
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        text = F.concat(tenths(size, F.lit(1024**power)), F.lit(f" {unit}"))
        out = text if out is None and power == 3 else out
        if power < 3:
            out = F.when(size < 1024 ** (power + 1), text).otherwise(out)
    return out


def duration(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("bigint")
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))


def image_format(content: Column) -> Column:
    """By the first bytes; null for unknown or fewer than 10 bytes."""
    head, out = F.hex(F.substring(content, 1, 12)), None
    for magic, kind in MAGIC:
        hit = head.startswith(magic)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    return F.when(F.octet_length(content) >= 10, out)


def mime_type(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), kind), F.when(kind == "webp", "image/webp"), F.lit("application/octet-stream"))


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def page_file(pattern: str, *, page: Column, total: Column, name: Column, ext: Column) -> Column:
    """File names of page images: {page} is padded to three digits."""
    values = {"page": F.lpad(page.cast("string"), 3, "0"), "total": total.cast("string"), "name": name, "ext": ext}
    return reduce(lambda t, k: F.replace(t, F.lit("{" + k + "}"), values[k]), values, F.lit(pattern))


def render_size(width: Column, height: Column, *, to_width: int | None = None, to_height: int | None = None, scale: float = 1.0, dpi: int = 72) -> Column:
    """struct(width, height) of a rendered page: the wanted width decides, else the wanted height, else scale; times dpi / 72."""
    s = F.lit(to_width) / width if to_width else F.lit(to_height) / height if to_height else F.lit(float(scale))
    s = s * F.lit(dpi / 72)
    return F.struct(F.floor(width * s).alias("width"), F.floor(height * s).alias("height"))


def color_components(space: Column) -> Column:
    """Components of a colour space by its exact name; null if unknown."""
    return F.when(space.isin("/DeviceGray", "/CalGray", "/G", "/Indexed", "/I", "/Separation"), 1).when(space.isin("/DeviceRGB", "/CalRGB", "/RGB", "/Lab"), 3).when(space.isin("/DeviceCMYK", "/CMYK"), 4)


def cache_key(path: Column, modified: Column, size: Column, options: Column) -> Column:
    return F.md5(F.concat_ws(":", path, modified.cast("string"), size.cast("string"), options).cast("binary"))


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDDHHmmSS with or without its end; time zones are not applied."""
    digits = F.rpad(F.regexp_extract(c, r"^D:(\d{4,14})", 1), 14, "00000101000000")
    full = F.concat(F.regexp_extract(c, r"^D:(\d{4,14})", 1), F.substr(F.lit("00000101000000"), F.length(F.regexp_extract(c, r"^D:(\d{4,14})", 1)) + 1))
    return F.when(c.rlike(r"^D:\d{4}"), F.to_timestamp(F.when(F.length(full) == 14, full).otherwise(digits), "yyyyMMddHHmmss"))


def byte_size(size: Column) -> Column:
    """1536 -> 1.5 KB, 12 -> 12 B; MB at most."""
    kb, mb = F.concat(tenths(size, F.lit(1024)), F.lit(" KB")), F.concat(tenths(size, F.lit(1024**2)), F.lit(" MB"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, kb).otherwise(mb)


# Page markers with their numbers, the lines of a summary.
NUMBERED_MARKER = r"--- PAGE (?:\d+) ---|🎨 ART BASEL PAGE (?:\d+) 🎨|PAGE (?:\d+)"
SUMMARY = ("📄 Document Summary", "   Pages: ", "   Text items: ", "   Images: ", "   Text length: ", "   Processing time: ")


def page_by_marker(text: Column, page: Column) -> Column:
    """What follows the marker of a page, up to the next marker; without that marker, the page-th of ``page`` equal slices of lines."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBERED_MARKER), F.lit(0)), lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("bigint"))
    at = F.array_position(numbers, page.cast("bigint"))
    lines = F.split(text, "\n", -1)
    each = F.ceil(F.size(lines) / page).cast("int")
    slice_ = F.array_join(F.slice(lines, ((page - 1) * each + 1).cast("int"), each), "\n")
    return F.when(at > 0, F.get(F.split(text, NUMBERED_MARKER, -1), at.cast("int"))).otherwise(slice_)


def summary_block(pages: Column, items: Column, images: Column, characters: Column, milliseconds: Column | None = None) -> Column:
    """A document's totals as lines of text; the time only if it is given and not 0."""
    title, *heads = SUMMARY
    of = lambda k, *parts: F.concat(F.lit(heads[k]), *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    text = lambda c: c.cast("string")
    lines = [F.lit(title), of(0, text(pages)), of(1, text(items)), of(2, text(images), " (avg ", hundredths(images, pages), " per page)"), of(3, F.format_number(characters, 0), " characters")]
    if milliseconds is not None:
        lines.append(F.when(milliseconds > 0, of(4, text(milliseconds), "ms")))
    return F.concat_ws("\n", *lines)
