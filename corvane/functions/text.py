"""Column expressions over text: white space, ids, formats, markdown, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes and their formats.
FORMATS = {"txt": "txt", "pdf": "pdf", "docx": "docx", "doc": "docx", "md": "markdown", "markdown": "markdown"}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(t: str | Column) -> Column:
    """Runs of Unicode white space become one space, none at the ends; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(_c(t), r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def chunk_id(doc_id: str | Column, index: str | Column, text: str | Column) -> Column:
    return F.concat(_c(doc_id).cast("string"), F.lit("_chunk_"), _c(index).cast("string"), F.lit("_"), F.substring(F.md5(_c(text)), 1, 7))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def document_id(path: str | Column, unique: bool = False) -> Column:
    """The file's name with ``_`` for spaces; ``unique`` adds a hash of the whole path."""
    name = F.replace(file_name(path), F.lit(" "), F.lit("_"))
    return F.concat(name, F.lit("_"), F.substring(F.md5(_c(path)), 1, 8)) if unique else name


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def detect_format(path: str | Column, strict: bool = False) -> Column:
    """Format by suffix; unknown ones are null, or an error if ``strict``."""
    s, found = suffix(path), None
    for k, v in FORMATS.items():
        found = F.when(s == k, v) if found is None else found.when(s == k, v)
    return found.otherwise(F.raise_error(F.concat(F.lit("unsupported format: "), _c(path)))) if strict else found


def preview(t: str | Column, n: int) -> Column:
    return F.when(F.length(_c(t)) > n, F.concat(F.substring(_c(t), 1, n), F.lit("..."))).otherwise(_c(t))


def estimated_tokens(t: str | Column) -> Column:
    return F.floor(F.length(_c(t)) / 4)


def content_hash(content: str | Column) -> Column:
    return F.sha2(_c(content), 256)


def cache_key(query: str | Column, collection: str | Column, k: str | Column, model: str | Column, temperature: str | Column, template: str | Column, ef_search: str | Column | None = None) -> Column:
    """SHA-256 of all that an answer depends on, in one canonical string."""
    parts = [
        _c(collection), _c(k).cast("string"), F.coalesce(_c(model), F.lit("default")), F.lower(F.trim(_c(query))),
        F.format_string("%.2f", _c(temperature).cast("double")), F.coalesce(_c(template), F.lit("qa")),
        F.coalesce(_c(ef_search).cast("string"), F.lit("-")) if ef_search is not None else F.lit("-"),
    ]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def _markdown_table_row(line: Column) -> Column:
    cells = F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    rule = line.rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
    return F.when(rule, F.lit(None).cast("string")).otherwise(F.array_join(cells, " "))


def markdown_tables(t: str | Column) -> Column:
    """Table rows as their cells joined by spaces; rule rows go, other lines stay."""
    lines = F.split(_c(t), "\n")
    is_row = lambda x: x.rlike(r"^\s*\|.*\|\s*$")
    done = F.transform(lines, lambda x: F.when(is_row(x), _markdown_table_row(x)).otherwise(x))
    return F.array_join(F.filter(done, lambda x: x.isNotNull()), "\n")


def _markdown_prose(t: Column, headers: bool, links: bool) -> Column:
    rules = [
        (r"(?m)^#{1,6}[ \t]+(.+)$", "# $1" if headers else "$1"),
        (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
        (r"\[([^\]]+)\]\(([^)]+)\)", "$1 ($2)" if links else "$1"),
        (r"`([^`]+)`", "$1"),
        (r"\*\*\*([^*]+)\*\*\*", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"),
        (r"___([^_]+)___", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_\n]+)_", "$1"),
        (r"~~([^~]+)~~", "$1"),
        (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*\d+\.[ \t]+", ""),
        (r"(?m)^>[ \t]?", ""), (r"(?m)^[ \t]*([-*_])(?:[ \t]*\1){2,}[ \t]*$", ""),
        (r"<[^>]+>", ""),
    ]
    t = markdown_tables(t)
    for pattern, to in rules:
        t = F.regexp_replace(t, pattern, to)
    return t


def markdown_to_text(t: str | Column, preserve_headers: bool = True, preserve_code_blocks: bool = True, preserve_links: bool = False) -> Column:
    """Plain text of markdown: an ordered chain of rewrites that leaves fenced code alone.

    Emphasis, lists, quotes, rules, tags and images' brackets go; headers become
    ``# x``; links keep their text, and with ``preserve_links`` their target; white
    space is collapsed. Underscores inside identifiers count as emphasis.
    """
    fence, t = r"(?s)```[^\n`]*\n(.*?)```", F.coalesce(_c(t), F.lit(""))
    # A fenced block follows each part of prose but the last.
    blocks = F.regexp_extract_all(t, F.lit(fence), F.lit(1))
    code = (lambda x: F.concat(F.lit(" [CODE] "), x, F.lit(" [/CODE] "))) if preserve_code_blocks else (lambda x: F.lit(" "))
    after = lambda i: F.when(i < F.size(blocks), code(F.get(blocks, i))).otherwise(F.lit(""))
    whole = F.transform(F.split(t, fence, -1), lambda x, i: F.concat(_markdown_prose(x, preserve_headers, preserve_links), after(i)))
    return normalize_text(F.array_join(whole, ""))


def markdown_headers(t: str | Column) -> Column:
    """``array<struct<level, text>>`` of the headers in order."""
    found = F.regexp_extract_all(_c(t), F.lit(r"(?m)^(#{1,6}\s+.+)$"), F.lit(1))
    return F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(h, r"^#+\s+", "")).alias("text")))


def html_to_text(t: str | Column) -> Column:
    """Visible text of a page: scripts, styles and tags go, the common entities are read."""
    t = F.regexp_replace(_c(t), r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return normalize_text(t)
