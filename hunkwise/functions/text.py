"""Line and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Exactly the characters that Python's ``str.split()`` splits at.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalise(line: Column) -> Column:
    """White space collapsed to one space and trimmed at the ends."""
    return F.trim(F.regexp_replace(line, WHITE_SPACE, " "))


def extension(path: Column) -> Column:
    """Lower-case suffix of a path's last component with its dot; empty for none and for dot files."""
    return F.regexp_extract(F.lower(path), r"[^/](\.[^/.]+)$", 1)


def excluded_prefixes(path: Column, table: dict[str, list[str]]) -> Column:
    """The prefixes that hold for a path: its extension's, else those of "*", else none."""
    none = F.array().cast("array<string>")
    if not table:
        return none
    entries = [x for ext, prefixes in table.items() for x in (F.lit(ext), F.array(*[F.lit(p) for p in prefixes]))]
    lookup = F.create_map(*entries)
    return F.coalesce(F.try_element_at(lookup, extension(path)), F.try_element_at(lookup, F.lit("*")), none)


def starts_with_any(line: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(line, p))
