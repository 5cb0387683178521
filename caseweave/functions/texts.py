"""Text, identifier and id-list expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed: words of two or more word characters, with Unicode classes.
WORD_PATTERN = r"(?U)\b\w\w+\b"


def joined_text(columns: Sequence[Column]) -> Column:
    """Trimmed non-blank parts joined by one space; empty text when nothing is left."""
    return F.concat_ws(" ", *[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def id_list(cell: Column) -> Column:
    """Trimmed ids of a comma-separated cell; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(cell.cast("string"), F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def id_array(cell: Column) -> Column:
    """As ``id_list`` for a cell that already is an array."""
    trimmed = F.transform(
        F.coalesce(cell.cast("array<string>"), F.array().cast("array<string>")), lambda p: F.trim(p)
    )
    return F.filter(trimmed, lambda p: p.isNotNull() & (p != ""))


def location_id(district: Column, station: Column | None) -> Column:
    """``LOC::district::station``, or ``LOC::district`` without a station."""
    parts = [district] if station is None else [district, station]
    return F.concat_ws("::", F.lit("LOC"), *[p.cast("string") for p in parts])


def stored_node_id(node_type: Column, ref: Column) -> Column:
    return F.concat_ws("_", node_type.cast("string"), ref.cast("string"))


def stored_edge_id(incident: Column, source: Column, target: Column) -> Column:
    return F.concat_ws("_", F.lit("edge"), incident.cast("string"), source.cast("string"), target.cast("string"))


def contains_ci(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def equals_ci(a: Column, b: Column) -> Column:
    return F.upper(a) == F.upper(b)


def words_of_code(code: Column) -> Column:
    """``LAST_SEEN`` -> ``last seen``."""
    return F.lower(F.translate(code, "_", " "))


def title_of_code(code: Column) -> Column:
    """``under_review`` -> ``Under Review``."""
    return F.initcap(F.translate(code, "_", " "))


def initials(name: Column) -> Column:
    return F.array_join(
        F.transform(F.filter(F.split(name, " "), lambda p: p != ""), lambda p: F.upper(F.substring(p, 1, 1))),
        "",
    )


def signed_percent(value: Column) -> Column:
    """One decimal with a leading plus for gains: ``+12.5%``."""
    return F.concat(F.when(value > 0, "+").otherwise(""), F.format_string("%.1f", value), F.lit("%"))


def natural_order(text: Column) -> list[Column]:
    """Sort keys that put ``S2`` before ``S10``: leading text, first number, full text."""
    t = text.cast("string")
    return [
        F.lower(F.regexp_extract(t, r"^(\D*)", 1)),
        F.regexp_extract(t, r"(\d+)", 1).try_cast("decimal(38,0)"),
        t,
    ]
