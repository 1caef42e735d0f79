"""Reading values out of JSON documents held as VARIANT columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

from wattlink.functions.measure import format_number, power_type
from wattlink.functions.text import is_empty, join_non_empty, let, strip


def document(text: Column) -> Column:
    """Parse JSON text; broken text gives null."""
    return F.try_parse_json(text)


def _spellings(path: str) -> list[str]:
    """A numeric segment is a list index or, on objects, a key: all readings of the path."""
    options = []
    for segment in str(path).split("."):
        key = "['" + segment.replace("\\", "\\\\").replace("'", "\\'") + "']"
        options.append([f"[{int(segment)}]", key] if segment.isdigit() and segment.isascii() else [key])
    return ["$" + "".join(parts) for parts in product(*options)]


def value_at(doc: Column, path: str | None, as_type: str = "variant") -> Column:
    """Value at a dotted path, null where the path is missing; an empty path is the document."""
    if not path:
        return F.try_variant_get(doc, "$", as_type)
    found = [F.try_variant_get(doc, p, as_type) for p in _spellings(path)]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def as_text(v: Column) -> Column:
    """A variant as text. Truth values print as True / False, JSON null is null."""
    def printed(v: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(plain)).otherwise(plain)

    return let(v, printed)


def mapped_text(doc: Column, entry) -> Column:
    """Evaluate one mapping entry: a path, a list of paths (first non-empty), or
    {mode: concat | first_non_empty, paths, separator}."""
    if isinstance(entry, str):
        return as_text(value_at(doc, entry))
    if isinstance(entry, list) and entry:
        return _first(doc, entry)
    if isinstance(entry, dict) and isinstance(entry.get("paths"), list) and entry["paths"]:
        if entry.get("mode", "first_non_empty") == "concat":
            return join_non_empty([as_text(value_at(doc, p)) for p in entry["paths"]], entry.get("separator", ""))
        return _first(doc, entry["paths"])
    return F.lit(None).cast("string")


def _first(doc: Column, paths: list[str]) -> Column:
    return F.coalesce(*[let(as_text(value_at(doc, p)), lambda v: F.when(~is_empty(v), v)) for p in paths])


def mapped_power_type(doc: Column, entry, lookup: dict[str, str]) -> Column:
    """Power type of a mapping entry. Numbers are read as printed integers; of a list, the first
    item that resolves wins."""
    if isinstance(entry, dict) and entry.get("mode") == "concat":
        return power_type(mapped_text(doc, entry), lookup)
    paths = entry if isinstance(entry, list) else entry.get("paths", []) if isinstance(entry, dict) else [entry]
    paths = [p for p in paths if p]
    if not paths:
        return F.lit(None).cast("string")
    chosen = [value_at(doc, p) for p in paths]
    if len(chosen) > 1:
        chosen = [F.coalesce(*[F.when(~is_empty(as_text(v)), v) for v in chosen])]
    value = chosen[0]
    # a single value is read as a list of one
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
    resolved = F.transform(items, lambda v: power_type(_code_text(v), lookup))
    return F.get(F.filter(resolved, lambda t: t.isNotNull()), F.lit(0))


def _code_text(v: Column) -> Column:
    def by_kind(kind: Column) -> Column:
        numeric = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN")
        return F.when(numeric, format_number(F.try_variant_get(v, "$", "double"))).otherwise(
            F.try_variant_get(v, "$", "string")
        )

    return let(F.schema_of_variant(v), by_kind)


def clean_field(c: Column) -> Column:
    """Stripped text, null when empty."""
    return let(strip(c), lambda t: F.when(~F.lower(t).isin("", "null", "none"), t))
