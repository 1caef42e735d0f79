"""Text primitives. Patterns spell out their character classes, so that every regex dialect
(Java here, RE2 in the SQL checks) reads them alike. All results are text, missing text is ''."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, functions as F

# what Python's str methods call whitespace / what JavaScript's \s matches
PY_SPACE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
JS_SPACE = r"[\x{9}-\x{d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD = r"[\x{4e00}-\x{9fa5}A-Za-z0-9]"
PARENTHESISED = r"[（(]([^()（）]+)[）)]"
POI_PUNCTUATION = r"[()（）_\-—,，。.、]"


def text(c) -> Column:
    """Column as text with null read as ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """`body(v)` with v evaluated once. Written out, a value used n times is copied n times, and
    nested rules grow past what the code generator compiles."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c, space: str = PY_SPACE) -> Column:
    """Remove whitespace at both ends."""
    return F.regexp_replace(text(c), rf"^{space}+|{space}+\z", "")


def squeeze(c, space: str = PY_SPACE) -> Column:
    """Remove all whitespace."""
    return F.regexp_replace(text(c), space, "")


def blank_to_null(c) -> Column:
    return F.nullif(c, F.lit(""))


def is_empty(c: Column) -> Column:
    """Null, or text that is '', 'null' or 'none' after strip and lower."""
    return c.isNull() | F.lower(strip(c)).isin("", "null", "none")


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.when(~is_empty(c), c) for c in cols])


def join_non_empty(cols: list[Column], separator: str = "") -> Column:
    """Join what is not empty, each part stripped; null when nothing is left."""
    kept = F.filter(F.array(*[strip(c) for c in cols]), lambda t: ~F.lower(t).isin("", "null", "none"))
    return let(kept, lambda parts: F.when(F.size(parts) > 0, F.array_join(parts, separator)))


def join_parts(cols: list[Column]) -> Column:
    return F.concat_ws("", *[blank_to_null(c) for c in cols])


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def remove_first(c: Column, part: Column) -> Column:
    """`c` without the first occurrence of `part`; unchanged if `part` is '' or absent."""
    return replace_first(c, part, F.lit(""))


def replace_first(c: Column, part: Column, new: Column) -> Column:
    at = F.position(part, c)
    return F.when((F.length(part) == 0) | (at == 0), c).otherwise(F.overlay(c, new, at, F.length(part)))


def parenthesised(c: Column) -> Column:
    """Array of the non-blank stripped segments between () or （）, without nesting."""
    found = F.regexp_extract_all(text(c), F.lit(PARENTHESISED), F.lit(1))
    return F.filter(F.transform(found, lambda s: strip(s)), lambda s: s != "")


def without_parentheses(c: Column) -> Column:
    return F.regexp_replace(text(c), PARENTHESISED, "")


def normalize_poi(c) -> Column:
    """Place-name text reduced for containment tests."""
    return F.regexp_replace(squeeze(c, JS_SPACE), POI_PUNCTUATION, "")


def utf16_length(c: Column) -> Column:
    """Length as JavaScript counts it: characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def fold_case(c: Column) -> Column:
    """ASCII letters in lower case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fold_term(term: str) -> str:
    return term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def like_any_case(c: Column, term: str) -> Column:
    """`LIKE '%term%'` ignoring ASCII case; % and _ in the term stay wildcards, \\ is literal."""
    return fold_case(c).like("%" + fold_term(term).replace("\\", "\\\\") + "%")


def url_component(c: Column) -> Column:
    """Percent-encode as JavaScript's encodeURIComponent does."""
    encoded = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded
