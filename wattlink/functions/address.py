"""Address fragments out of company names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wattlink import constants as K
from wattlink.functions.text import WORD, contains_any, let, replace_first, squeeze, text


def has_signal(c: Column) -> Column:
    return contains_any(c, K.ADDRESS_SIGNALS)


def without_noise(c) -> Column:
    """Drop project words and voltages, in list order and ignoring case, then list punctuation."""
    out = squeeze(c)
    for pattern in K.NOISE_PATTERNS:
        out = F.regexp_replace(out, "(?iu)" + pattern, "")
    return squeeze(F.regexp_replace(out, "[、，,;；]+", ""))


def _first_name(c: Column, test) -> Column:
    """1-based position of the first county name that passes, null if none does."""
    names = enumerate(K.COUNTY_FULL_NAMES.items(), start=1)
    return F.coalesce(*[F.when(test(c, short, full), F.lit(i)) for i, (short, full) in names])


def hint_position(region: Column, c: Column) -> Column:
    """Which known county the text names in short form only; null outside the hinted region."""
    at = _first_name(c, lambda t, short, full: t.contains(short) & ~t.contains(full))
    return F.when(squeeze(region) == K.COUNTY_HINT_REGION, at)


def short_name(at: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in K.COUNTY_FULL_NAMES]), at)


def full_name(at: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n in K.COUNTY_FULL_NAMES.values()]), at)


def county_hint(region: Column, c: Column) -> Column:
    """Complete the first known short county name that lacks its full form."""
    filled = let(hint_position(region, c), lambda at: replace_first(c, short_name(at), full_name(at)))
    return F.coalesce(filled, c)


def known_county(c: Column) -> Column:
    """First full county name contained in the text, else ''."""
    at = _first_name(c, lambda t, short, full: t.contains(full))
    return text(full_name(at))


def segment(c: Column, suffixes: list[str]) -> Column:
    """For each suffix the leftmost, shortest run ending in it; of those the longest, the first
    listed on ties; '' if there is none."""
    ranked = []
    for i, suffix in enumerate(suffixes):
        run = F.when(c.contains(suffix), F.regexp_extract(c, f"{WORD}+?{suffix}", 0)).otherwise("")
        ranked.append(F.struct(F.length(run).alias("n"), F.lit(-i).alias("i"), run.alias("run")))
    return F.array_max(F.array(*ranked))["run"]


def house_number(c: Column) -> Column:
    return F.regexp_extract(text(c), r"\p{Nd}+(?:-\p{Nd}+)?号", 0)
