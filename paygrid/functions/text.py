"""Text columns: whitespace, entities, markup, experience, shape."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions.regex import extract, fold, jpat, let

# Named references come from the standard table: with a semicolon all of them,
# without one only the old names that the table lists so.
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
# numbers that stand for another character: 128-159 as in Windows-1252, 0 and surrogates as U+FFFD
_CP1252 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def neighbour_groups(values: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """``array<struct<first, n>>`` of a sorted array: the first element of each
    group of neighbours with equal ``key``, and how many they are.  In-row, so
    that counting inside a row needs no shuffle."""
    def group(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (key(F.get(v, i)) != key(F.get(v, i - 1))))
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(v, i).alias("first"), (F.coalesce(F.get(s, k + 1), F.size(v)) - i).alias("n"))))
    return let(values, group)


def normalize_ws(c) -> Column:
    """Collapse every whitespace run (incl. U+00A0) to one space, strip."""
    return F.trim(F.regexp_replace(_c(c), "(?U)\\s+", " "))


def _map(pairs: dict) -> Column:
    """A constant map, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _numeric(digits: Column, base: int) -> Column:
    n = F.conv(F.substring(digits, 1, 12), base, 10).cast("bigint")
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("\ufffd")).when(n.between(128, 159), F.try_element_at(_map(_CP1252), n.cast("string"))).otherwise(char)


def _decoded(piece: Column) -> Column:
    """What follows an ampersand, with the reference at its start decoded."""
    rest = lambda pattern: F.regexp_replace(piece, pattern, "")
    dec, hexa = F.regexp_extract(piece, "^#([0-9]+)", 1), F.regexp_extract(piece, "^#[xX]([0-9a-fA-F]+)", 1)
    full = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
    named = F.try_element_at(_map(_NAMED), full)
    bare = F.regexp_extract(piece, "^(" + "|".join(_BARE) + ")", 1)
    return (F.when(dec != "", F.concat(_numeric(dec, 10), rest("^#[0-9]+;?")))
            .when(hexa != "", F.concat(_numeric(hexa, 16), rest("^#[xX][0-9a-fA-F]+;?")))
            .when(named.isNotNull(), F.concat(named, rest("^[A-Za-z0-9]+;")))
            .when(bare != "", F.concat(F.try_element_at(_map({k: html5[k] for k in _BARE}), bare),
                                       F.substr(piece, F.length(bare) + 1)))
            .otherwise(F.concat(F.lit("&"), piece)))


def html_unescape(c) -> Column:
    """Decode all character references once: named, decimal, hexadecimal."""
    parts = F.split(_c(c), "&", -1)
    decoded = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(_decoded(p)))
    return F.when(_c(c).contains("&"), F.array_join(decoded, "")).otherwise(_c(c))


def strip_tags(c) -> Column:
    """Markup to text: comments, script/style bodies and tags become spaces,
    then references are decoded and white space is collapsed."""
    h = F.regexp_replace(_c(c), "(?s)<!--.*?-->", " ")
    for tag in ("script", "style"):
        h = F.regexp_replace(h, f"(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>", " ")
    # a tag starts with a letter, / ! or ?: a lone < is text
    return normalize_ws(html_unescape(F.regexp_replace(h, "(?s)<[a-zA-Z/!?][^>]*>", " ")))


def html_to_text(c) -> Column:
    """Text of (possibly escaped) markup: decode, strip, decode."""
    return strip_tags(html_unescape(c))


def extract_yoe_max(desc="description_md") -> Column:
    """Max of the leading numbers of every experience mention, kept in 1..25."""
    d = _c(desc)
    found = F.regexp_extract_all(d, F.lit(jpat(R.YOE_PATTERN)), F.lit(1))
    nums = F.transform(found, lambda x: (x).try_cast("int"))
    kept = F.filter(nums, lambda x: (x >= R.YOE_MIN) & (x <= R.YOE_MAX))
    # every match contains "year": skip the regex scan for rows without it
    return F.when(fold(d).contains("year"), F.array_max(kept))


def extract_yoe_first(desc="description_md") -> Column:
    """First ``N years`` (case-sensitive, unbounded)."""
    return extract(_c(desc), R.YOE_FIRST_PATTERN, 1, ci=False).try_cast("bigint")


def word_count(desc="description_md") -> Column:
    d = _c(desc)
    return F.when(d.isNotNull(), F.size(F.filter(F.split(d, "(?U)\\s+"), lambda x: x != "")))


def bullet_count(desc="description_md") -> Column:
    return F.regexp_count(_c(desc), F.lit(jpat("^\\s*[\\*\\-]\\s", ci=False, multiline=True)))


def text_shape(desc="description_md") -> dict[str, Column]:
    d = _c(desc)
    return {"desc_len": F.length(d), "desc_words": word_count(d), "n_bullets": bullet_count(d)}
