"""Regex flag handling and literal prefilters for Spark (Java) patterns.

Patterns in ``paygrid.rules`` use Python semantics.  Java needs ``U``
(Unicode ``\\w \\s \\d`` and case folding) and ``d`` (``.`` stops only at
``\\n``) to behave the same; ``i`` is added for case-insensitive rules.

A Java regex scan costs ~30 ns per character and pattern, so a table of 46
patterns over long descriptions is dominated by rows that cannot match.
``required_literals`` finds, per alternative, a literal every match must
contain; ``matches``/``first_match`` test those with a byte ``contains`` on
case-folded text first and run the regex only on rows that pass.  The
prefilter is a necessary condition, so results are unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO_WIDTH = ("(?<!", "(?<=", "(?!", "(?=")
_CLASS_ESCAPES = set("dDwWsSpPnrtfvx")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written once in the plan and computed once per row."""
    return F.transform(F.array(value), body)[0]


def jpat(pattern: str, ci: bool = True, multiline: bool = False) -> str:
    flags = "i" if ci else ""
    flags += "m" if multiline else ""
    return f"(?{flags}Ud){pattern}"


def _group_end(p: str, i: int) -> int:
    """Index just past the group or class starting at p[i]."""
    close = ")" if p[i] == "(" else "]"
    depth, j = 0, i
    while j < len(p):
        c = p[j]
        if c == "\\":
            j += 2
            continue
        if close == "]":
            if c == "]" and j > i + 1:
                return j + 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return j + 1
        j += 1
    return len(p)


def _alternatives(p: str) -> list[str]:
    out, depth, start, i = [], 0, 0, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = _group_end(p, i)
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(p[start:i])
            start = i + 1
        i += 1
    out.append(p[start:])
    return out


def _skip_quantifier(alt: str, i: int) -> int:
    if i < len(alt) and alt[i] in "?*+":
        return i + 1
    if i < len(alt) and alt[i] == "{":
        return alt.index("}", i) + 1
    return i


def _longest_literal(alt: str) -> tuple[str, str | None]:
    """Longest run of characters every match of ``alt`` contains, and the
    body of the first mandatory group (used when no literal run exists)."""
    segs, cur, i, group = [], [], 0, None

    def cut():
        segs.append("".join(cur))
        cur.clear()

    while i < len(alt):
        c = alt[i]
        if alt.startswith(_ZERO_WIDTH, i):           # look-around: zero width
            i = _group_end(alt, i)
            continue
        if c == "\\":
            e = alt[i + 1] if i + 1 < len(alt) else ""
            if e in ("b", "B", "A", "z", "Z"):       # anchors: zero width
                i += 2
                continue
            if e.isalnum() or e in _CLASS_ESCAPES:   # a class, not a literal
                cut()
                i = _skip_quantifier(alt, i + 2)
                continue
            tok, i = e, i + 2
        elif c in "([":
            j = _group_end(alt, i)
            cut()
            optional = j < len(alt) and alt[j] in "?*"
            if c == "(" and not optional and group is None:
                body = alt[i + 1:j - 1]
                group = body[2:] if body.startswith("?:") else body
            i = _skip_quantifier(alt, j)
            continue
        elif c == ".":
            cut()
            i = _skip_quantifier(alt, i + 1)
            continue
        elif c in "^$":
            i += 1
            continue
        else:
            tok, i = c, i + 1
        q = alt[i] if i < len(alt) else ""
        if q and q in "?*":
            cut()
            i += 1
        elif q == "{":
            cut()
            i = alt.index("}", i) + 1
        elif q == "+":
            cur.append(tok)
            cut()
            i += 1
        else:
            cur.append(tok)
    cut()
    return (max(segs, key=len) if segs else ""), group


def required_literals(pattern: str, ci: bool = True) -> list[str] | None:
    """One literal per top-level alternative that every match contains, or
    None when some alternative has none (no prefilter then)."""
    lits: list[str] = []
    for alt in _alternatives(pattern):
        lit, group = _longest_literal(alt)
        if lit:
            lits.append(lit.lower() if ci else lit)
            continue
        inner = required_literals(group, ci) if group else None
        if not inner:
            return None
        lits.extend(inner)
    return sorted(set(lits))


def fold(col: Column) -> Column:
    """Lower case, with the letters that Java's case-insensitive matching folds
    onto ASCII letters replaced first (dotted I, long s, dotless i): ``lower``
    keeps two of them and makes two characters of the other."""
    return F.lower(F.translate(col, "İſı", "isi"))


def lowered(pattern: str) -> str:
    """A pattern in lower case, but for its escapes (``\\B`` is not ``\\b``)."""
    return re.sub(r"(\\(?:[pP]\{\w+\}|.))|[A-Z]", lambda m: m[1] or m[0].lower(), pattern)


def prefilter(text: Column, folded: Column | None, pattern: str, ci: bool) -> Column | None:
    lits = required_literals(pattern, ci)
    if not lits:
        return None
    base = (folded if folded is not None else fold(text)) if ci else text
    cond = None
    for lit in lits:
        c = base.contains(lit)
        cond = c if cond is None else (cond | c)
    return cond


def search(col: Column, pattern: str, ci: bool = True, folded: Column | None = None) -> Column:
    """``rlike`` guarded by the literal prefilter (same truth value).  Folded
    text, if given, is searched for the folded pattern: plain comparisons."""
    hit = folded.rlike(jpat(lowered(pattern), ci=False)) if ci and folded is not None else col.rlike(jpat(pattern, ci))
    pre = prefilter(col, folded, pattern, ci)
    return hit if pre is None else (pre & hit)


def matches(col: Column, pattern: str, ci: bool = True, folded: Column | None = None) -> Column:
    """Null-safe search: null input gives false (pandas ``na=False``)."""
    return F.coalesce(search(col, pattern, ci, folded), F.lit(False))


def first_match(col: Column, rules, default: str, ci: bool = True) -> Column:
    """Ordered (label, pattern) list folded into one CASE WHEN chain.

    Used on short fields (titles, department names, salary blocks): no
    prefilter, which would only grow the generated code."""
    expr = None
    for label, pattern in rules:
        cond = col.rlike(jpat(pattern, ci))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def extract(col: Column, pattern: str, idx: int = 0, ci: bool = True) -> Column:
    """First match group or null (``regexp_extract`` gives '' on no match)."""
    return F.nullif(F.regexp_extract(col, jpat(pattern, ci), idx), F.lit(""))
