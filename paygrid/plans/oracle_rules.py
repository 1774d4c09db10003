"""SQL (DuckDB / RE2) forms of the rule tables, for the oracle queries.

RE2 has no look-around and only ASCII ``\\b``.  Patterns are rewritten to
consuming equivalents that keep *existence* semantics, which is all a rule
test needs: a word boundary becomes "start, end or a non-word character"
(Unicode letters/digits/underscore count as word characters, as on the
Spark side), a trailing look-ahead is consumed, and the few patterns whose
look-around cannot be consumed get an explicit form below.
"""

from __future__ import annotations

import re

from paygrid import rules as R

NONWORD = r"[^\p{L}\p{N}_\n]"
# Java's Unicode white space (what ``(?U)\s`` matches on the Spark side)
WS_CLASS = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = "[" + WS_CLASS + "]"
WORD = r"[\p{L}\p{N}_]"


def _classes(p: str) -> str:
    r"""``\s`` and ``\w`` outside brackets -> explicit Unicode classes."""
    out, i, depth = [], 0, 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            tok = p[i:i + 2]
            if depth == 0 and tok == r"\s":
                out.append(WS)
            elif depth == 0 and tok == r"\w":
                out.append(WORD)
            else:
                out.append(tok)
            i += 2
            continue
        if ch == "[":
            depth += 1
        elif ch == "]" and depth:
            depth -= 1
        out.append(ch)
        i += 1
    return "".join(out)


BOUND = rf"(?:^|$|{NONWORD})"

# explicit RE2 forms where the generic rewrite would change the meaning
OVERRIDES = {
    # skills
    r"\bJava\b(?!Script)": r"\bJava\b",
    r"\bGit\b(?!Hub)": r"\bGit\b",
    r"\bC\+\+\b|\bC programming\b": rf"(?:^|{NONWORD})C\+\+[\p{{L}}\p{{N}}_]|\bC programming\b",
    # education: "\b" before a space look-ahead forbids the optional dot
    r"\bMaster'?s?\b|\bM\.?S\.?\b(?= in| degree)|\bMBA\b":
        r"\bMaster'?s?\b|\bM\.?S(?: in| degree)|\bMBA\b",
    r"\bBachelor'?s?\b|\bB\.?S\.?\b(?= in| degree)|\bB\.?A\.?\b(?= in| degree)|\bundergraduate degree\b":
        r"\bBachelor'?s?\b|\bB\.?S(?: in| degree)|\bB\.?A(?: in| degree)|\bundergraduate degree\b",
    # seniority: two boundaries at one position
    r"\b(lead\b|tech lead)\b": r"\b(lead|tech lead)\b",
}


def re2(pattern: str, ci: bool = True) -> str:
    p = OVERRIDES.get(pattern, pattern)
    p = p.replace(r"(?<!\w)", rf"(?:^|{NONWORD})").replace(r"(?!\w)", rf"(?:$|{NONWORD})")
    p = re.sub(r"\\b\(\?=", "(?:", p)
    p = p.replace(r"\b", BOUND)
    return ("(?mi)" if ci else "(?m)") + _classes(p)


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(col: str, pattern: str, ci: bool = True) -> str:
    return f"regexp_matches({col}, {q(re2(pattern, ci))})"


def _finance(col: str, pattern: str) -> str:
    # "tax" not followed by "onom": blank out "taxonom" first, then test
    p = pattern.replace(r"(?<!\w)tax(?!onom)", r"(?<!\w)tax")
    return rx(f"replace(lower({col}), 'taxonom', '_')", p)


def _security(col: str, pattern: str) -> str:
    alt = r"|offensive security(?!.*safeguards)"
    rest = pattern.replace(alt, "")
    return (f"({rx(col, rest)} or ({rx(col, 'offensive security')} and not "
            f"{rx(col, 'offensive security.*safeguards')}))")


def title_department_sql(col: str = "title") -> str:
    parts = [f"case when {col} is null then 'Other'"]
    for label, pattern in R.DEPARTMENT_RULES:
        if label == "Finance":
            cond = _finance(col, pattern)
        elif label == "Security":
            cond = _security(col, pattern)
        else:
            cond = rx(col, pattern)
        parts.append(f"when {cond} then {q(label)}")
    parts.append("else 'Other' end")
    return " ".join(parts)


def first_match_sql(col: str, rules, default: str | None, null_default: str | None = None,
                    ci: bool = True, empty_is_null: bool = False) -> str:
    parts = ["case"]
    if null_default is not None:
        cond = f"{col} is null" + (f" or {col} = ''" if empty_is_null else "")
        parts.append(f"when {cond} then {q(null_default)}")
    for label, pattern in rules:
        parts.append(f"when {rx(col, pattern, ci)} then {q(label)}")
    parts.append(f"else {q(default) if default is not None else 'null'} end")
    return " ".join(parts)


def normalize_department_sql(col: str = "department_raw") -> str:
    return first_match_sql(col, R.NORMALIZED_DEPARTMENT_RULES, "Other", "Other", empty_is_null=True)


def seniority_sql(col: str = "title") -> str:
    return first_match_sql(f"lower({col})", R.SENIORITY_RULES, "Mid-Level", "Mid-Level")


def work_mode_sql(col: str = "location") -> str:
    return (f"case when {col} is null then 'Unknown' when contains(lower({col}), 'remote') "
            f"then 'Remote-Friendly' else 'Office-Only' end")


def rate_sql(col: str = "currency") -> str:
    return ("case " + " ".join(f"when {col} = {q(k)} then {v}::double" for k, v in R.TO_USD.items())
            + " end")


def scope_sql(col: str = "description_md") -> str:
    d = f"lower({col})"
    terms = []
    groups = (R.BUILDER_PATTERNS, R.OWNER_PATTERNS, R.LEADER_PATTERNS, R.CONTRIBUTOR_PATTERNS)
    for w, pats in zip(R.SCOPE_WEIGHTS, groups):
        for p in pats:
            terms.append(f"(case when {rx(d, p, ci=False)} then {w} else 0 end)")
    total = f"{R.SCOPE_BASE} + " + " + ".join(terms)
    return f"case when {col} is null then {R.SCOPE_BASE} else greatest(0, least(10, {total})) end"


def content_family_sql(col: str = "title") -> str:
    anyhit = " or ".join(rx(col, p) for p in R.CONTENT_FAMILY_PATTERNS)
    return (f"case when {col} is null or {col} = '' then false "
            f"when {rx(col, R.CONTENT_FAMILY_EXCLUDE)} then false else ({anyhit}) end")


def flag_sql(col: str, pattern: str) -> str:
    return f"coalesce({rx(col, pattern)}, false)"


def seniority_rank_sql(col: str = "seniority") -> str:
    return ("case " + " ".join(f"when {col} = {q(s)} then {i + 1}" for i, s in enumerate(R.SENIORITY_ORDER))
            + " end")
