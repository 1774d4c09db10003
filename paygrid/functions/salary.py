"""Salary text: detection and the two parsers, as one struct expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions.regex import extract, first_match, jpat
from paygrid.functions.text import html_unescape, let, normalize_ws, strip_tags

RANGE = (f"{R.CURRENCY_SYMBOL}\\s*({R.NUMBER}){R.UNIT_SUFFIX}\\s*{R.DASH}\\s*"
         f"(?:{R.CURRENCY_SYMBOL}\\s*)?({R.NUMBER}){R.UNIT_SUFFIX}")
BARE_RANGE = f"({R.NUMBER})\\s*{R.DASH}\\s*({R.NUMBER})\\s*(USD|EUR|GBP|CAD|AUD)?"
SINGLE = f"{R.CURRENCY_SYMBOL}\\s*({R.NUMBER})"


def _amount(c: Column) -> Column:
    return (F.regexp_replace(c, ",", "")).try_cast("bigint")


def _symbol_currency(sym: Column) -> Column:
    m = F.create_map(*[x for k, v in R.SYMBOL_CURRENCY.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, sym)


def looks_like_salary(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(
        (t != "") & (t.rlike(jpat(RANGE, ci=False)) | t.rlike(jpat(R.CURRENCY_CODE, ci=False))),
        F.lit(False))


def parse_salary(text) -> Column:
    """struct(salary_text, currency, salary_min, salary_max, salary_unit)."""
    raw = F.col(text) if isinstance(text, str) else text
    return let(normalize_ws(html_unescape(raw)), _parsed)


def _first(block: Column, pattern: str, idx: int) -> Column:
    """Group of the first match, '' without one; bound by ``let`` where it is read more than once."""
    return F.regexp_extract(block, jpat(pattern, ci=False), idx)


def _parsed(block: Column) -> Column:
    """Each pattern runs at most once per group and only if those before it found nothing."""
    unit = F.when(block.isNotNull(), first_match(block, R.UNIT_RULES, None))

    def amounts(code: Column, r_min: Column, b_min: Column, s_val: Column) -> Column:
        has_r, has_b, has_s = r_min != "", b_min != "", s_val != ""
        currency = (F.when(code != "", code)
                    .when(has_r, _symbol_currency(F.nullif(_first(block, RANGE, 1), F.lit(""))))
                    .when(has_b, F.nullif(_first(block, BARE_RANGE, 3), F.lit("")))
                    .when(has_s, _symbol_currency(F.nullif(_first(block, SINGLE, 1), F.lit("")))))
        lo = F.when(has_r, _amount(r_min)).when(has_b, _amount(b_min)).when(has_s, _amount(s_val))
        hi = (F.when(has_r, _amount(_first(block, RANGE, 4))).when(has_b, _amount(_first(block, BARE_RANGE, 2)))
              .when(has_s, _amount(s_val)))
        return F.struct(block.alias("salary_text"), currency.alias("currency"),
                        lo.alias("salary_min"), hi.alias("salary_max"), unit.alias("salary_unit"))

    return let(_first(block, R.CURRENCY_CODE, 1), lambda code: let(_first(block, RANGE, 2), lambda r: let(
        F.when(r == "", _first(block, BARE_RANGE, 1)).otherwise(""), lambda b: let(
            F.when((r == "") & (b == ""), _first(block, SINGLE, 2)).otherwise(""), lambda s: amounts(code, r, b, s)))))


COMMA_RANGE = (f"[$£€]\\s*(\\d{{1,3}}(?:,\\d{{3}})+)\\s*{R.REPARSE_DASH}\\s*[$£€]?\\s*"
               f"(\\d{{1,3}}(?:,\\d{{3}})+)")
DOT_RANGE = (f"[$£€]\\s*(\\d{{1,3}}(?:\\.\\d{{3}})+)\\s*{R.REPARSE_DASH}\\s*[$£€]?\\s*"
             f"(\\d{{1,3}}(?:\\.\\d{{3}})+)")
CODE_RANGE = f"({R.NUMBER})\\s*{R.REPARSE_DASH}\\s*({R.NUMBER})\\s*(USD|EUR|GBP|CAD|AUD)"


def reparse_salary(text) -> Column:
    """The salary analysis's own parser: comma range, dotted range, coded bare range.

    Tags are stripped and references decoded first.
    """
    raw = F.col(text) if isinstance(text, str) else text
    return let(strip_tags(raw), _reparsed)


def _reparsed(plain: Column) -> Column:
    empty = plain.isNull() | (plain == "")
    unit = first_match(plain, R.REPARSE_UNIT_RULES, None)
    code = extract(plain, R.CURRENCY_CODE, 1, ci=False)
    first_sym = _symbol_currency(extract(plain, "[$£€]", 0, ci=False))
    c_min, c_max = extract(plain, COMMA_RANGE, 1, ci=False), extract(plain, COMMA_RANGE, 2, ci=False)
    d_min, d_max = extract(plain, DOT_RANGE, 1, ci=False), extract(plain, DOT_RANGE, 2, ci=False)
    k_min, k_max = extract(plain, CODE_RANGE, 1, ci=False), extract(plain, CODE_RANGE, 2, ci=False)
    k_code = extract(plain, CODE_RANGE, 3, ci=False)
    has_c, has_d, has_k = c_min.isNotNull(), d_min.isNotNull(), k_min.isNotNull()
    currency = (F.when(has_c | has_d, F.coalesce(code, first_sym))
                .when(has_k, k_code).otherwise(code))
    lo = (F.when(has_c, _amount(c_min)).when(has_d, (F.regexp_replace(d_min, "\\.", "")).try_cast("bigint"))
          .when(has_k, _amount(k_min)))
    hi = (F.when(has_c, _amount(c_max)).when(has_d, (F.regexp_replace(d_max, "\\.", "")).try_cast("bigint"))
          .when(has_k, _amount(k_max)))
    null = F.lit(None)
    return F.when(empty, F.struct(null.cast("bigint").alias("salary_min"), null.cast("bigint").alias("salary_max"),
                                  null.cast("string").alias("currency"), null.cast("string").alias("salary_unit"))
                  ).otherwise(F.struct(lo.alias("salary_min"), hi.alias("salary_max"),
                                       currency.alias("currency"), unit.alias("salary_unit")))
