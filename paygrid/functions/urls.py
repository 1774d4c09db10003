"""URL columns: posting keys, canonical URLs, archive URL rewrites, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the two boards and how a posting URL names company and id.
BOARDS = [
    # (board, host substring, path regex with (company, id) groups)
    ("ashby", "ashbyhq.com", r"^([^/]+)/([^/]+)"),
    ("greenhouse", "greenhouse.io", r"^([^/]+)/jobs/(\d+)"),
]
CANONICAL_URL = "https://job-boards.greenhouse.io/{company}/jobs/{job_id}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def posting_key(url, boards=BOARDS, strict: bool = False) -> Column:
    """struct(board, company, job_id) of a posting URL; first board wins.

    Unknown hosts give null in bulk mode and raise in strict mode.
    """
    u = _c(url)
    host = F.coalesce(F.lower(F.try_parse_url(u, F.lit("HOST"))), F.lit(""))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "^/+|/+$", "")
    out = None
    for board, needle, pat in boards:
        ok = host.contains(needle) & path.rlike(pat)
        val = F.struct(F.lit(board).alias("board"),
                       F.lower(F.regexp_extract(path, pat, 1)).alias("company"),
                       F.regexp_extract(path, pat, 2).alias("job_id"))
        out = F.when(ok, val) if out is None else out.when(ok, val)
    if strict:
        return out.otherwise(F.raise_error(F.concat(F.lit("Unsupported job board URL: "), u)))
    return out


def posting_url(company="company", job_id="job_id", template: str = CANONICAL_URL) -> Column:
    pre, rest = template.split("{company}")
    mid, post = rest.split("{job_id}")
    return F.concat(F.lit(pre), _c(company), F.lit(mid), _c(job_id), F.lit(post))


def ensure_query_param(url, param: str = "content=true") -> Column:
    u = _c(url)
    return F.when(u.contains(param), u).otherwise(
        F.concat(F.regexp_replace(u, "/+$", ""), F.lit("?" + param)))


def raw_snapshot_url(url) -> Column:
    return F.regexp_replace(_c(url), r"(web\.archive\.org/web/\d+)/", "$1id_/")


def company_label(path, suffix: str = "_salaries") -> Column:
    """File stem minus suffix, underscores to spaces, title case."""
    stem = F.regexp_extract(_c(path), r"([^/]*?)(\.[^./]*)?$", 1)
    return F.initcap(F.replace(F.replace(stem, F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" ")))
