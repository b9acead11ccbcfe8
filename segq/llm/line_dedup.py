"""Site-relative line dedup; DataFrame functions only.

A page's html becomes lines natively: scripts, styles and comments go, block
tags end a line, other tags vanish, white space is squeezed.  Pages are parsed
once; their lines are written.  Pages that hold a line are counted per
(host, line) with map-side combine, divided by the host's pages, and lines
above ``max_ratio`` are dropped from that host's pages; lines of fewer than
``min_copies`` pages are no candidates and leave before the counts meet the
hosts' totals, in a join salted by line.  A host has at most (mean lines a page) / max_ratio such lines, so they
travel as one array per host; page text is never shuffled while those arrays
stay under ``broadcast_lines`` in all (counted), and beyond that pages meet
them in a join salted by page id, so that one large host is spread.

Defined results: null html has no lines; null or odd urls share the host '';
a line repeated inside one page counts once; a line on one page only stays,
so hosts of one page keep all lines; repeated rows are pages of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segq.llm.common import written

MAX_RATIO, MIN_COPIES, BROADCAST_LINES, SALTS = 0.3, 2, 50_000, 32
#: (pattern, replacement) in order; both Java and RE2 read them alike.
STEPS = (
    (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<style\b.*?</style\s*>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"[ \t\r\f]+", " "),
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def html_lines(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern, put in STEPS:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def boilerplate(pages: DataFrame, max_ratio: float, min_copies: int) -> DataFrame:
    """(host, lines): digests of the host's lines above the ratio."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages")).select("*", salts)
    counts = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", F.unhex(F.md5("line")).alias("digest")).agg(F.count("*").alias("n"))
    counts = counts.filter(F.col("n") >= min_copies).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    return counts.join(totals, ["host", "salt"]).filter(F.col("n") > max_ratio * F.col("host_pages")).groupBy("host").agg(F.collect_list("digest").alias("common"))


def line_dedup(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_ratio: float = MAX_RATIO, min_copies: int = MIN_COPIES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """One row per page: id, host, n_lines, n_dropped, text of kept lines."""
    base = written(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), html_lines(F.col(html_col)).alias("lines")), "lines")
    common = written(boilerplate(base, max_ratio, min_copies), "common-lines")
    if (common.agg(F.sum(F.size("common"))).first()[0] or 0) <= broadcast_lines:
        joined = base.join(F.broadcast(common), "host", "left")
    else:
        salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    common_or_none = F.coalesce(F.col("common"), F.array().cast("array<binary>"))
    kept = joined.withColumn("kept", F.filter("lines", lambda x: ~F.array_contains(common_or_none, F.unhex(F.md5(x)))))
    return kept.select(
        "page_id", "host", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"), F.array_join("kept", "\n").alias("text")
    )


def _sql() -> str:
    text = "coalesce(html, '')"
    for pattern, put in STEPS:
        text = f"regexp_replace({text}, '{pattern}', {'chr(10)' if put == chr(10) else repr(put)}, 'g')"
    return f"""
WITH base AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
       list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
totals AS (SELECT host, count(*) AS host_pages FROM base GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM base) GROUP BY host, line),
bad AS (SELECT host, list(line) AS common FROM counts JOIN totals USING (host)
        WHERE n >= {MIN_COPIES} AND n > CAST({MAX_RATIO} AS DOUBLE) * host_pages GROUP BY host),
kept AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM base LEFT JOIN bad USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text FROM kept
"""


SQL = _sql()
