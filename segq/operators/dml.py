"""Whole-frame rewrites, status counts, projects, pages of results."""

from segq.plans.core import relation


@relation("orders")
def status_counts(d):
    return "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus"


@relation("orders")
def status_pivot(d):
    return "SELECT o_orderpriority AS project, count_if(o_orderstatus = 'O') AS open_n, count_if(o_orderstatus = 'F') AS final_n, count_if(o_orderstatus = 'P') AS pending_n FROM orders GROUP BY o_orderpriority"


@relation("customer", "orders")
def project_stats(d):
    """Per project; projects without segments stay, with nothing known of them."""
    done = d.count_if("o.o_orderstatus = 'F'")
    return f"SELECT c.c_custkey AS project, count(o.o_orderkey) AS segments, {done} AS confirmed, CAST(floor(100 * {done} / greatest(count(o.o_orderkey), 1)) AS INT) AS percent FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey"


@relation("orders")
def progress_stats(d):
    return "SELECT count(*) AS total, count_if(o_orderstatus <> 'O') AS done, round(100 * count_if(o_orderstatus <> 'O') / (count(*) * 1e0), 1) AS percent FROM orders"


@relation("lineitem")
def segment_status_update(d):
    """Dynamic update as a rewrite: rows of the patch win."""
    return "SELECT b.l_orderkey, b.l_linenumber, coalesce(p.status, b.l_linestatus) AS status FROM lineitem b LEFT JOIN (SELECT l_orderkey, l_linenumber, 'confirmed' AS status FROM lineitem WHERE l_returnflag = 'R') p ON b.l_orderkey = p.l_orderkey AND b.l_linenumber = p.l_linenumber"


@relation("customer", "orders")
def cascade_delete(d):
    """Orders left after the customers of one segment are deleted."""
    return "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')"


@relation("orders")
def revert_status(d):
    return "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'translated' WHEN 'P' THEN 'new' ELSE o_orderstatus END AS status FROM orders"


@relation("segments")
def search_page(d):
    return "SELECT id, substring(source_text, 1, 60) AS preview FROM segments WHERE contains(lower(source_text), 'the') OR contains(lower(project), 'src1') ORDER BY segment_order LIMIT 20 OFFSET 40"


@relation("segments", "glossary")
def search_palette(d):
    return "SELECT kind, name FROM (SELECT 'segment' AS kind, substring(source_text, 1, 40) AS name, 1 AS o, id AS k FROM segments WHERE contains(lower(source_text), 'tion') UNION ALL SELECT 'term' AS kind, term AS name, 0 AS o, 0 AS k FROM glossary WHERE contains(term, 'an')) u ORDER BY o, k, name LIMIT 20"


@relation("segments")
def page_info(d):
    return "SELECT count(*) AS n, CAST(ceil(count(*) / 2e1) AS BIGINT) AS pages, CAST(least(3, ceil(count(*) / 2e1)) AS BIGINT) AS current_page FROM segments"


@relation("segments")
def segments_by_project(d):
    return "SELECT id, segment_order FROM segments WHERE project = 'src3' ORDER BY segment_order"


@relation("segments")
def word_totals(d):
    return f"SELECT project, sum({d.size(d.words('source_text'))}) AS words, sum(length(source_text)) AS chars FROM segments GROUP BY project"


@relation("events")
def event_alert_stats(d):
    return "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"


@relation("segments")
def sample_first(d):
    return "SELECT id, rn <= 500 AS in_sample FROM (SELECT id, row_number() OVER (PARTITION BY project ORDER BY segment_order) AS rn FROM segments) t"
