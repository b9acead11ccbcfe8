"""Rows out of html pages by rules: links, list rows, file names."""

from segq.plans.core import relation


@relation("pages")
def html_links(d):
    """Absolute links of the list items of a page."""
    host = d.ext("url", "^([a-z]+://[^/]+)")
    return f"SELECT page_id, {host} || {d.ext('x', 'href=\"([^\"]*)\"')} AS link, trim({d.sub('x', '<[^>]*>', '')}) AS label FROM (SELECT page_id, url, {d.explode(d.all('html', '<li><a href=\"[^\"]*\">[^<]*</a></li>'))} AS x FROM pages) t"


@relation("html_links")
def pdf_link(d):
    return f"SELECT page_id, min(CASE WHEN {d.ends('lower(link)', "'.pdf'")} THEN link END) AS pdf, count(*) AS links FROM html_links GROUP BY page_id"


@relation("pages")
def html_rows(d):
    return f"SELECT page_id, {d.size(d.all('html', '<tr[ >]'))} AS n_rows, {d.size(d.all('html', '<p>'))} AS n_paragraphs, trim({d.sub(d.ext('html', '<title>([^<]*)</title>'), '&[a-z]+;', ' ')}) AS title FROM pages"


@relation("pages")
def safe_filename(d):
    return f"SELECT page_id, {d.sub(d.sub(d.ext('html', '<title>([^<]*)</title>'), '[^A-Za-z0-9 ]+', ''), ' +', '_')} AS file_name FROM pages"
