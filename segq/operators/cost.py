"""Token and cost arithmetic."""

from segq.functions import lexicons as L
from segq.plans.core import relation


@relation("routed", query=False)
def routed_tokens(d):
    """Segments with their route, for costs by route in the same pass."""
    return "SELECT id, source_text, route, level FROM routed"


@relation("segments", query=False)
def token_base(d):
    return token_columns(d, "SELECT id, source_text FROM segments")


@relation("routed_tokens", query=False)
def routed_base(d):
    return token_columns(d, "SELECT id, source_text, route, level FROM routed_tokens")


def token_columns(d, rows):
    na = f"length({d.sub('source_text', '[\\x00-\\x7F]+', '')})"
    return f"SELECT t.*, CAST(floor(floor(b * 13e-1) * 12e-1) AS BIGINT) AS ot, CAST(floor(b * 12e-1) AS BIGINT) AS oq, length(trim(source_text)) AS n_chars FROM (SELECT r.*, CASE WHEN trim(source_text) = '' THEN 0 ELSE greatest(1, CAST(floor({na} / 32e-1 + (length(source_text) - {na}) / 4e0) AS BIGINT)) END AS b FROM ({rows}) r) t"


@relation("token_base")
def token_estimate(d):
    """Tokens in and out of each step; blank texts cost nothing."""
    return f"SELECT id, {estimates()}, n_chars FROM token_base"


def estimates():
    z = lambda e: f"CASE WHEN b = 0 THEN 0 ELSE {e} END"
    return f"{z('b + 400')} AS translate_in, {z('ot + 100')} AS translate_out, {z('b + oq + 1000')} AS qa_in, {z('CAST(floor((b + oq) * 4e-1) AS BIGINT) + 200')} AS qa_out, {z('oq + 1000')} AS backcheck_in, {z('b + 100')} AS backcheck_out, {z('b + 700')} AS safety_in, {z('300')} AS safety_out"


@relation("token_estimate", query=False)
def step_cost(d):
    return f"SELECT id, {costs()} FROM token_estimate"


def price(name: str) -> str:
    """US dollars a million: the override of the run, else the default."""
    return f"{float(dict(L.PRICES, **{k: v for k, v in dict(L.PRICE_OVERRIDES).items() if k in dict(L.PRICES)})[name])!r}e0"


def costs():
    usd = lambda s: f"floor(({s}_in * {price(s + '_in')} + {s}_out * {price(s + '_out')} + 50) / 1e2) / 1e4 AS {s}_usd"  # noqa: E731  half up, in whole hundredths of a cent
    return f"{usd('translate')}, {usd('qa')}, {usd('backcheck')}, {usd('safety')}, floor((n_chars * {price('mt')} + 50) / 1e2) / 1e4 AS mt_usd, translate_in + translate_out + qa_in + qa_out + backcheck_in + backcheck_out + safety_in + safety_out AS total_tokens"


@relation("step_cost")
def cost_estimate(d):
    return "SELECT id, total_tokens, translate_usd, qa_usd, backcheck_usd, safety_usd, mt_usd, round(translate_usd + qa_usd + backcheck_usd + safety_usd, 4) AS total_usd FROM step_cost"


BASELINE = "translate_usd + qa_usd + CASE WHEN r.level IN ('HIGH', 'CRITICAL') THEN backcheck_usd ELSE 0e0 END + CASE WHEN r.level = 'CRITICAL' THEN safety_usd ELSE 0e0 END"


def optimised():
    """Cost of a priced row r by its route."""
    gpt = "r.route NOT IN ('EXACT_TM', 'DUPLICATE_PROPAGATION_PENDING', 'HUMAN_REVIEW_REQUIRED', 'GOOGLE_SAFE', 'DUPLICATE_REPRESENTATIVE')"
    return f"CASE WHEN r.route = 'GOOGLE_SAFE' THEN mt_usd WHEN r.route = 'DUPLICATE_REPRESENTATIVE' THEN translate_usd WHEN {gpt} THEN {BASELINE} ELSE 0e0 END"


@relation("routed_base", query=False)
def routed_cost(d):
    return f"""SELECT r.id, r.route, r.level, r.total_tokens, {BASELINE} AS baseline, {optimised()} AS optimised,
CASE WHEN r.route = 'EXACT_TM' THEN translate_usd + qa_usd ELSE 0e0 END AS saved_tm, CASE WHEN r.route = 'DUPLICATE_PROPAGATION_PENDING' THEN translate_usd + qa_usd ELSE 0e0 END AS saved_duplicate, CASE WHEN r.route = 'GOOGLE_SAFE' THEN translate_usd - mt_usd ELSE 0e0 END AS saved_mt, CASE WHEN r.route = 'DUPLICATE_REPRESENTATIVE' THEN qa_usd ELSE 0e0 END AS saved_adaptive
FROM (SELECT id, route, level, {costs()} FROM (SELECT id, route, level, {estimates()}, n_chars FROM routed_base) e) r"""


@relation("routed_cost")
def cost_by_route(d):
    return "SELECT id, route, round(optimised, 4) AS usd FROM routed_cost"


@relation("routed_cost")
def cost_rollup(d):
    """Totals and per-route sums in one rollup; route is null in the total."""
    return "SELECT route, count(*) AS n, sum(total_tokens) AS tokens, round(sum(baseline), 2) AS baseline_usd, round(sum(optimised), 2) AS optimised_usd, round(sum(saved_tm), 2) AS saved_tm, round(sum(saved_duplicate), 2) AS saved_duplicate, round(sum(saved_mt), 2) AS saved_mt, round(sum(saved_adaptive), 2) AS saved_adaptive, round(100 * (1 - sum(optimised) / sum(baseline)), 1) AS saved_percent FROM routed_cost GROUP BY ROLLUP (route)"


@relation("routed")
def web_cost_model(d):
    return "SELECT route, sum(n_words) AS words, round(sum(n_words * 2e-3), 2) AS baseline, round(sum(n_words * CASE WHEN route IN ('EXACT_TM', 'DUPLICATE_PROPAGATION_PENDING') THEN 0e0 WHEN route = 'GOOGLE_SAFE' THEN 2e-4 ELSE 2e-3 END), 2) AS optimised FROM routed GROUP BY route"


@relation("route_decision", "segments")
def batch_groups(d):
    bucket = "CASE WHEN r.n_chars < 100 THEN 'short' WHEN r.n_chars < 300 THEN 'medium' WHEN r.n_chars < 500 THEN 'long' ELSE 'very_long' END"
    return f"SELECT r.route, r.level, s.block_type, {bucket} AS bucket, count(*) AS n FROM route_decision r JOIN segments s ON r.id = s.id GROUP BY r.route, r.level, s.block_type, {bucket}"
