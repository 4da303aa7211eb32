"""Builders of DuckDB text for check results."""

from __future__ import annotations

HTML = "(lower(content_type) LIKE '%text/html%' OR lower(content_type) LIKE '%application/xhtml%')"
OK = f"({HTML} AND status_code >= 200 AND status_code < 300 AND coalesce(initial_status_code, status_code) >= 200 AND coalesce(initial_status_code, status_code) < 300)"
CONTENT = f"({OK} AND indexable = 1 AND coalesce(page_type, 'other') <> 'legal')"
COMPLETE = "(metadata_complete = 1)"
SETTLED = "(render_status = 'success' AND settling_status IN ('settled', 'content_remained_empty'))"
ROBOTS = "lower(concat(coalesce(meta_robots, ''), ' ', coalesce(x_robots_tag, '')))"


def check(
    check_id: str,
    table: str,
    measures: dict[str, str],
    state: str,
    affected: str,
    sample: str | None,
    fail: str = "'Warning'",
    evidence: tuple[str, ...] = (),
    url: str = "url",
    with_evidence: bool = True,
) -> str:
    """One result row per run: counts of the measures, then state, status, count and ten sample URLs."""
    counts = ", ".join(f"count_if({text}) AS {name}" for name, text in measures.items())
    filled = ", ".join(f"coalesce(a.{name}, 0) AS {name}" for name in measures)
    note = " || ';' || ".join(f"'{name}=' || CAST({name} AS VARCHAR)" for name in evidence) or "''"
    if sample:
        rows = f"""SELECT run_id, string_agg(u, ' | ' ORDER BY u) AS urls FROM (
          SELECT run_id, u, row_number() OVER (PARTITION BY run_id ORDER BY u) AS rn
          FROM (SELECT DISTINCT run_id, {url} AS u FROM {table} WHERE {sample}) d) r WHERE rn <= 10 GROUP BY run_id"""
    else:
        rows = "SELECT NULL AS run_id, NULL AS urls WHERE false"
    evidence_text = f", {note} AS evidence" if with_evidence else ""
    return f"""SELECT run_id, '{check_id}' AS check_id, st AS evaluation_state,
      CASE st WHEN 'pass' THEN 'OK' WHEN 'fail' THEN {fail} ELSE 'NA' END AS status,
      CAST(n AS BIGINT) AS affected_count{evidence_text}, CASE WHEN n > 0 THEN coalesce(urls, '') ELSE '' END AS sample_urls
    FROM (SELECT z.*, {affected} AS n FROM (SELECT y.*, {state} AS st FROM (
      SELECT r.*, coalesce(a.rows_total, 0) AS rows_total, {filled}, s.urls FROM site_runs r
      LEFT JOIN (SELECT run_id, count(*) AS rows_total, {counts} FROM {table} GROUP BY run_id) a ON a.run_id = r.run_id
      LEFT JOIN ({rows}) s ON s.run_id = r.run_id) y) z) x"""


def state_case(*steps: tuple[str, str], last: str = "pass") -> str:
    if not steps:
        return f"'{last}'"
    whens = " ".join(f"WHEN {condition} THEN '{state}'" for condition, state in steps)
    return f"CASE {whens} ELSE '{last}' END"


FAILED = "CASE WHEN st = 'fail' THEN {0} ELSE 0 END"


def failed(name: str) -> str:
    return FAILED.format(name)


def issue(check_id, hit, scope=None, pending=None, gate=None, empty="not_applicable", needs_rows=False, table="site_pages", **options):
    measures = {"hit": hit}
    steps = []
    if gate:
        steps.append((f"{gate} = 0", "not_executed"))
    if needs_rows:
        steps.append(("rows_total = 0", "insufficient_evidence"))
    if scope:
        measures["scope"] = scope
        steps.append(("scope = 0", empty))
    steps.append(("hit > 0", "fail"))
    if pending:
        measures["open"] = pending
        steps.append(("open > 0", "insufficient_evidence"))
    return check(check_id, table, measures, state_case(*steps), failed("hit"), hit, **options)


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
