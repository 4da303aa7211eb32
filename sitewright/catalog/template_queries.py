"""Queries over canonicals, duplicate heads, URL templates and sampled performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitewright.catalog import inputs
from sitewright.catalog.oracle import COMPLETE, CONTENT, HTML, OK, ROBOTS, check, failed, state_case, union
from sitewright.catalog.page_queries import _typed
from sitewright.catalog.site_views import Site, with_views
from sitewright.operators import canonical as CA
from sitewright.operators import head as HD
from sitewright.operators import templates as TP

QUERIES = {}
ORACLE = {}
NF, IE, FAIL = "not_applicable", "insufficient_evidence", "fail"


def _simple(build):
    return lambda spark, folder: build(Site(spark, folder))


# Comparable form of the canonical values that occur in the derived pages.
def _norm(text):
    return f"regexp_replace(regexp_replace({text}, '[?]utm_source=feed$', ''), '/$', '')"


EVALUATED = f"""(SELECT e.*, len(vals) AS n, (len(vals) = 1 AND vals[1] = expected) AS is_self, len(list_filter(vals, lambda v: v LIKE 'https://partner-shop.test/%')) AS foreign_n FROM (
  SELECT *, {_norm('final_url')} AS expected, CASE WHEN canonical_values IS NULL THEN [] ELSE list_sort(list_distinct(list_transform(string_split(canonical_values, ' '), lambda v: {_norm('v')}))) END AS vals
  FROM site_pages) e)"""
SCOPE = f"(SELECT * FROM {EVALUATED} q0 WHERE {CONTENT})"

QUERIES["canonical_evaluation"] = _simple(lambda s: CA.evaluate(CA.in_scope(inputs.pages(s))).select(
    "page_id", "expected_canonical", F.array_join(F.array_sort("canonicals"), " ").alias("canonicals"), "canonical_missing", "canonical_conflict", "canonical_repeated", "canonical_self", F.size("canonical_foreign").alias("foreign_count"), "canonical_issue"))
ORACLE["canonical_evaluation"] = f"""SELECT page_id, expected AS expected_canonical, array_to_string(vals, ' ') AS canonicals, n = 0 AS canonical_missing, n > 1 AS canonical_conflict,
  (canonical_values LIKE '% %' AND n = 1) IS TRUE AS canonical_repeated, coalesce(is_self, false) AS canonical_self, CAST(foreign_n AS INT) AS foreign_count,
  CASE WHEN n > 1 THEN 'conflicting_canonical_tags' WHEN n = 1 AND vals[1] <> expected THEN 'non_self' WHEN n = 1 THEN 'self' ELSE 'missing' END AS canonical_issue FROM {SCOPE} q"""


def _canonical_check(check_id, test):
    hit = f"{COMPLETE} AND {test}"
    return check(check_id, f"{SCOPE} q", {"scope": "true", "hit": hit, "open": f"NOT {COMPLETE}"}, state_case(("scope = 0", NF), ("hit > 0", FAIL), ("open > 0", IE)), failed("hit"), hit)


QUERIES["checks_canonical"] = _simple(lambda s: inputs.flat_results(CA.canonical_results(inputs.pages(s), s.table("site_runs"))))
ORACLE["checks_canonical"] = union([
    _canonical_check("tech.canonical_missing", "n = 0"), _canonical_check("tech.canonical_non_self", "n > 0 AND (NOT is_self OR n > 1)"), _canonical_check("tech.canonical_to_other_domain", "foreign_n > 0"),
])

TARGETS = f"""(SELECT e.*, t.status_code AS ts, t.initial_status_code AS ti, t.content_type AS tc FROM (SELECT *, unnest(vals) AS canonical FROM {SCOPE} q1 WHERE {COMPLETE}) e
  LEFT JOIN (SELECT run_id AS r2, k, min_by(struct_pack(status_code := status_code, initial_status_code := initial_status_code, content_type := coalesce(content_type, '')), rk * 1000000000 + page_id) AS tt FROM (
    SELECT run_id, page_id, status_code, initial_status_code, content_type, {_norm("regexp_replace(url, '#.*$', '')")} AS k, 0 AS rk FROM site_pages
    UNION ALL SELECT run_id, page_id, status_code, initial_status_code, content_type, {_norm('final_url')}, 1 FROM site_pages) u GROUP BY 1, 2) j ON j.r2 = e.run_id AND j.k = e.canonical, LATERAL (SELECT j.tt.status_code AS status_code, j.tt.initial_status_code AS initial_status_code, j.tt.content_type AS content_type) t)"""
KNOWN = "ts IS NOT NULL"
BADT = "(ts IS NOT NULL AND (ti BETWEEN 300 AND 399 OR ts <> 200 OR (ts = 200 AND tc <> '' AND tc NOT LIKE '%html%')))"
MEAS = "(ts IS NOT NULL AND ti IS NOT NULL AND (ts <> 200 OR tc <> ''))"
QUERIES["canonical_targets"] = _simple(lambda s: CA.targets(CA.evaluate(CA.in_scope(inputs.pages(s))).where("metadata_complete = 1"), inputs.pages(s)).select("page_id", "canonical", "target_known", "target_measured", "target_issue"))
ORACLE["canonical_targets"] = f"""SELECT page_id, canonical, {KNOWN} AS target_known, {MEAS} AS target_measured, CASE WHEN ts IS NULL THEN 'canonical_target_unknown' WHEN ti BETWEEN 300 AND 399 THEN 'canonical_target_redirect' WHEN ts <> 200 THEN 'canonical_target_non_200'
  WHEN tc <> '' AND tc NOT LIKE '%html%' THEN 'canonical_target_non_html' ELSE 'canonical_target_200' END AS target_issue FROM {TARGETS} q"""
QUERIES["checks_canonical_targets"] = _simple(lambda s: inputs.flat_results(CA.target_results(inputs.pages(s), s.table("site_runs"))))
TROWS = f"(SELECT run_id, url, false AS pg, false AS pend, {BADT} AS hitx, NOT {MEAS} AS openx FROM {TARGETS} q2 UNION ALL SELECT run_id, url, true, NOT {COMPLETE}, false, false FROM site_pages WHERE {CONTENT}) q"
ORACLE["checks_canonical_targets"] = check("tech.canonical_target_non_200", TROWS, {"pg": "pg", "pend": "pend", "hit": "hitx", "open": "openx"}, state_case(("pg = 0", NF), ("hit > 0", FAIL), ("pend > 0 OR open > 0", IE)), failed("hit"), "hitx", evidence=("open",))

# --- head values
CONS = f"({COMPLETE} AND n > 0 AND (NOT is_self OR n > 1))"


def _key(field):
    return f"lower(trim(regexp_replace({field}, '[[:space:]]+', ' ', 'g')))"


def _population(field):
    return f"""SELECT run_id, count(*) AS eligible, count_if(NOT {COMPLETE}) AS incomplete, count_if({CONS}) AS consolidated, count_if({COMPLETE} AND NOT {CONS}) AS compared FROM {SCOPE} q GROUP BY run_id"""


QUERIES["head_population"] = _simple(lambda s: HD.population_counts(inputs.pages(s), "title"))
ORACLE["head_population"] = _population("title")


def _groups(field, family):
    return f"""SELECT run_id, k AS head_key, count(*) AS url_count, string_agg(DISTINCT pt, ',' ORDER BY pt) AS page_types, string_agg(url, ' | ' ORDER BY url) FILTER (rn <= 10) AS sample_urls,
      '{family}:' || left(sha256('{field}:' || k), 20) AS root_cause_key FROM (SELECT run_id, k, url, min(page_type) AS pt, row_number() OVER (PARTITION BY run_id, k ORDER BY url) AS rn
      FROM (SELECT *, {_key(field)} AS k FROM {SCOPE} q) m WHERE {COMPLETE} AND NOT {CONS} AND k <> '' GROUP BY run_id, k, url) g GROUP BY run_id, k HAVING count(*) > 1"""


for _field, _name in (("title", "duplicate_titles"), ("meta_description", "duplicate_meta_descriptions")):
    QUERIES[f"head_{_name}"] = _simple(lambda s, field=_field: HD.duplicate_groups(inputs.pages(s), field).select("run_id", "head_key", "url_count", F.array_join("page_types", ",").alias("page_types"), F.array_join("sample_urls", " | ").alias("sample_urls"), "root_cause_key"))
    ORACLE[f"head_{_name}"] = _groups(_field, HD.FAMILIES[_field])
QUERIES["checks_duplicate_heads"] = _simple(lambda s: inputs.flat_results(HD.duplicate_results(inputs.pages(s), s.table("site_runs"), "title").unionByName(HD.duplicate_results(inputs.pages(s), s.table("site_runs"), "meta_description"))).drop("sample_urls"))


def _dup_check(field):
    return f"""SELECT run_id, '{HD.CHECK_IDS[field]}' AS check_id, st AS evaluation_state, CASE st WHEN 'pass' THEN 'OK' WHEN 'fail' THEN 'Warning' ELSE 'NA' END AS status, CAST(a AS BIGINT) AS affected_count, 'open=' || CAST(o AS VARCHAR) AS evidence
    FROM (SELECT r.run_id, coalesce(g.a, 0) AS a, coalesce(p.o, 0) AS o, CASE WHEN coalesce(g.a, 0) > 0 THEN 'fail' WHEN coalesce(p.o, 0) > 0 THEN 'insufficient_evidence' ELSE 'pass' END AS st FROM site_runs r
     LEFT JOIN (SELECT run_id, count_if(NOT {COMPLETE}) AS o FROM site_pages WHERE {CONTENT} GROUP BY 1) p ON p.run_id = r.run_id
     LEFT JOIN (SELECT run_id, sum(url_count) AS a FROM ({ORACLE['head_' + ('duplicate_titles' if field == 'title' else 'duplicate_meta_descriptions')]}) h GROUP BY 1) g ON g.run_id = r.run_id) x"""


ORACLE["checks_duplicate_heads"] = union([_dup_check("title"), _dup_check("meta_description")])

# --- templates
PARTS = "list_filter(string_split(regexp_extract(final_url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda p: p <> '')"
ROOTS = "('" + "', '".join(("blog", "magazin", "ratgeber", "wissen", "news", "shop", "c", "p", "store", "stores", "produkt", "produkte", "product", "products", "category", "kategorie", "standorte", "locations", "de", "en")) + "')"
TAIL = "CASE page_type WHEN 'location' THEN '{city}' WHEN 'category' THEN '{category}' ELSE '{slug}' END"
TOKEN = f"""CASE WHEN regexp_matches(lower(p), '^([0-9]+|[a-f0-9]{{8,}})$') OR (regexp_matches(lower(p), '^[a-z0-9]{{10,}}$') AND regexp_matches(p, '[0-9]')) THEN '{{id}}' WHEN regexp_matches(lower(p), '^[a-z]{{2}}(-[a-z]{{2}})?$') THEN lower(p)
  WHEN i = 1 AND lower(p) IN {ROOTS} THEN lower(p) WHEN i = len(parts) THEN {TAIL} WHEN len(parts) >= 3 AND i = len(parts) - 1 THEN '{{subcategory}}' ELSE '{{category}}' END"""
KEYED = f"""(SELECT *, concat(page_type, ':', url_pattern) AS cluster_key FROM (SELECT *, CASE WHEN len(parts) = 0 THEN '/' ELSE '/' || array_to_string(list_transform(parts, lambda p, i: {TOKEN}), '/') END AS url_pattern
  FROM (SELECT *, {PARTS} AS parts FROM site_pages) k0) k1)"""

QUERIES["template_keys"] = _simple(lambda s: TP.with_cluster_key(inputs.pages(s)).select("page_id", "url_pattern", "cluster_key"))
ORACLE["template_keys"] = f"SELECT page_id, url_pattern, cluster_key FROM {KEYED} q"

CHECK_SAMPLES = """SELECT run_id, 'tech.title_missing' AS check_id, 'Error' AS status, url FROM site_pages WHERE title = ''
UNION ALL SELECT run_id, 'tech.h1_missing', 'Warning', url FROM site_pages WHERE h1_count = 0
UNION ALL SELECT run_id, 'tech.viewport_missing', 'Warning', url FROM site_pages WHERE viewport IS NULL
UNION ALL SELECT run_id, 'tech.multiple_h1', 'OK', url FROM site_pages WHERE h1_count = 2"""


def _issues(site):
    site.table("site_pages").createOrReplaceTempView("site_pages")
    return TP.issue_counts(site.spark.sql(CHECK_SAMPLES))


ISSUES = f"(SELECT run_id, url, count(*) AS issues FROM ({CHECK_SAMPLES}) cs WHERE status IN ('Warning', 'Error') GROUP BY 1, 2)"
QUERIES["template_issue_counts"] = _simple(_issues)
ORACLE["template_issue_counts"] = f"SELECT * FROM {ISSUES} q"


def _pairs(column):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


QUERIES["template_clusters"] = _simple(lambda s: TP.clusters(inputs.pages(s), _issues(s), per_template=3, total=6).select(
    "run_id", "cluster_key", "page_type", "url_pattern", "url_count", "indexable_count", "non_indexable_count", _pairs("status_codes").alias("status_codes"),
    F.coalesce(_pairs("schema_type_counts"), F.lit("")).alias("schema_types"), "avg_word_count", "avg_internal_links", "avg_external_links", F.array_join("sample_urls", " | ").alias("sample_urls")))
CLUSTERS = f"""(WITH kp AS (SELECT p.*, coalesce(i.issues, 0) AS issues FROM {KEYED} p LEFT JOIN {ISSUES} i ON i.run_id = p.run_id AND i.url = p.url),
 t AS (SELECT run_id, cluster_key, any_value(page_type) AS page_type, any_value(url_pattern) AS url_pattern, count(*) AS url_count, count_if(coalesce(indexable, 0) = 1) AS indexable_count, count_if(coalesce(indexable, 0) <> 1) AS non_indexable_count,
   round(avg(word_count_raw), 2) AS avg_word_count, round(avg(internal_links), 2) AS avg_internal_links, round(avg(external_links), 2) AS avg_external_links,
   [min(CASE WHEN status_code = 200 AND indexable = 1 THEN url END), min_by(url, (word_count_raw, url)), min_by(url, (-issues, url)), min(CASE WHEN schema_types <> '' THEN url END), min(CASE WHEN schema_types = '' THEN url END)] AS picks,
   list_sort(list_distinct(list(url))) AS urls FROM kp GROUP BY 1, 2),
 b AS (SELECT *, coalesce(sum(least(3, url_count)) OVER (PARTITION BY run_id ORDER BY url_count DESC, cluster_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM t),
 st AS (SELECT run_id, cluster_key, string_agg(k || '=' || n, ',' ORDER BY k) AS v FROM (SELECT run_id, cluster_key, CAST(status_code AS VARCHAR) AS k, count(*) AS n FROM kp GROUP BY 1, 2, 3) s0 GROUP BY 1, 2),
 ty AS (SELECT run_id, cluster_key, string_agg(k || '=' || n, ',' ORDER BY k) AS v FROM (SELECT run_id, cluster_key, k, count(*) AS n FROM (SELECT run_id, cluster_key, unnest(string_split(schema_types, ',')) AS k FROM kp WHERE schema_types <> '') s1 GROUP BY 1, 2, 3) s2 GROUP BY 1, 2)
SELECT b.*, st.v AS status_codes, coalesce(ty.v, '') AS schema_types, CAST(least(3, greatest(0, 6 - taken)) AS INT) AS slots FROM b LEFT JOIN st ON st.run_id = b.run_id AND st.cluster_key = b.cluster_key LEFT JOIN ty ON ty.run_id = b.run_id AND ty.cluster_key = b.cluster_key)"""
# Distinct values in first-seen order: keep a value when it does not occur before its position.
ORDERED = "list_filter(list_concat(list_filter(picks, lambda x: x IS NOT NULL), urls), lambda x, i: list_position(list_concat(list_filter(picks, lambda y: y IS NOT NULL), urls), x) = i)"
SAMPLES = f"array_slice({ORDERED}, 1, slots)"
ORACLE["template_clusters"] = f"""SELECT run_id, cluster_key, page_type, url_pattern, url_count, indexable_count, non_indexable_count, status_codes, schema_types, avg_word_count, avg_internal_links, avg_external_links,
  CASE WHEN slots = 0 THEN '' ELSE array_to_string({SAMPLES}, ' | ') END AS sample_urls FROM {CLUSTERS} q"""

QUERIES["template_sample_list"] = _simple(lambda s: TP.sample_list(TP.clusters(inputs.pages(s), _issues(s), per_template=3, total=6), inputs.pages(s), total=6))
ORACLE["template_sample_list"] = f"""SELECT run_id, page_id, position, cluster_key, url FROM (SELECT run_id, page_id, cluster_key, url, row_number() OVER (PARTITION BY run_id ORDER BY neg, cluster_key, rk, url) AS position FROM (
   SELECT run_id, page_id, neg, cluster_key, rk, url, row_number() OVER (PARTITION BY run_id, page_id ORDER BY neg, cluster_key, rk, url) AS first FROM (
    SELECT c.run_id, m.page_id, -c.url_count AS neg, c.cluster_key, c.rk, c.u AS url FROM (SELECT run_id, cluster_key, url_count, unnest(CASE WHEN slots = 0 THEN [] ELSE {SAMPLES} END) AS u, generate_subscripts(CASE WHEN slots = 0 THEN [] ELSE {SAMPLES} END, 1) AS rk FROM {CLUSTERS} q0) c
    JOIN (SELECT run_id, f, min(page_id) AS page_id FROM (SELECT run_id, page_id, unnest(list_distinct([url, final_url, normalized_url])) AS f FROM site_pages WHERE indexable = 1) fs GROUP BY 1, 2) m ON m.run_id = c.run_id AND m.f = c.u) j) k WHERE first = 1) z WHERE position <= 6"""

QUERIES["template_reusable_pages"] = _simple(lambda s: inputs.pages(s).where(TP.reusable_rendering()).select("page_id", "word_count_rendered", "rendered_h1_count", "rendered_links", "settling_status"))
ORACLE["template_reusable_pages"] = "SELECT page_id, word_count_rendered, rendered_h1_count, rendered_links, settling_status FROM site_pages WHERE render_status = 'success' AND settling_status IN ('settled', 'content_remained_empty') AND navigation_error IS NULL AND word_count_rendered IS NOT NULL"


# --- patterns
KSCOPE = f"(SELECT e.*, k.cluster_key FROM {SCOPE} e JOIN {KEYED} k ON k.page_id = e.page_id)"


def _shares(rows, prefix, coverage=True, avg=True):
    extra = ", round(sz * 1.0 / hits, 3) AS avg_length" if avg else ""
    return f"""SELECT run_id, pattern_key, pattern_type, scope_source, issue_type, hits AS affected_count, CAST(total AS BIGINT) AS total_in_pattern, CAST(ev AS BIGINT) AS evaluated_count, round(ev * 1.0 / total, 3) AS evidence_coverage,
      round(hits * 1.0 / ev, 3) AS affected_share, CASE WHEN ev >= 5 AND ev = total THEN 'high' ELSE 'medium' END AS confidence, '{prefix}:' || pattern_key || ':' || issue_type AS root_cause_key{extra}
    FROM (SELECT run_id, pattern_key, pattern_type, scope_source, issue_type, count_if(evaluated AND issue_type IS NOT NULL) AS hits, sum(CASE WHEN evaluated THEN sz END) AS sz, sum(count(*)) OVER w AS total, sum(count_if(evaluated)) OVER w AS ev FROM ({rows}) r0 GROUP BY 1, 2, 3, 4, 5
      WINDOW w AS (PARTITION BY run_id, pattern_key, pattern_type, scope_source)) r1 WHERE issue_type IS NOT NULL AND ev >= 3 AND hits >= 3 AND hits * 1.0 / ev >= 0.5 AND ev * 1.0 / total >= 0.8"""


def _head_pattern(field, low, high):
    value = f"CASE WHEN {COMPLETE} THEN trim(regexp_replace({field}, '[[:space:]]+', ' ', 'g')) END"
    rows = f"""SELECT run_id, cluster_key AS pattern_key, page_type AS pattern_type, 'template_fingerprint' AS scope_source, {COMPLETE} AS evaluated, length(coalesce(v, '')) AS sz,
      CASE WHEN NOT {COMPLETE} THEN NULL WHEN coalesce(v, '') = '' THEN '{field}_missing' WHEN length(v) < {low} THEN '{field}_too_short' WHEN length(v) > {high} THEN '{field}_too_long' END AS issue_type FROM (SELECT *, {value} AS v FROM {KSCOPE} h0) h1 WHERE NOT {CONS}"""
    return _shares(rows, "html_meta_pattern")


for _field, _low, _high in (("title", 20, 65), ("meta_description", 70, 160)):
    QUERIES[f"patterns_{_field}"] = _simple(lambda s, field=_field: TP.head_patterns(TP.with_cluster_key(inputs.pages(s)), field))
    ORACLE[f"patterns_{_field}"] = _head_pattern(_field, _low, _high)

SPROWS = f"""SELECT run_id, cluster_key AS pattern_key, page_type AS pattern_type, unnest(list_filter([CASE WHEN page_type = 'article' AND NOT {_typed('Article', 'BlogPosting')} THEN 'article_schema_missing' WHEN page_type = 'product' AND NOT {_typed('Product')} THEN 'product_schema_missing' WHEN page_type = 'location' AND NOT {_typed('LocalBusiness')} THEN 'localbusiness_schema_missing' END,
   CASE WHEN NOT {_typed('BreadcrumbList')} THEN 'breadcrumblist_schema_missing' END], lambda x: x IS NOT NULL)) AS issue_type FROM {{0}} s0"""
SPSCOPE = f"(SELECT * FROM {KEYED} k2 WHERE {OK} AND indexable = 1 AND page_type_confidence = 'high' AND page_type IN ('article', 'product', 'category', 'location'))"
QUERIES["patterns_schema"] = _simple(lambda s: TP.schema_patterns(TP.with_cluster_key(inputs.pages(s))))
ORACLE["patterns_schema"] = f"""SELECT h.run_id, h.pattern_key, h.pattern_type, 'template_fingerprint' AS scope_source, issue_type, n AS affected_count, total AS total_in_pattern, round(n * 1.0 / total, 3) AS affected_share, CASE WHEN total >= 5 THEN 'high' ELSE 'medium' END AS confidence, 'schema_pattern:' || h.pattern_key || ':' || issue_type AS root_cause_key
 FROM (SELECT run_id, pattern_key, pattern_type, issue_type, count(*) AS n FROM ({SPROWS.format(SPSCOPE)}) x GROUP BY 1, 2, 3, 4) h JOIN (SELECT run_id, cluster_key, page_type, count(*) AS total FROM {SPSCOPE} y GROUP BY 1, 2, 3) t ON t.run_id = h.run_id AND t.cluster_key = h.pattern_key AND t.page_type = h.pattern_type
 WHERE total >= 3 AND n >= 3 AND n * 1.0 / total >= 0.5"""

CANON_SCOPE = f"(SELECT e.*, k.cluster_key FROM (SELECT * FROM {EVALUATED} q0 WHERE {OK} AND coalesce(indexable, 1) = 1 AND coalesce(page_type, 'other') <> 'legal') e JOIN {KEYED} k ON k.page_id = e.page_id)"
CTARGET = TARGETS.replace(SCOPE, CANON_SCOPE).replace(f"q1 WHERE {COMPLETE}", "q1 WHERE n = 1")
CISSUE = f"""SELECT c.run_id, c.cluster_key AS pattern_key, c.page_type AS pattern_type, 'template_fingerprint' AS scope_source, {COMPLETE} AS evaluated, 0 AS sz, CASE WHEN NOT {COMPLETE} THEN NULL WHEN n = 0 THEN 'canonical_missing' WHEN n > 1 THEN 'conflicting_canonical_tags' WHEN tg.ti2 IS NOT NULL THEN tg.ti2 WHEN foreign_n > 0 THEN 'cross_registrable_domain' WHEN NOT is_self THEN 'canonical_non_self' END AS issue_type
  FROM {CANON_SCOPE} c LEFT JOIN (SELECT page_id, min(CASE WHEN ti BETWEEN 300 AND 399 THEN 'canonical_target_redirect' WHEN ts <> 200 THEN 'canonical_target_non_200' ELSE 'canonical_target_non_html' END) AS ti2 FROM {CTARGET} ct WHERE {BADT} GROUP BY 1) tg ON tg.page_id = c.page_id"""
CALL = _shares(f"SELECT * FROM ci UNION ALL SELECT run_id, 'site:all', 'mixed', 'sitewide', evaluated, sz, issue_type FROM ci", "canonical_pattern", avg=False)
QUERIES["patterns_canonical"] = _simple(lambda s: TP.canonical_patterns(TP.with_cluster_key(inputs.pages(s))))
ORACLE["patterns_canonical"] = f"""WITH ci AS ({CISSUE}), al AS ({CALL}) SELECT * FROM al WHERE scope_source <> 'sitewide' UNION ALL SELECT * FROM al a WHERE scope_source = 'sitewide' AND NOT EXISTS (SELECT 1 FROM al b WHERE b.run_id = a.run_id AND b.issue_type = a.issue_type AND b.scope_source <> 'sitewide')"""


def _pattern_sql(condition, minimum, extra="true"):
    hit = f"(coalesce({HTML}, true) AND {extra} AND coalesce({condition}, false))"
    return f"""SELECT run_id, pattern_key, pattern_type, affected_count, avg_html_size, CAST(total AS BIGINT) AS total_in_pattern FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY affected_count DESC, total DESC, pattern_key, pattern_type) AS rn FROM (
      SELECT run_id, cluster_key AS pattern_key, page_type AS pattern_type, count_if({hit}) AS affected_count, round(avg(CASE WHEN {hit} THEN raw_html_size END), 2) AS avg_html_size, sum(count(*)) OVER (PARTITION BY run_id, cluster_key) AS total FROM {KEYED} k GROUP BY 1, 2, 3) a
      WHERE affected_count >= {minimum} AND affected_count >= greatest(2.0, total * 0.5)) b"""


QUERIES["patterns_noindex"] = _simple(lambda s: TP.noindex_patterns(TP.with_cluster_key(inputs.pages(s))))
ORACLE["patterns_noindex"] = _pattern_sql(f"(noindex = 1 OR {ROBOTS} LIKE '%noindex%')", 2, "page_type <> 'legal'")
QUERIES["patterns_large_html"] = _simple(lambda s: TP.large_html_patterns(TP.with_cluster_key(inputs.pages(s))))
ORACLE["patterns_large_html"] = _pattern_sql("raw_html_size > 256000", 3)


def _pattern_checks(site):
    keyed, runs = TP.with_cluster_key(inputs.pages(site)), site.table("site_runs")
    parts = [
        TP.pattern_results(TP.head_patterns(keyed, "title"), "template.title_pattern_issue", runs), TP.pattern_results(TP.head_patterns(keyed, "meta_description"), "template.meta_pattern_issue", runs),
        TP.pattern_results(TP.noindex_patterns(keyed), "template.noindex_pattern", runs, "High"), TP.pattern_results(TP.schema_patterns(keyed), "template.schema_missing_pattern", runs),
        TP.pattern_results(TP.large_html_patterns(keyed), "template.large_html_pattern", runs), TP.pattern_results(TP.canonical_patterns(keyed), "template.canonical_pattern_issue", runs, "High"),
    ]
    output = parts[0]
    for part in parts[1:]:
        output = output.unionByName(part)
    return output


def _pattern_roll(name, check_id, priority="Low"):
    return f"""SELECT r.run_id, '{check_id}' AS check_id, CASE WHEN coalesce(n, 0) > 0 THEN 'fail' ELSE 'pass' END AS evaluation_state, CASE WHEN coalesce(n, 0) > 0 THEN 'Warning' ELSE 'OK' END AS status, '{priority}' AS priority, CAST(coalesce(a, 0) AS BIGINT) AS affected_count,
      CAST(coalesce(n, 0) AS BIGINT) AS patterns, CASE WHEN n = 1 AND a < 10 THEN 'medium' ELSE 'high' END AS confidence FROM site_runs r LEFT JOIN (SELECT run_id, sum(affected_count) AS a, count(*) AS n FROM ({ORACLE[name]}) p GROUP BY 1) g ON g.run_id = r.run_id"""


QUERIES["checks_template_patterns"] = _simple(_pattern_checks)
ORACLE["checks_template_patterns"] = union([
    _pattern_roll("patterns_title", "template.title_pattern_issue"), _pattern_roll("patterns_meta_description", "template.meta_pattern_issue"), _pattern_roll("patterns_noindex", "template.noindex_pattern", "High"),
    _pattern_roll("patterns_schema", "template.schema_missing_pattern"), _pattern_roll("patterns_large_html", "template.large_html_pattern"), _pattern_roll("patterns_canonical", "template.canonical_pattern_issue", "High"),
])

# --- sampled performance
GOOD = "error_message IS NULL AND coalesce(performance_score, seo_score, accessibility_score, best_practices_score) IS NOT NULL"
FINE = "status = 'success' AND navigation_error IS NULL"


def _agg(fn, name):
    return f"round({fn}(CASE WHEN {GOOD} THEN coalesce({name}, 0) END), 3)"


SUMMARY = f"""(SELECT s.run_id, s.cluster_key, s.sample_count, coalesce(l.lab_success_count, 0) AS lab_success_count, l.* EXCLUDE (run_id, cluster_key, lab_success_count), coalesce(b.browser_success_count, 0) AS browser_success_count, coalesce(b.js_required_count, 0) AS js_required_count, coalesce(b.console_error_sample_count, 0) AS console_error_sample_count
 FROM (SELECT run_id, cluster_key, count(*) AS sample_count FROM site_samples GROUP BY 1, 2) s
 LEFT JOIN (SELECT run_id, cluster_key, count_if({GOOD}) AS lab_success_count, {_agg('avg', 'performance_score')} AS avg_performance_score, {_agg('min', 'performance_score')} AS min_performance_score, {_agg('avg', 'seo_score')} AS avg_seo_score, {_agg('min', 'seo_score')} AS min_seo_score,
   {_agg('avg', 'accessibility_score')} AS avg_accessibility_score, {_agg('avg', 'best_practices_score')} AS avg_best_practices_score, {_agg('avg', 'lcp_ms')} AS avg_lcp_ms, {_agg('avg', 'tbt_ms')} AS avg_tbt_ms, {_agg('avg', 'cls')} AS avg_cls FROM site_lab GROUP BY 1, 2) l ON l.run_id = s.run_id AND l.cluster_key = s.cluster_key
 LEFT JOIN (SELECT run_id, cluster_key, count_if({FINE}) AS browser_success_count, count_if({FINE} AND js_required = 1) AS js_required_count, count_if({FINE} AND console_errors > 0) AS console_error_sample_count FROM site_browser GROUP BY 1, 2) b ON b.run_id = s.run_id AND b.cluster_key = s.cluster_key)"""
QUERIES["template_performance_summary"] = _simple(lambda s: TP.performance_summary(s.table("site_samples"), s.table("site_lab"), s.table("site_browser")))
ORACLE["template_performance_summary"] = f"SELECT * FROM {SUMMARY} q"

QUERIES["template_worst_samples"] = _simple(lambda s: TP.worst_samples(s.table("site_lab"), s.table("site_browser")))
ORACLE["template_worst_samples"] = f"""SELECT run_id, cluster_key, url, performance_score, lcp_ms, tbt_ms, console_errors, position FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cluster_key ORDER BY performance_score ASC NULLS LAST, coalesce(lcp_ms, 0) DESC, coalesce(tbt_ms, 0) DESC, coalesce(console_errors, 0) DESC, url) AS position FROM (
  SELECT coalesce(l.run_id, b.run_id) AS run_id, coalesce(l.cluster_key, b.cluster_key) AS cluster_key, coalesce(l.url, b.url) AS url, l.m.p AS performance_score, l.m.lc AS lcp_ms, l.m.tb AS tbt_ms, b.console_errors FROM
   (SELECT run_id, cluster_key, url, max_by(struct_pack(p := performance_score, lc := lcp_ms, tb := tbt_ms), device) AS m FROM site_lab WHERE {GOOD} GROUP BY 1, 2, 3) l
   FULL OUTER JOIN (SELECT run_id, cluster_key, url, max(console_errors) AS console_errors FROM site_browser WHERE {FINE} GROUP BY 1, 2, 3) b ON b.run_id = l.run_id AND b.cluster_key = l.cluster_key AND b.url = l.url) j) k WHERE position <= 5"""


def _coverage(metric):
    usable = "error_message IS NULL AND url IS NOT NULL AND device IS NOT NULL"
    return f"""(SELECT c.run_id, clusters, incomplete_clusters, coalesce(te, 0) AS technical_errors, coalesce(mm, 0) AS missing_metric, (clusters > 0 AND incomplete_clusters = 0 AND coalesce(te, 0) = 0 AND coalesce(mm, 0) = 0) AS complete FROM (
      SELECT run_id, count(*) AS clusters, count_if(m < 2) AS incomplete_clusters FROM (SELECT s.run_id, s.cluster_key, count(DISTINCT l.url) AS m FROM site_samples s LEFT JOIN site_lab l ON l.run_id = s.run_id AND coalesce(l.cluster_key, '') = coalesce(s.cluster_key, '') AND l.url = s.url AND {usable.replace('url IS', 'l.url IS')} AND l.{metric} IS NOT NULL GROUP BY 1, 2) x GROUP BY 1) c
     LEFT JOIN (SELECT run_id, count(*) AS te FROM site_lab WHERE error_message IS NOT NULL GROUP BY 1) e ON e.run_id = c.run_id
     LEFT JOIN (SELECT run_id, count(*) AS mm FROM site_lab WHERE {usable} AND {metric} IS NULL GROUP BY 1) n ON n.run_id = c.run_id)"""


QUERIES["template_lab_coverage"] = _simple(lambda s: TP.lab_coverage(s.table("site_samples"), s.table("site_lab"), "performance_score"))
ORACLE["template_lab_coverage"] = f"SELECT * FROM {_coverage('performance_score')} q"
QUERIES["template_sampling_state"] = _simple(lambda s: TP.sampling_state(s.table("site_samples")))
STATE = "(SELECT run_id, count(*) AS sample_count, count_if(browser_status = 'success') AS browser_success, count_if(lab_status = 'success') AS lab_success, count_if(browser_status = 'unavailable') AS browser_unavailable, count_if(lab_status = 'unavailable') AS lab_unavailable FROM site_samples GROUP BY 1)"
ORACLE["template_sampling_state"] = f"SELECT * FROM {STATE} q"

LOWP = "(lab_success_count >= 2 AND (avg_performance_score < 0.7 OR min_performance_score < 0.7))"
TCOUNTS = f"""(SELECT run_id, count_if({LOWP}) AS perf, count_if({LOWP} AND (avg_performance_score < 0.5 OR min_performance_score < 0.5)) AS perf_error, count_if(avg_seo_score < 0.8 OR min_seo_score < 0.8) AS seo, count_if(lab_success_count >= 2 AND avg_lcp_ms > 2500) AS lcp,
  count_if(lab_success_count >= 2 AND avg_lcp_ms > 4000) AS lcp_error, count_if(avg_tbt_ms > 200) AS tbt, count_if(avg_tbt_ms > 600) AS tbt_error, count_if(console_error_sample_count >= 1) AS console, count_if(js_required_count > 0) AS js FROM {SUMMARY} q GROUP BY 1)"""


def _sampled(check_id, tool, hits, errors=None, coverage=None):
    cov = f"WHEN NOT coalesce(co.complete, false) AND coalesce(co.technical_errors, 0) > 0 THEN 'technical_error' WHEN NOT coalesce(co.complete, false) THEN 'insufficient_evidence'" if coverage else ""
    join = f"LEFT JOIN {_coverage(coverage)} co ON co.run_id = r.run_id" if coverage else ""
    severe = f"CASE WHEN e > 0 THEN 'Error' ELSE 'Warning' END" if errors else "'Warning'"
    return f"""SELECT run_id, '{check_id}' AS check_id, st AS evaluation_state, CASE st WHEN 'pass' THEN 'OK' WHEN 'fail' THEN {severe} ELSE 'NA' END AS status, CAST(CASE WHEN st = 'fail' THEN h ELSE 0 END AS BIGINT) AS affected_count FROM (
      SELECT r.run_id, coalesce(c.{hits}, 0) AS h, coalesce(c.{errors or hits}, 0) AS e, CASE WHEN {tool}_sampling = 0 OR coalesce(sample_count, 0) = 0 THEN 'not_executed' WHEN {tool}_success = 0 AND {tool}_unavailable > 0 THEN 'technical_error' WHEN {tool}_success = 0 THEN 'insufficient_evidence' {cov} WHEN coalesce(c.{hits}, 0) > 0 THEN 'fail' ELSE 'pass' END AS st
      FROM site_runs r LEFT JOIN {STATE} s ON s.run_id = r.run_id LEFT JOIN {TCOUNTS} c ON c.run_id = r.run_id {join}) x"""


def _tool(check_id, tool):
    return f"""SELECT r.run_id, '{check_id}' AS check_id, CASE WHEN coalesce(sample_count, 0) = 0 THEN 'not_executed' WHEN {tool}_unavailable > 0 THEN 'insufficient_evidence' ELSE 'pass' END AS evaluation_state, CASE WHEN coalesce(sample_count, 0) > 0 AND {tool}_unavailable = 0 THEN 'OK' ELSE 'NA' END AS status, coalesce({tool}_unavailable, 0) AS affected_count
      FROM site_runs r LEFT JOIN {STATE} s ON s.run_id = r.run_id"""


QUERIES["checks_template_sampling"] = _simple(lambda s: TP.sampling_results(s.table("site_samples"), s.table("site_lab"), s.table("site_browser"), s.table("site_runs")))
ORACLE["checks_template_sampling"] = union([
    _sampled("template.low_lighthouse_performance", "lab", "perf", "perf_error", "performance_score"), _sampled("template.low_lighthouse_seo", "lab", "seo"), _sampled("template.high_lcp", "lab", "lcp", "lcp_error", "lcp_ms"),
    _sampled("template.high_tbt", "lab", "tbt", "tbt_error"), _sampled("template.console_errors", "browser", "console"), _sampled("template.js_required_content", "browser", "js"), _tool("template.lighthouse_unavailable", "lab"), _tool("template.playwright_unavailable", "browser"),
])

ORACLE = {name: with_views(text) for name, text in ORACLE.items()}
