"""Crawl tables derived from the given tables, as SQL text that both Spark and DuckDB read alike.

The given tables hold only ``pages(page_id, url, html)``; status, headers, runs and measurements that a crawl
would store next to them follow from fixed arithmetic on the keys. Every view covers all rows of its base table.
``{unnest}`` is the one word on which the two dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import url as U

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["raw_pages"] = """
SELECT page_id,
  lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
  concat(regexp_extract(url, '^(https?://[^/?#]+)', 1),
    CASE page_id % 20 WHEN 0 THEN '/blog' WHEN 1 THEN '/produkte' WHEN 2 THEN '/c/schuhe' WHEN 4 THEN '/impressum'
      WHEN 5 THEN '/kontakt' WHEN 6 THEN '/news' WHEN 7 THEN '/store' WHEN 8 THEN '/suche' WHEN 9 THEN '/artikel'
      WHEN 10 THEN '/p' WHEN 11 THEN '/tag' WHEN 12 THEN '/ratgeber/pflege' WHEN 13 THEN '/kategorie'
      WHEN 14 THEN '/standorte' WHEN 15 THEN '/about' WHEN 16 THEN '/shop/product' WHEN 17 THEN '/search'
      WHEN 18 THEN '/wissen' WHEN 19 THEN '/team' ELSE '' END,
    regexp_extract(url, '^https?://[^/?#]+(.*)$', 1)) AS url,
  html
FROM pages
"""

VIEWS["site_pages"] = """
SELECT page_id, host AS run_id, url,
  regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=feed$', ''), '/$', '') AS normalized_url,
  regexp_replace(url, '#.*$', '') AS final_url,
  CAST(page_id % 5 AS INT) AS depth,
  CASE WHEN page_id % 25 = 7 THEN 404 WHEN page_id % 50 = 11 THEN 500 WHEN page_id % 50 = 31 THEN 503
       WHEN page_id % 100 = 61 THEN 429 WHEN page_id % 100 = 41 THEN 403 ELSE 200 END AS status_code,
  CASE WHEN page_id % 20 = 3 THEN 301 WHEN page_id % 25 = 7 THEN 404 WHEN page_id % 50 = 11 THEN 500
       WHEN page_id % 50 = 31 THEN 503 WHEN page_id % 100 = 61 THEN 429 WHEN page_id % 100 = 41 THEN 403
       ELSE 200 END AS initial_status_code,
  CASE WHEN page_id % 50 = 11 THEN '500,500' WHEN page_id % 100 = 31 THEN '503,200' WHEN page_id % 50 = 31 THEN '503'
       WHEN page_id % 100 = 61 THEN '429' WHEN page_id % 25 = 7 THEN '404' WHEN page_id % 33 = 1 THEN 'timeout,200'
       ELSE '200' END AS attempt_statuses,
  CASE WHEN page_id % 40 = 5 THEN 'application/pdf' WHEN page_id % 40 = 6 THEN NULL
       ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 10 = 4 THEN 0 WHEN page_id % 97 = 13 THEN NULL ELSE 1 END AS indexable,
  CASE WHEN page_id % 10 = 4 THEN 1 ELSE 0 END AS noindex,
  CASE WHEN page_id % 15 = 2 THEN 1 ELSE 0 END AS nofollow,
  CASE WHEN page_id % 10 = 4 THEN 'noindex, follow' WHEN page_id % 15 = 2 THEN 'index, nofollow' ELSE NULL END AS meta_robots,
  CASE WHEN page_id % 30 = 14 THEN 'noindex' WHEN page_id % 45 = 9 THEN 'none; nosnippet'
       WHEN page_id % 45 = 10 THEN 'nosnippet' ELSE NULL END AS x_robots_tag,
  CASE WHEN page_id % 17 = 4 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
  regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1_text,
  CASE WHEN page_id % 9 = 0 THEN NULL
       WHEN page_id % 9 = 1 THEN substr(regexp_extract(html, '<h1>([^<]*)</h1>', 1), 1, 30)
       WHEN page_id % 9 = 2 THEN concat(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' - ', regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' - ', regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' - ', regexp_extract(html, '<h1>([^<]*)</h1>', 1))
       WHEN page_id % 9 = 3 THEN concat('Shared description of ', host, ' used by several pages of this site for everyone')
       ELSE concat(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' : more text about the subject of this page ', CAST(page_id AS VARCHAR(20))) END AS meta_description,
  CASE WHEN page_id % 13 = 1 THEN 0 WHEN page_id % 13 = 2 THEN 2 ELSE 1 END AS h1_count,
  CAST(page_id % 4 AS INT) AS h2_count,
  CASE WHEN page_id % 11 = 5 THEN NULL ELSE regexp_extract(html, '<html lang="([^"]*)"', 1) END AS html_lang,
  CASE WHEN page_id % 12 = 3 THEN NULL ELSE 'width=device-width' END AS viewport,
  CASE WHEN page_id % 12 = 7 THEN NULL ELSE '/favicon.ico' END AS favicon,
  CASE WHEN page_id % 3 = 0 THEN '' ELSE '/site.webmanifest' END AS manifest,
  CASE WHEN page_id % 21 = 3 THEN 0 ELSE 1 END AS header_utf8,
  CASE WHEN page_id % 7 = 3 THEN 0 ELSE 1 END AS meta_utf8,
  CASE WHEN page_id % 8 = 0 THEN NULL
       WHEN page_id % 8 = 1 THEN concat('https://', host, '/canonical-target')
       WHEN page_id % 8 = 2 THEN concat(regexp_replace(url, '#.*$', ''), ' https://', host, '/other')
       WHEN page_id % 8 = 3 THEN 'https://partner-shop.test/landing'
       WHEN page_id % 8 = 4 THEN concat(regexp_replace(url, '#.*$', ''), ' ', regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '[?]utm_source=feed$', ''), '/$', ''))
       ELSE regexp_replace(url, '#.*$', '') END AS canonical_values,
  CASE WHEN page_id % 19 = 18 THEN 0 ELSE 1 END AS metadata_complete,
  CASE page_id % 20 WHEN 0 THEN 'article' WHEN 1 THEN 'product' WHEN 2 THEN 'category' WHEN 4 THEN 'legal'
    WHEN 5 THEN 'contact' WHEN 6 THEN 'article' WHEN 7 THEN 'location' WHEN 8 THEN 'search' WHEN 9 THEN 'article'
    WHEN 10 THEN 'product' WHEN 11 THEN 'category_index' WHEN 12 THEN 'article' WHEN 13 THEN 'category'
    WHEN 14 THEN 'location' WHEN 16 THEN 'product' ELSE 'other' END AS page_type,
  CASE WHEN page_id % 3 = 0 THEN 'medium' ELSE 'high' END AS page_type_confidence,
  CASE page_id % 7 WHEN 0 THEN 'Article,BreadcrumbList' WHEN 1 THEN 'Product,Offer' WHEN 2 THEN 'BlogPosting'
    WHEN 3 THEN 'Organization,WebSite' WHEN 4 THEN 'LocalBusiness,Person' WHEN 5 THEN 'FAQPage,BreadcrumbList' ELSE '' END AS schema_types,
  CAST(floor(length(html) / (6 + page_id % 3)) AS INT) - CASE WHEN page_id % 11 = 0 THEN CAST(floor(length(html) / (6 + page_id % 3)) AS INT) - CAST(page_id % 60 AS INT) ELSE 0 END AS word_count_raw,
  CAST(length(html) * (1 + page_id % 120) AS BIGINT) AS raw_html_size,
  CAST(6 + page_id % 9 AS INT) AS internal_links,
  CAST(page_id % 4 AS INT) AS external_links,
  CASE WHEN page_id % 8 = 0 THEN 1 ELSE 0 END AS has_faq,
  CASE WHEN page_id % 8 = 1 THEN 1 ELSE 0 END AS has_weak_faq,
  CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS has_tables,
  CASE WHEN page_id % 4 = 0 THEN 0 ELSE 1 END AS has_lists,
  CASE WHEN page_id % 5 = 1 THEN 1 ELSE 0 END AS has_date,
  CASE WHEN page_id % 7 = 2 THEN 1 ELSE 0 END AS has_author,
  CAST(page_id % 3 AS INT) AS source_links,
  CASE WHEN page_id % 9 = 4 THEN 1 ELSE 0 END AS has_video,
  CASE WHEN page_id % 14 = 3 THEN 1 ELSE 0 END AS low_structure,
  CASE WHEN page_id % 23 = 5 THEN 0 ELSE 1 END AS text_facts,
  CAST(page_id % 3 AS INT) AS touch_icons,
  CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS has_preload,
  CASE WHEN page_id % 5 = 2 THEN 1 ELSE 0 END AS has_preconnect,
  CASE WHEN page_id % 6 = 1 THEN 'de,en,x-default' WHEN page_id % 6 = 2 THEN 'de,fr' ELSE '' END AS hreflang,
  CASE WHEN page_id % 5 = 0 THEN 'og:title' WHEN page_id % 5 = 1 THEN 'og:title,og:image,og:type' ELSE 'og:title,og:description,og:image,og:url,og:type' END AS og_fields,
  CASE WHEN page_id % 5 = 2 THEN concat('https://', host, '/og') WHEN page_id % 5 > 2 THEN regexp_replace(url, '#.*$', '') ELSE NULL END AS og_url,
  CASE WHEN page_id % 9 = 1 THEN 'onetrust' WHEN page_id % 9 = 2 THEN 'cookiebot' ELSE '' END AS consent_vendors,
  CASE WHEN page_id % 4 = 2 THEN 1 ELSE 0 END AS has_tag_manager,
  CAST(page_id % 2 AS INT) AS main_regions, CAST(page_id % 3 AS INT) AS nav_regions,
  CASE WHEN page_id % 4 = 0 THEN 2 ELSE 0 END AS search_forms, CASE WHEN page_id % 8 = 0 THEN 1 ELSE 0 END AS main_search_forms,
  CASE WHEN page_id % 20 IN (8, 17) AND page_id % 3 = 0 THEN 1 ELSE 0 END AS search_result_lists,
  CASE WHEN page_id % 35 = 8 THEN 1 ELSE 0 END AS search_result_text, CASE WHEN page_id % 6 = 5 THEN 1 ELSE 0 END AS search_action,
  CASE WHEN page_id % 18 = 5 THEN 1 ELSE 0 END AS empty_headings,
  CAST(page_id % 4 AS INT) AS heading_skips,
  CASE page_id % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'success' WHEN 2 THEN 'success' WHEN 3 THEN 'unstable' WHEN 4 THEN 'technical_error' ELSE NULL END AS render_status,
  CASE page_id % 6 WHEN 0 THEN 'settled' WHEN 1 THEN 'settled' WHEN 2 THEN 'content_remained_empty' WHEN 3 THEN 'rendering_unstable' ELSE NULL END AS settling_status,
  CASE WHEN page_id % 6 = 4 THEN 'net::ERR_TIMED_OUT' ELSE NULL END AS navigation_error,
  CASE WHEN page_id % 6 < 3 THEN CAST(floor(length(html) / 4) AS INT) + CAST(page_id % 90 AS INT) ELSE NULL END AS word_count_rendered,
  CASE WHEN page_id % 6 < 3 THEN 1 ELSE 0 END AS rendered_h1_count,
  CASE WHEN page_id % 6 < 3 THEN CAST(6 + (page_id * 7) % 40 AS INT) ELSE NULL END AS rendered_links,
  CAST((page_id * 13) % 160 AS INT) AS raw_main_words,
  CAST((page_id * 13) % 160 + (page_id * 5) % 70 AS INT) AS initial_main_words,
  CAST((page_id * 13) % 160 + (page_id * 29) % 400 AS INT) AS settled_main_words,
  CAST(page_id % 14 AS INT) AS script_count,
  CAST((page_id * 911) % 60000 AS BIGINT) AS hydration_bytes,
  CASE WHEN page_id % 16 = 9 THEN 1 ELSE 0 END AS links_truncated,
  CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'default-src ''self''; frame-ancestors ''none''' WHEN 2 THEN 'script-src * ''unsafe-eval''; object-src *'
    WHEN 3 THEN 'upgrade-insecure-requests' WHEN 4 THEN 'default-src ''self'' ''unsafe-inline''' WHEN 5 THEN 'default-src ''self''; default-src *'
    WHEN 6 THEN 'script-src ''self'' ''unsafe-inline'' ''nonce-abc''; frame-ancestors *' ELSE 'default-src https:; 9bad value' END AS h_csp,
  CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'max-age=31536000; includeSubDomains; preload' WHEN 2 THEN 'max-age=100' WHEN 3 THEN 'max-age=0' WHEN 4 THEN 'includeSubDomains' ELSE 'max-age=31536000; max-age=1' END AS h_hsts,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'DENY' WHEN 2 THEN 'sameorigin' WHEN 3 THEN 'ALLOW-FROM https://a.test' ELSE 'DENY, SAMEORIGIN' END AS h_xfo,
  CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'nosniff' WHEN 2 THEN 'NoSniff, nosniff' ELSE 'sniff' END AS h_xcto,
  CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'strict-origin-when-cross-origin' WHEN 2 THEN 'unsafe-url' WHEN 3 THEN 'no-referrer, origin' WHEN 4 THEN 'bogus' ELSE 'no-referrer-when-downgrade' END AS h_referrer,
  CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'geolocation=(), camera=(self)' WHEN 2 THEN 'camera=*' WHEN 3 THEN 'microphone=(*)' WHEN 4 THEN 'payment=(self "https://pay.test")' ELSE 'usb=(none)' END AS h_permissions,
  CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'no-store' WHEN 2 THEN 'no-cache' WHEN 3 THEN 'max-age=600' WHEN 4 THEN 'max-age=0' WHEN 5 THEN 'max-age=10, max-age=20' ELSE 'public, s-maxage=60' END AS h_cache,
  CASE WHEN page_id % 3 = 0 THEN '"abc"' ELSE NULL END AS h_etag,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'gzip' WHEN 2 THEN 'br' WHEN 3 THEN 'identity' ELSE 'zstd' END AS h_encoding,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'same-origin' WHEN 2 THEN 'unsafe-none' WHEN 3 THEN 'same-origin, unsafe-none' ELSE 'whatever' END AS h_coop,
  CASE WHEN page_id % 22 = 21 THEN 0 ELSE 1 END AS headers_stored
FROM raw_pages
"""

VIEWS["site_runs"] = """
SELECT host AS run_id, concat('https://', host) AS final_domain, host AS input_domain,
  CASE WHEN min(page_id) % 7 = 6 THEN 0 ELSE 1 END AS store_all_links,
  CASE WHEN min(page_id) % 9 = 8 THEN 0 ELSE 1 END AS store_all_images,
  CASE WHEN min(page_id) % 11 = 10 THEN 0 ELSE 1 END AS store_all_resources,
  CASE WHEN min(page_id) % 13 = 12 THEN 0 ELSE 1 END AS store_headers,
  CASE WHEN min(page_id) % 5 = 4 THEN 0 ELSE 1 END AS use_browser,
  CASE WHEN min(page_id) % 3 = 2 THEN 0 ELSE 1 END AS lab_sampling,
  CASE WHEN min(page_id) % 4 = 3 THEN 0 ELSE 1 END AS browser_sampling,
  CASE WHEN min(page_id) % 6 = 5 THEN 'import' ELSE 'crawl' END AS source_type,
  CASE WHEN min(page_id) % 10 = 9 THEN 'tech' ELSE 'both' END AS check_area,
  CASE WHEN min(page_id) % 8 = 7 THEN 'failed' ELSE 'completed' END AS status,
  CAST(count(*) AS BIGINT) AS processed_urls, CAST(min(page_id) % 20 AS INT) AS schedule_id
FROM raw_pages GROUP BY host
UNION ALL
SELECT concat(lower(replace(n_name, ' ', '-')), '.empty.example') AS run_id,
  concat('https://', lower(replace(n_name, ' ', '-')), '.empty.example') AS final_domain,
  concat(lower(replace(n_name, ' ', '-')), '.empty.example') AS input_domain,
  1 AS store_all_links, 1 AS store_all_images, 1 AS store_all_resources, 1 AS store_headers, 1 AS use_browser,
  1 AS lab_sampling, 1 AS browser_sampling, 'crawl' AS source_type, 'both' AS check_area, 'failed' AS status,
  CAST(0 AS BIGINT) AS processed_urls, CAST(n_nationkey % 20 AS INT) AS schedule_id
FROM nation
"""

VIEWS["page_total"] = "SELECT CAST(max(page_id) + 1 AS BIGINT) AS n FROM pages"

VIEWS["page_hrefs"] = """
SELECT page_id, host, url, {unnest}(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href
FROM raw_pages
"""

VIEWS["site_links"] = """
SELECT host AS run_id, page_id, url AS source_url, href, concat('https://', host, href) AS target_url,
  concat('https://', host, href) AS normalized_target_url, 'internal' AS link_type,
  replace(href, '/', '') AS anchor_text, CASE WHEN length(href) % 5 = 2 THEN 'nofollow' ELSE '' END AS rel
FROM page_hrefs
UNION ALL
SELECT n.run_id, p.page_id, concat('https://', n.run_id, '/hub/', CAST(p.page_id AS VARCHAR(20))), n.url, n.url, n.normalized_url, 'internal', n.page_type,
  CASE WHEN n.page_id % 6 = 0 THEN 'nofollow noopener' ELSE '' END
FROM site_pages p CROSS JOIN page_total t CROSS JOIN (SELECT 10 AS f, 3 AS g UNION ALL SELECT 5 AS f, 1 AS g UNION ALL SELECT 5 AS f, 2 AS g) m
JOIN site_pages n ON n.page_id = (p.page_id * m.f + m.g) % t.n
UNION ALL
SELECT run_id, page_id, url, concat('https://social.test/', run_id), concat('https://social.test/', run_id), concat('https://social.test/', run_id), 'external', 'Social', 'nofollow'
FROM site_pages WHERE external_links > 0
UNION ALL
SELECT run_id, page_id, url, '/media/photo.jpg', concat('https://', run_id, '/media/photo.jpg'), concat('https://', run_id, '/media/photo.jpg'), 'internal', '', ''
FROM site_pages WHERE depth = 2
"""

VIEWS["site_queue"] = """
SELECT run_id, page_id AS queue_id, url, normalized_url, depth,
  CASE page_id % 4 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'robots_sitemap' WHEN 2 THEN 'internal_link' ELSE 'start' END AS source_type,
  CASE WHEN page_id % 29 = 3 THEN 'failed' WHEN page_id % 29 = 4 THEN 'pending' WHEN page_id % 29 = 5 THEN 'processing' WHEN page_id % 29 = 6 THEN 'skipped' WHEN page_id % 29 = 7 THEN 'retry_wait' ELSE 'done' END AS status,
  CASE WHEN page_id % 29 = 3 THEN NULL WHEN page_id % 29 = 7 THEN 503 ELSE 200 END AS last_status_code,
  CASE WHEN page_id % 58 = 3 THEN 'timeout' WHEN page_id % 29 = 3 THEN 'dns_error' ELSE NULL END AS last_error_type,
  CAST(page_id % 6 AS INT) AS attempts, CAST((page_id * 37) % 10 AS INT) AS priority,
  CAST(1700000000 + (page_id * 7919) % 100000 AS BIGINT) AS discovered_at,
  CASE WHEN page_id % 29 = 7 THEN CAST(1700100000 + page_id * 60 AS BIGINT) ELSE NULL END AS next_attempt_at
FROM site_pages
UNION ALL
SELECT run_id, page_id + 100000000, concat('https://', run_id, '/unlisted/', CAST(page_id AS VARCHAR(20))),
  concat('https://', run_id, '/unlisted/', CAST(page_id AS VARCHAR(20))), depth + 1, 'sitemap', 'pending', NULL, NULL, 0,
  CAST((page_id * 53) % 10 AS INT), CAST(1700000000 + (page_id * 104729) % 100000 AS BIGINT), NULL
FROM site_pages WHERE depth = 3
"""

VIEWS["site_resources"] = """
SELECT p.run_id, p.page_id, p.url AS page_url, p.final_url, o.o_orderkey AS resource_id,
  concat(CASE WHEN o.o_custkey % 3 = 0 THEN 'https://cdn.vendor.test/r' ELSE concat('https://', p.run_id, '/r') END,
    CAST(o.o_custkey % 400 AS VARCHAR(20)),
    CASE o.o_orderpriority WHEN '1-URGENT' THEN '.js' WHEN '2-HIGH' THEN '.js' WHEN '3-MEDIUM' THEN '.css' WHEN '4-NOT SPECIFIED' THEN '.png' ELSE '.woff2' END) AS resource_url,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'script' WHEN '2-HIGH' THEN 'script' WHEN '3-MEDIUM' THEN 'stylesheet' WHEN '4-NOT SPECIFIED' THEN 'image' ELSE 'font' END AS resource_type,
  CASE WHEN o.o_custkey % 3 = 0 THEN 1 ELSE 0 END AS third_party,
  CASE WHEN o.o_orderkey % 10 = 9 THEN NULL ELSE CAST(floor(o.o_totalprice) AS BIGINT) END AS size_bytes,
  CASE WHEN o.o_orderkey % 20 = 9 THEN 'fetch_failed' ELSE NULL END AS size_error,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'content_length' ELSE 'observed' END AS size_kind,
  CASE WHEN o.o_orderkey % 31 = 4 THEN 404 ELSE 200 END AS status_code,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'text/javascript' WHEN '2-HIGH' THEN 'application/javascript' WHEN '3-MEDIUM' THEN 'text/css'
    WHEN '4-NOT SPECIFIED' THEN CASE o.o_custkey % 4 WHEN 0 THEN 'image/webp' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/svg+xml' ELSE 'image/png' END ELSE 'font/woff2' END AS content_type,
  CASE o.o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'max-age=31536000' WHEN 2 THEN 'no-store' WHEN 3 THEN 'no-cache' ELSE 'max-age=60' END AS h_cache,
  CASE WHEN o.o_custkey % 4 = 0 THEN '"e"' ELSE NULL END AS h_etag,
  CASE WHEN o.o_custkey % 2 = 0 THEN 'gzip' ELSE NULL END AS h_encoding,
  CASE WHEN o.o_custkey % 3 = 1 THEN 'nosniff' ELSE NULL END AS h_xcto
FROM orders o CROSS JOIN page_total t JOIN site_pages p ON p.page_id = o.o_orderkey % t.n
"""

VIEWS["site_images"] = """
SELECT p.run_id, p.page_id, p.url AS page_url,
  concat('https://', p.run_id, '/img/', CASE l.l_suppkey % 10 WHEN 3 THEN 'hero-' WHEN 4 THEN 'banner-' ELSE 'i' END, CAST(l.l_partkey AS VARCHAR(20)),
    CASE l.l_suppkey % 6 WHEN 0 THEN '.webp' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.avif' WHEN 4 THEN '.svg' ELSE '.gif' END) AS image_url,
  CASE l.l_suppkey % 6 WHEN 0 THEN '.webp' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.avif' WHEN 4 THEN '.svg' ELSE '.gif' END AS extension,
  CASE WHEN l.l_partkey % 211 = 1 AND p.page_id % 31 = 2 THEN NULL WHEN l.l_linenumber = 2 THEN 0 ELSE 1 END AS alt_present,
  CASE WHEN l.l_linenumber = 2 THEN NULL WHEN l.l_linenumber = 3 THEN '' ELSE 'alt text' END AS alt_value,
  CASE WHEN l.l_quantity < 5 THEN '' WHEN l.l_quantity < 12 THEN '48' ELSE CAST(CAST(l.l_quantity * 10 AS INT) AS VARCHAR(20)) END AS width,
  CASE WHEN l.l_quantity < 9 THEN '' WHEN l.l_quantity < 12 THEN '32' ELSE CAST(CAST(l.l_quantity * 7 AS INT) AS VARCHAR(20)) END AS height,
  CASE l.l_returnflag WHEN 'A' THEN 'lazy' WHEN 'R' THEN 'LAZY' ELSE NULL END AS loading,
  CASE WHEN l.l_partkey % 13 = 0 THEN 1 ELSE 0 END AS decorative, CASE WHEN l.l_partkey % 17 = 0 THEN 1 ELSE 0 END AS badge,
  CASE WHEN l.l_partkey % 19 = 0 THEN 1 ELSE 0 END AS pixel, CASE WHEN l.l_partkey % 23 = 0 THEN 1 ELSE 0 END AS icon,
  CASE WHEN l.l_partkey % 13 = 0 THEN 'decorative' WHEN l.l_suppkey % 10 = 3 THEN 'hero' ELSE 'content' END AS image_role
FROM lineitem l CROSS JOIN page_total t JOIN site_pages p ON p.page_id = l.l_orderkey % t.n
"""

VIEWS["site_schema_rows"] = """
SELECT run_id, page_id, page_url, block_index, schema_type,
  CASE WHEN page_id % 12 = 6 THEN 'error' WHEN page_id % 96 = 13 THEN 'technical_error' ELSE 'ok' END AS parse_status,
  CASE WHEN page_id % 12 = 6 THEN CASE WHEN page_id % 24 = 6 THEN 'hash-shared' ELSE concat('hash-', CAST(page_id AS VARCHAR(20))) END ELSE NULL END AS snippet_hash,
  CASE WHEN schema_type = 'Organization' AND page_id % 2 = 1 THEN 'name,sameAs,url' WHEN schema_type = 'Organization' THEN 'name' ELSE 'headline' END AS properties
FROM (
  SELECT run_id, page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN final_url ELSE normalized_url END AS page_url,
    CAST(page_id % 2 AS INT) AS block_index, {unnest}(split(schema_types, ',')) AS schema_type
  FROM site_pages WHERE schema_types <> ''
) s
"""

VIEWS["site_timings"] = """
SELECT p.run_id, p.page_id, p.url, e.event_id AS attempt,
  CASE WHEN e.event_id % 10 = 0 THEN 1 ELSE 0 END AS warmup, e.value * 9 AS ttfb_ms,
  CASE WHEN e.event_type = 'error' THEN 'timeout' ELSE NULL END AS error,
  CASE WHEN p.page_id % 9 = 4 AND e.event_id % 2 = 0 THEN 'us' ELSE 'eu' END AS location,
  CASE WHEN p.page_id % 14 = 5 AND e.event_id % 3 = 0 THEN 'render' ELSE 'raw' END AS mode
FROM events e JOIN site_pages p ON p.page_id = e.user_id
"""

VIEWS["site_samples"] = """
SELECT run_id, concat(page_type, ':', CASE WHEN page_id % 2 = 0 THEN '/a/{slug}' ELSE '/b/{slug}' END) AS cluster_key, page_id, url,
  CASE WHEN page_id % 15 = 4 THEN 'unavailable' WHEN page_id % 6 < 4 THEN 'success' ELSE 'failed' END AS browser_status,
  CASE WHEN page_id % 17 = 4 THEN 'unavailable' WHEN page_id % 5 < 4 THEN 'success' ELSE 'failed' END AS lab_status
FROM site_pages
"""

VIEWS["site_lab"] = """
SELECT s.run_id, s.cluster_key, s.page_id, s.url, d.device,
  CASE WHEN s.lab_status = 'success' THEN NULL ELSE 'NO_FCP' END AS error_message,
  CASE WHEN s.page_id % 41 = 7 THEN NULL ELSE round(CAST((s.page_id * 37 + d.k * 11) % 100 AS DOUBLE) / 100, 2) END AS performance_score,
  round(CAST((s.page_id * 17 + d.k) % 60 + 40 AS DOUBLE) / 100, 2) AS seo_score,
  round(CAST((s.page_id * 23 + d.k) % 50 + 50 AS DOUBLE) / 100, 2) AS accessibility_score,
  round(CAST((s.page_id * 29 + d.k) % 50 + 50 AS DOUBLE) / 100, 2) AS best_practices_score,
  CAST((s.page_id * 131 + d.k * 50) % 6000 + 500 AS DOUBLE) AS lcp_ms,
  CAST((s.page_id * 61) % 1000 AS DOUBLE) AS tbt_ms,
  round(CAST((s.page_id * 7) % 40 AS DOUBLE) / 100, 2) AS cls
FROM site_samples s CROSS JOIN (SELECT 'mobile' AS device, 1 AS k UNION ALL SELECT 'desktop' AS device, 2 AS k) d
"""

VIEWS["site_browser"] = """
SELECT run_id, cluster_key, page_id, url, browser_status AS status,
  CASE WHEN page_id % 37 = 3 THEN 'net::ERR_ABORTED' ELSE NULL END AS navigation_error,
  CASE WHEN page_id % 4 = 1 THEN 1 ELSE 0 END AS js_required, CAST(page_id % 3 AS INT) AS console_errors
FROM site_samples
"""

VIEWS["site_findings"] = """
SELECT concat('run-', CAST(l_suppkey AS VARCHAR(20))) AS run_id, concat('f-', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS finding_id,
  CASE l_partkey % 24 WHEN 0 THEN 'tech.https_reachable' WHEN 1 THEN 'tech.title_missing' WHEN 2 THEN 'tech.duplicate_titles' WHEN 3 THEN 'tech.canonical_missing'
    WHEN 4 THEN 'tech.4xx_pages' WHEN 5 THEN 'tech.5xx_pages' WHEN 6 THEN 'tech.internal_links_to_3xx' WHEN 7 THEN 'tech.images_without_alt'
    WHEN 8 THEN 'tech.large_image_resources' WHEN 9 THEN 'tech.article_coverage_on_article_like_pages' WHEN 10 THEN 'geo.article_blog_pages_article_schema'
    WHEN 11 THEN 'geo.llms_txt_present' WHEN 12 THEN 'geo.robots_mentions_gptbot' WHEN 13 THEN 'tech.content_security_policy' WHEN 14 THEN 'tech.hsts_header'
    WHEN 15 THEN 'template.high_lcp' WHEN 16 THEN 'template.console_errors' WHEN 17 THEN 'tech.console_errors_present' WHEN 18 THEN 'trust.eeat_signal_summary'
    WHEN 19 THEN 'tech.js_dependent_content' WHEN 20 THEN 'tech.status_code_distribution' WHEN 21 THEN 'geo.impressum_linked' WHEN 22 THEN 'tech.open_graph_basics_missing'
    ELSE 'tech.sitemap_present' END AS check_id,
  CASE l_partkey % 24 WHEN 0 THEN 'Server & Infrastructure' WHEN 1 THEN 'HTML Head & Meta' WHEN 2 THEN 'HTML Head & Meta' WHEN 3 THEN 'Crawling & Indexing'
    WHEN 4 THEN 'Server & Infrastructure' WHEN 5 THEN 'Server & Infrastructure' WHEN 6 THEN 'Crawling & Indexing' WHEN 7 THEN 'Media SEO' WHEN 8 THEN 'Media SEO'
    WHEN 9 THEN 'Structured Data' WHEN 10 THEN 'Structured Data' WHEN 11 THEN 'GEO Opportunities' WHEN 12 THEN 'AI Crawler Policy' WHEN 13 THEN 'Security Best Practice'
    WHEN 14 THEN 'Security Best Practice' WHEN 15 THEN 'Template Performance & Rendering' WHEN 16 THEN 'Template Performance & Rendering' WHEN 17 THEN 'JavaScript & Rendering'
    WHEN 18 THEN 'Trust & Review Signals' WHEN 19 THEN 'JavaScript & Rendering' WHEN 20 THEN 'Server & Infrastructure' WHEN 21 THEN 'Trust & Contact Signals'
    WHEN 22 THEN 'HTML Head & Meta Opportunity' ELSE 'Crawling & Indexing' END AS category,
  CASE WHEN l_partkey % 24 IN (10, 11, 12, 18, 21) THEN 'geo' ELSE 'tech' END AS check_area,
  CASE WHEN l_returnflag = 'A' THEN 'OK' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'Error' WHEN l_returnflag = 'R' THEN 'Warning' WHEN l_linestatus = 'O' AND l_linenumber < 3 THEN 'NA' ELSE 'Warning' END AS status,
  CASE WHEN l_returnflag = 'A' THEN 'pass' WHEN l_returnflag = 'R' THEN 'fail' WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'not_applicable' WHEN l_linestatus = 'O' AND l_linenumber = 2 THEN 'technical_error' ELSE 'fail' END AS evaluation_state,
  CASE l_linenumber % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS priority,
  CASE l_linenumber % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE CASE WHEN l_quantity < 10 THEN 'low' ELSE 'high' END END AS confidence,
  CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE NULL END AS severity,
  CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'opportunity' WHEN 1 THEN 'best_practice' WHEN 2 THEN 'info' ELSE 'core_issue' END AS finding_type,
  CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'sitewide' WHEN 1 THEN 'template' WHEN 2 THEN 'url' WHEN 3 THEN 'host_configuration' ELSE NULL END AS scope_type,
  CASE WHEN l_partkey % 24 IN (13, 14) THEN 'security_headers.policy' WHEN l_partkey % 24 = 12 THEN 'ai_crawler_policy.robots_configuration' ELSE NULL END AS root_cause_key,
  CASE WHEN CAST(l_quantity AS INT) % 9 = 4 THEN concat('group.', CAST(l_partkey % 24 AS VARCHAR(20))) ELSE NULL END AS report_grouping_key,
  CAST(l_quantity AS BIGINT) AS affected_count, CAST(l_quantity AS BIGINT) * 2 AS occurrence_count,
  CASE WHEN l_returnflag = 'A' THEN 10 WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 WHEN l_linestatus = 'O' AND l_returnflag = 'N' AND l_linenumber < 3 THEN NULL ELSE 5 END AS score,
  CASE WHEN CAST(l_quantity AS INT) % 7 = 3 THEN 1 ELSE 0 END AS review_recommended,
  CAST(l_suppkey AS INT) AS run_no, l_shipdate AS stored_at,
  CASE CAST(l_quantity AS INT) % 8 WHEN 1 THEN 'The resource was not found.' WHEN 2 THEN 'Status recorded: 404 for the probe.' WHEN 3 THEN 'Markup is missing on some pages.' WHEN 4 THEN 'The bot is not explicitly mentioned.' ELSE 'Checked stored facts.' END AS finding,
  CASE WHEN l_partkey % 10 = 3 THEN 'false_positive' WHEN l_partkey % 10 = 4 THEN 'confirmed' WHEN l_partkey % 50 = 5 THEN 'ignored' ELSE NULL END AS review_status,
  CASE WHEN l_partkey % 12 = 7 THEN 'done' ELSE NULL END AS action_status,
  CASE WHEN l_partkey % 40 = 9 THEN 'OK' WHEN l_partkey % 40 = 10 THEN 'Error' ELSE NULL END AS manual_status,
  CASE WHEN l_partkey % 30 = 8 THEN 'Low' ELSE NULL END AS manual_priority,
  CASE l_linenumber % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'L' ELSE NULL END AS effort
FROM lineitem
"""

VIEWS["asset_robots"] = """
SELECT page_id AS asset_id, host AS run_id, url AS page_url, concat('https://', host, '/robots.txt') AS url,
  CASE page_id % 12 WHEN 7 THEN 404 WHEN 8 THEN 503 WHEN 9 THEN 403 WHEN 10 THEN 301 WHEN 11 THEN NULL ELSE 200 END AS status_code,
  CASE WHEN page_id % 30 = 1 THEN 'unstable' WHEN page_id % 30 = 3 THEN 'technical_error' ELSE 'confirmed' END AS measurement_state,
  CASE WHEN page_id % 34 = 6 THEN 1 ELSE 0 END AS truncated, CASE WHEN page_id % 26 = 5 THEN 0 ELSE 1 END AS provenance_complete,
  replace(CASE page_id % 6
    WHEN 0 THEN 'User-agent: *|Disallow: /'
    WHEN 1 THEN concat('User-agent: GPTBot|User-agent: CCBot|Disallow: /private|Allow: /|Sitemap: https://', host, '/sitemap.xml|Sitemap: /relative.xml|User-agent: *|Disallow: /blog|Disallow: /wissen')
    WHEN 2 THEN CASE WHEN page_id % 18 = 8 THEN '<!DOCTYPE html><html><body>Not here</body></html>' ELSE 'Disallow: /x|User-agent: *|Allow: /' END
    WHEN 3 THEN ''
    WHEN 4 THEN 'User-agent: ClaudeBot # named|Disallow: /*.html$|Allow: /llms.txt|Crawl-delay: 5|User-agent: PerplexityBot|Disallow: /|Allow: /llms'
    ELSE 'no directive here|User-agent: *|Disallow: /search|Disallow: /suche|Allow: /suche/en' END, '|', chr(10)) AS content
FROM raw_pages
"""

VIEWS["asset_sitemaps"] = """
SELECT page_id AS asset_id, host AS run_id, concat('https://', host, '/sitemap-', CAST(page_id AS VARCHAR(20)), '.xml') AS url,
  CASE page_id % 14 WHEN 9 THEN 404 WHEN 10 THEN 503 ELSE 200 END AS status_code, CASE WHEN page_id % 3 = 0 THEN 'robots_sitemap' ELSE 'sitemap_default' END AS source_type,
  CASE page_id % 7
    WHEN 0 THEN concat('<?xml version="1.0"?><urlset><url><loc>', replace(url, '&', '&amp;'), '</loc></url><url><loc> ', replace(url, '&', '&amp;'), ' </loc></url><url><loc>https://other.test/x</loc></url><url><loc>nothing</loc></url></urlset>')
    WHEN 1 THEN concat('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://', host, '/a</loc></url><url><loc>https://', host, '/b/', CAST(page_id AS VARCHAR(20)), '</loc></url></urlset>')
    WHEN 2 THEN concat('<sitemapindex><sitemap><loc>https://', host, '/sitemap-', CAST(page_id + 1 AS VARCHAR(20)), '.xml</loc></sitemap><sitemap><loc>https://', host, '/sitemap-', CAST(page_id AS VARCHAR(20)), '.xml</loc></sitemap></sitemapindex>')
    WHEN 3 THEN '<!DOCTYPE foo><urlset></urlset>' WHEN 4 THEN '<urlset><url><loc>broken</url>' WHEN 5 THEN '   ' ELSE '<feed><entry/></feed>' END AS content
FROM raw_pages
"""

VIEWS["asset_llms"] = """
SELECT doc_id AS asset_id, concat('https://docs', CAST(doc_id % 40 AS VARCHAR(20)), '.example/llms.txt') AS url, concat('docs', CAST(doc_id % 40 AS VARCHAR(20)), '.example') AS run_id,
  CASE doc_id % 9 WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/markdown; charset=iso-8859-1' WHEN 3 THEN 'text/markdown' ELSE 'text/plain; charset=utf-8' END AS content_type,
  CASE WHEN doc_id % 11 = 3 THEN 301 WHEN doc_id % 11 = 4 THEN 404 ELSE 200 END AS initial_status, CASE WHEN doc_id % 11 = 4 THEN 404 ELSE 200 END AS final_status,
  CASE WHEN doc_id % 13 = 5 THEN 'unstable' WHEN doc_id % 13 = 6 THEN 'technical_error' ELSE 'confirmed' END AS measurement_state, CASE WHEN doc_id % 17 = 2 THEN 1 ELSE 0 END AS truncated,
  CASE doc_id % 8 WHEN 0 THEN concat('# Project ', CAST(doc_id AS VARCHAR(20)), chr(10), '## Guides', chr(10), text) WHEN 1 THEN concat('# Docs', chr(10), '## Guides ##', chr(10), text)
    WHEN 2 THEN concat('# Site two', chr(10), '## Empty', chr(10), '<!-- nothing -->', chr(10)) WHEN 3 THEN concat('# Site three', chr(10), 'See [start](/start) and https://docs', CAST(doc_id % 40 AS VARCHAR(20)), '.example/a. End') WHEN 4 THEN '   '
    WHEN 5 THEN concat('<html><body>', text, '</body></html>') ELSE text END AS content
FROM documents
"""

VIEWS["host_probes"] = """
SELECT host AS run_id, p.page_id AS probe_id, k.kind, CASE k.kind WHEN 1 THEN concat('https://', host, '/') WHEN 2 THEN concat('http://', host, '/') WHEN 3 THEN concat('http://www.', host, '/') ELSE concat('http://', host, '/deep') END AS start_url,
  CASE WHEN k.kind = 4 THEN 'representative_public_path' ELSE 'root' END AS probe_role, CASE WHEN k.kind = 3 THEN concat('www.', host) ELSE host END AS start_host,
  CASE WHEN p.page_id % 9 = 4 THEN concat('http://', host, '/') WHEN p.page_id % 9 = 5 THEN 'https://elsewhere.test/' ELSE concat('https://', host, '/') END AS final_url,
  CASE WHEN p.page_id % 9 = 5 THEN 'elsewhere.test' ELSE host END AS final_host,
  CASE WHEN p.page_id % 13 = 6 THEN NULL WHEN p.page_id % 11 = 3 THEN 503 ELSE 200 END AS final_status, CASE WHEN p.page_id % 13 = 6 THEN NULL WHEN k.kind = 1 THEN 200 ELSE CASE p.page_id % 5 WHEN 0 THEN 302 WHEN 1 THEN 308 ELSE 301 END END AS initial_status,
  CASE WHEN k.kind = 1 THEN '' WHEN p.page_id % 5 = 0 THEN '302' WHEN p.page_id % 5 = 1 THEN '308' WHEN p.page_id % 5 = 2 THEN '301,301' ELSE '301' END AS redirect_statuses,
  CASE WHEN p.page_id % 13 = 6 THEN 'timeout' WHEN p.page_id % 11 = 3 THEN '503' ELSE '200' END AS attempt_statuses,
  CASE WHEN p.page_id % 17 = 7 THEN 1 ELSE 0 END AS loop_detected, CASE WHEN p.page_id % 7 = 3 THEN 0 ELSE 1 END AS path_preserved,
  CASE WHEN k.kind <> 1 THEN NULL WHEN p.page_id % 19 = 8 THEN 'certificate_error' WHEN p.page_id % 13 = 6 THEN 'technical_error' ELSE 'connected' END AS tls_state, CASE WHEN p.page_id % 19 = 8 THEN 2 ELSE 0 END AS certificate_failures,
  CASE p.page_id % 3 WHEN 0 THEN 'h2' WHEN 1 THEN 'http/1.1' ELSE 'h3' END AS negotiated_protocol
FROM raw_pages p CROSS JOIN (SELECT 1 AS kind UNION ALL SELECT 2 AS kind UNION ALL SELECT 3 AS kind UNION ALL SELECT 4 AS kind) k
"""

VIEWS["html_pages"] = """
SELECT page_id, url, replace(replace(html, '</head>', concat(
   CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('<link rel="canonical" href="', CASE WHEN page_id % 4 = 1 THEN url ELSE '/canonical' END, '">') END,
   CASE WHEN page_id % 3 = 0 THEN '' ELSE '<meta name="description" content="A  short   description">' END, CASE WHEN page_id % 5 = 0 THEN '<meta name="robots" content="noindex,follow">' ELSE '' END,
   '<meta property="og:title" content="OG ', CAST(page_id AS VARCHAR(20)), '"><link rel="alternate" hreflang="x-default" href="/"><link rel="icon" href="/favicon.ico"><script src="https://cdn.vendor.test/gtag/js?id=1"></script><link rel="stylesheet" href="/style.css"><link rel="preload" as="font" href="/f.woff2">',
   CASE page_id % 6 WHEN 0 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Article","@id":"#a","author":{"@id":"#p"}},{"@type":["Person","schema:Thing"],"@id":"#p","name":"N"}]}</script>'
     WHEN 1 THEN '<script type="application/ld+json">{broken</script>' WHEN 2 THEN '<script type="application/ld+json">  </script>' WHEN 3 THEN '<script type="application/ld+json">{"@type":"https://schema.org/Organization","sameAs":["https://x.test"],"name":"O"}</script>' ELSE '' END, '</head>')),
   '</nav>', concat('</nav><img src="/img/hero-', CAST(page_id AS VARCHAR(20)), '.jpg" alt="Hero" width="800" height="400"><img src="/img/pixel.gif" width="1" height="1"><img data-src="/img/photo.webp" alt="" loading="lazy"><a rel="nofollow" href="https://social.test/x?utm_source=a&b=2&a=1#f">Social  site</a>')) AS html
FROM raw_pages
"""

VIEWS["article_pages"] = """
SELECT page_id, url, replace(replace(html, '</h1>', concat('</h1>',
   CASE page_id % 5 WHEN 1 THEN '<p class="publish-date">Am 3. M\u00e4rz 2024</p>' WHEN 2 THEN '<div class="info"><time datetime="2024-01-05">2024-01-05</time></div>' WHEN 3 THEN '<time hidden>2023-02-02</time>'
     WHEN 4 THEN '<span class="updated-date">yesterday</span>' ELSE '' END,
   CASE page_id % 7 WHEN 2 THEN '<span class="byline"><img alt="Ann Author" src="/a.png"></span>' WHEN 3 THEN '<a rel="author" href="/team">Jo</a>' WHEN 4 THEN '<span class="author"> </span>' ELSE '' END,
   CASE page_id % 9 WHEN 4 THEN '<iframe src="https://www.youtube.com/embed/1"></iframe>' WHEN 5 THEN '<video src="/v.mp4"></video>' WHEN 6 THEN '<iframe src="https://maps.test/"></iframe>' ELSE '' END,
   CASE page_id % 3 WHEN 1 THEN '<a href="https://journal.test/p">Study on words</a>' WHEN 2 THEN '<ul class="footnotes"><li><a href="https://a.test/1">one</a></li><li><a href="https://a.test/1">again</a></li><li><a href="/own">own report</a></li></ul>'
     ELSE '<a href="https://plain.test/x">plain</a>' END,
   CASE WHEN page_id % 4 = 1 THEN '<nav><a href="https://n.test/report">report</a></nav>' ELSE '' END)), '</footer>', '<a href="https://late.test/">report</a></footer>') AS html
FROM html_pages
"""

VIEWS["finding_runs"] = """
SELECT concat('run-', CAST(s_suppkey AS VARCHAR(20))) AS run_id, concat('https://site', CAST(s_suppkey % 40 AS VARCHAR(20)), '.example') AS final_domain,
  CAST(s_suppkey AS INT) AS run_no, CAST(s_suppkey % 10 AS INT) AS schedule_id,
  CASE WHEN s_suppkey % 4 = 3 THEN 'import' ELSE 'crawl' END AS source_type, CASE WHEN s_suppkey % 3 = 2 THEN 0 ELSE 1 END AS lab_sampling,
  CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE 1 END AS browser_sampling, CAST(s_suppkey % 3 AS INT) AS render_required, CAST(s_suppkey % 2 AS INT) AS render_optional_open,
  CASE WHEN s_suppkey % 7 = 1 THEN 2 ELSE 0 END AS render_exhausted, CASE WHEN s_suppkey % 11 = 1 THEN 1 ELSE 0 END AS render_unavailable,
  CASE WHEN s_suppkey % 9 = 8 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN s_suppkey % 6 = 5 THEN 'tech' ELSE 'both' END AS check_area,
  CAST(100 + s_suppkey % 3 AS INT) AS max_urls, CAST(1700000000 + s_suppkey * 3600 AS BIGINT) AS finished_at, CASE WHEN s_suppkey % 8 = 0 THEN 'root-cause-scoring-v3' ELSE NULL END AS scoring_version
FROM supplier
"""

VIEWS["base_pages"] = """
SELECT run_id, page_id, url, normalized_url, status_code, indexable, title, canonical_values AS canonical, page_type, word_count_raw, internal_links, external_links, schema_types
FROM site_pages WHERE page_id % 10 <> 0
"""

VIEWS["compare_pages"] = """
SELECT run_id, page_id, url, normalized_url, CASE WHEN page_id % 13 = 5 THEN 404 ELSE status_code END AS status_code,
  CASE WHEN page_id % 12 = 2 THEN 0 WHEN page_id % 12 = 4 THEN 1 ELSE indexable END AS indexable,
  CASE WHEN page_id % 7 = 0 THEN concat(title, ' v2') ELSE title END AS title,
  CASE WHEN page_id % 16 = 9 THEN 'https://moved.test/' ELSE canonical_values END AS canonical,
  CASE WHEN page_id % 22 = 8 THEN 'article' ELSE page_type END AS page_type,
  word_count_raw + CASE WHEN page_id % 3 = 1 THEN 300 ELSE 0 END AS word_count_raw, internal_links, external_links,
  CASE WHEN page_id % 9 = 4 THEN 'Article' ELSE schema_types END AS schema_types
FROM site_pages WHERE page_id % 10 <> 1
"""

VIEWS["site_snapshots"] = """
SELECT conv_id AS snapshot_key, turn AS seq, role AS fingerprint, CAST(turn * 1500 AS BIGINT) AS elapsed_ms,
  CASE WHEN conv_id % 5 = 2 THEN 1 ELSE 0 END AS loading_indicators,
  CASE WHEN conv_id % 7 = 3 THEN 0 ELSE length(text) END AS visible_words
FROM conversations
"""

VIEWS["site_attempts"] = """
SELECT user_id AS url_key, event_id AS attempt,
  CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN CASE WHEN user_id % 5 = 1 THEN 503 ELSE 200 END
    WHEN 'click' THEN CASE WHEN user_id % 5 = 1 THEN 503 ELSE 200 END ELSE CASE WHEN user_id % 7 = 3 THEN 404 WHEN user_id % 5 = 1 THEN 503 ELSE 200 END END AS final_status,
  CASE event_type WHEN 'error' THEN 'timeout' ELSE NULL END AS error_type
FROM events
"""

VIEWS["site_url_metrics"] = """
SELECT run_id, page_id, url, page_type,
  CASE WHEN word_count_raw < 50 THEN 'thin' WHEN word_count_raw < 300 THEN 'moderate' ELSE 'substantial' END AS raw_content_class,
  CASE page_id % 5 WHEN 0 THEN 'render_required' WHEN 1 THEN 'render_recommended' ELSE 'render_not_required' END AS render_need,
  CASE WHEN page_id % 35 = 5 THEN 'render_budget_exhausted' WHEN page_id % 35 = 6 THEN 'render_unavailable' WHEN page_id % 5 = 0 THEN 'render_required' WHEN page_id % 5 = 1 THEN 'render_recommended' ELSE 'render_not_required' END AS render_decision,
  CASE WHEN page_id % 5 < 2 AND page_id % 35 NOT IN (5, 6) THEN 1 ELSE 0 END AS browser_run,
  CASE page_id % 4 WHEN 0 THEN 'settled' WHEN 1 THEN 'settling_timeout' WHEN 2 THEN 'rendering_unstable' ELSE 'navigation_failed' END AS settling_status,
  CAST(300 + (page_id * 13) % 900 AS DOUBLE) AS fetch_ms,
  CASE WHEN page_id % 5 < 2 THEN CAST(1000 + (page_id * 17) % 4000 AS DOUBLE) ELSE NULL END AS navigation_ms,
  CASE WHEN page_id % 5 < 2 THEN CAST(2000 + (page_id * 31) % 3000 AS DOUBLE) ELSE NULL END AS settling_ms,
  CASE WHEN page_id % 5 < 2 THEN CAST(20000 + (page_id * 101) % 60000 AS BIGINT) ELSE NULL END AS provenance_bytes
FROM site_pages
"""

#: Columns that mix both sides of a join whose key holds ``page_total``. A filter on one would join the two sides by that filter alone,
#: before the key is known, which compares all rows with all pages; so they are computed behind the join.
MIXED = {"site_links": ("source_url",), "site_resources": ("resource_url",), "site_images": ("image_url", "alt_present")}


def dependencies(text: str) -> list[str]:
    """Views a SQL text needs, in creation order."""
    wanted: set[str] = set()

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", sql):
                wanted.add(name)
                visit(VIEWS[name])

    visit(text)
    return [name for name in VIEWS if name in wanted]


def plain_counts(sql: str) -> str:
    """DuckDB counts conditions in a wider type than Spark; write them as filtered counts instead."""
    output, rest = "", sql
    while "count_if(" in rest:
        head, rest = rest.split("count_if(", 1)
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        output += f"{head}count(*) FILTER (WHERE "
        rest = plain_counts(rest[: end - 1]) + ")" + rest[end:]
    return output + rest


def with_views(sql: str) -> str:
    """DuckDB text: the query with the views it needs as common table expressions."""
    body = plain_counts(sql.strip())
    needed = dependencies(body)
    ctes = [f"{name} AS ({VIEWS[name].strip().replace('{unnest}', 'unnest')})" for name in needed]
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Site:
    """Spark side of the views: ``site.table('site_pages')`` over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._read(name) if name in TABLES else self._view(name)
        return self._frames[name]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name].replace("{unnest}", "explode")
        for used in (*TABLES, *VIEWS):
            if used != name and re.search(rf"(FROM|JOIN)\s+{used}\b", text):
                self.table(used).createOrReplaceTempView(used)
        df = self.spark.sql(text)
        if name not in MIXED:
            return df
        given = {f"__{column}": F.col(column) for column in MIXED[name]}
        return U.computed_once(df, given).select(*[F.col(f"__{column}").alias(column) if column in MIXED[name] else column for column in df.columns])
