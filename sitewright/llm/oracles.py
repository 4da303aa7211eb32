"""DuckDB texts of operators over texts, in plain relational form: every window and every pair of documents that share a shingle."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_WHITE = r"'[^\x20\x09-\x0D]+'"
_ALPHANUMERIC = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUBSTRINGS = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WHITE}) AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM texts),
windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS key FROM places),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS n FROM windows) x WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, pos + k.k AS pos FROM later, (SELECT unnest(range(0, 20)) AS k) k),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM texts),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS text, count(*) AS n FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id AND c.pos = w.pos WHERE c.pos IS NULL GROUP BY 1)
SELECT t.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

DECONTAMINATION = f"""
WITH items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWERED}, {_ALPHANUMERIC}) AS words FROM benchmark),
item_places AS (SELECT item, words, least(10, len(words)) AS size, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS pos FROM items WHERE len(words) > 0),
item_windows AS (SELECT DISTINCT item, size, array_to_string(words[pos:pos + size - 1], ' ') AS key FROM item_places),
texts AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_ALPHANUMERIC}) AS words FROM documents),
places AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM texts, (SELECT DISTINCT size FROM item_windows) s WHERE len(words) >= size),
found AS (SELECT p.doc_id, p.pos, p.size, i.item FROM places p JOIN item_windows i ON i.size = p.size AND i.key = array_to_string(p.words[p.pos:p.pos + p.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT pos + k.k) AS n FROM found JOIN (SELECT unnest(range(0, 10)) AS k) k ON k.k < size GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) x GROUP BY 1)
SELECT t.doc_id, len(words)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit h ON h.doc_id = t.doc_id LEFT JOIN named m ON m.doc_id = t.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWERED}, {_WHITE}) AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS pos FROM texts WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, t.doc_id = c.component_id AS kept
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id JOIN components c ON c.doc_id = t.doc_id
"""

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _floor_mean(total: str, count: str) -> str:
    return f"(({total}) - ((({total}) % {count}) + {count}) % {count}) // {count}"


def vector_codes(rounds: int = 6, parts: int = 8, entries: int = 16, scale: int = 4096) -> str:
    """Plain rounds over all distances, one pair of tables for each round."""
    steps = [
        f"whole AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id) AS n FROM (SELECT vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE {_FINITE}) w)",
        f"x AS MATERIALIZED (SELECT n, pos * {parts} // len(v) AS part, pos, v[pos + 1] AS x FROM (SELECT n, v, unnest(range(len(v))) AS pos FROM whole) w)",
        f"book0 AS MATERIALIZED (SELECT part, n - 1 AS entry, pos, x FROM x WHERE n <= {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT n, part, entry, d FROM (SELECT *, row_number() OVER (PARTITION BY n, part ORDER BY d, entry) AS place FROM "
            f"(SELECT n, part, entry, sum((x.x - b.x) * (x.x - b.x))::BIGINT AS d FROM x JOIN book{r} b USING (part, pos) GROUP BY ALL) d) p WHERE place = 1)"
        )
        if r < rounds:
            steps.append(
                f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN "
                f"(SELECT part, entry, pos, ({_floor_mean('sum(x)::BIGINT', 'count(*)')})::BIGINT AS x FROM x JOIN near{r} USING (n, part) GROUP BY ALL) m USING (part, entry, pos))"
            )
    steps += [
        f"books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})",
        f"coded AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY n)",
    ]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM whole JOIN coded USING (n), books\n"
    )


def centroid_clusters(rounds: int = 10, clusters: int = 8, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Plain rounds over all distances, one pair of tables for each round."""
    steps = [
        f"whole AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) AS n "
        f"FROM (SELECT vec_id, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE {_FINITE} AND len(embedding) = {width}) w)",
        "x AS MATERIALIZED (SELECT n, pos, v[pos + 1] AS x FROM (SELECT n, v, unnest(range(len(v))) AS pos FROM whole) w)",
        f"centre0 AS MATERIALIZED (SELECT (n - 1)::INT AS cluster, pos, x FROM x WHERE n <= {clusters})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT n, cluster, d FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY d, cluster) AS place FROM "
            f"(SELECT n, cluster, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN centre{r} c USING (pos) GROUP BY ALL) d) p WHERE place = 1)"
        )
        if r < rounds:
            steps.append(
                f"centre{r + 1} AS MATERIALIZED (SELECT c.cluster, c.pos, coalesce(m.x, c.x) AS x FROM centre{r} c LEFT JOIN "
                f"(SELECT cluster, pos, ({_floor_mean('sum(x)::BIGINT', 'count(*)')})::BIGINT AS x FROM x JOIN near{r} USING (n) GROUP BY ALL) m USING (cluster, pos))"
            )
    steps.append(f"named AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM centre{rounds} GROUP BY cluster)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, "
        f"(sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM whole JOIN near{rounds} USING (n) JOIN named USING (cluster)\n"
    )
