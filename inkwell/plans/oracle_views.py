"""The views of inkwell.sources.views in DuckDB SQL."""

from __future__ import annotations

_DENSE = "doc_id % 5 < 2"
VIEWS = {
    "articles": rf"""articles AS (
  SELECT doc_id AS id, 'https://' || CASE WHEN doc_id % 19 = 0 THEN 'nowhere.example' ELSE 'publication-' || (CASE WHEN {_DENSE} THEN doc_id % 10 ELSE 10 + doc_id % 1200 END) || '.example' END || '/post/' || doc_id AS url,
    array_to_string(regexp_split_to_array(substr(text, 1, 400), '[\x20\x09-\x0D]+')[1:8], ' ') AS title,
    CASE WHEN doc_id % 7 = 3 THEN NULL ELSE substr(source, 4, 9)::BIGINT END AS source_id,
    ['technology', 'economics', 'math'][(doc_id % 3 + 1)::INT] AS topic,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'author-' || (CASE WHEN {_DENSE} THEN doc_id % 20 ELSE 20 + doc_id % 2000 END) END AS author_key,
    CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'publication-' || (CASE WHEN {_DENSE} THEN doc_id % 10 ELSE 10 + doc_id % 1200 END) || '.example' END AS site_domain,
    CASE WHEN doc_id % 23 <> 0 THEN 1706745600000 - (doc_id % 75) * 86400000 END AS published_date,
    1706745600000 - (doc_id % 30) * 3600000 AS fetched_at,
    0.35::DOUBLE + (doc_id % 55) / 100.0::DOUBLE AS topic_relevance, 0.45::DOUBLE + (doc_id % 40) / 100.0::DOUBLE AS quality, 0.5::DOUBLE + (doc_id % 45) / 100.0::DOUBLE AS score,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS word_count,
    (doc_id % 11 = 0)::INT AS is_read, (doc_id % 17 = 0)::INT AS is_archived, (doc_id % 29 = 0)::INT AS is_bookmarked,
    CASE WHEN doc_id % 11 = 0 THEN 1706745600000 - (doc_id % 60) * 86400000 END AS read_at, text AS text_content
  FROM documents)""",
    "keyed": """keyed AS (
  SELECT *, coalesce(nullif(site_domain, ''), 'source:' || source_id, 'article:' || id) AS domain,
         coalesce(nullif(author_key, ''), nullif(site_domain, ''), 'source:' || source_id, 'article:' || id) AS voice, coalesce(published_date, fetched_at) AS effective FROM articles)""",
    "sources": """sources AS (
  SELECT i AS id, 'Source ' || i AS name, 'https://feed' || i || '.example/rss' AS feed_url, 'https://feed' || i || '.example' AS site_url,
    ['technology', 'economics', 'math'][(i % 3 + 1)::INT] AS topic, ['seed', 'hn', 'aggregator', 'outbound'][(i % 4 + 1)::INT] AS origin,
    ['active', 'failing', 'active', 'dead', 'paused'][(i % 5 + 1)::INT] AS status, 0.5::DOUBLE + (i % 30) / 100.0::DOUBLE AS score, i % 9 AS consecutive_failures,
    12.0::DOUBLE + i % 48 AS avg_update_hours, CASE WHEN i % 6 <> 0 THEN 1706745600000 + (i % 5 - 2) * 3600000 END AS next_check_at,
    CASE WHEN i % 7 <> 0 THEN 1706745600000 - (i % 40) * 3600000 END AS last_fetched_at
  FROM (SELECT DISTINCT substr(source, 4, 9)::BIGINT AS i FROM documents UNION ALL SELECT unnest([9001, 9002])::BIGINT))""",
    "reads": """reads AS (
  SELECT event_id, 'author-' || user_id AS author_key, 'publication-' || (event_id % 10) || '.example' AS domain, event_id % 500 AS article_id, epoch_us(ts) // 1000 AS shown_at
  FROM events WHERE event_type IN ('view', 'click'))""",
    "muted": """muted AS (SELECT DISTINCT 'author-' || user_id AS author_key FROM events WHERE user_id % 37 = 5)""",
    "exposures": """exposures AS (
  SELECT 'author' AS kind, author_key AS key, count(*) AS exposure_count, max(shown_at) AS last_exposed_at FROM reads WHERE author_key <> '' GROUP BY author_key
  UNION ALL SELECT 'domain', domain, count(*), max(shown_at) FROM reads WHERE domain <> '' GROUP BY domain)""",
    "eligible": """eligible AS (
  SELECT k.*, (('0x' || substr(md5('42:' || k.id), 1, 8))::BIGINT % 1000000 + 1)::DOUBLE / 1000001.0::DOUBLE AS u, s.name AS source_name, s.origin AS source_origin
  FROM keyed k LEFT JOIN sources s ON s.id = k.source_id
  WHERE is_archived = 0 AND is_read = 0 AND word_count >= 250 AND topic_relevance >= 0.4::DOUBLE AND effective > 1706745600000 - 60 * 86400000::BIGINT
    AND NOT EXISTS (SELECT 1 FROM muted m WHERE k.author_key <> '' AND m.author_key = k.author_key))""",
    "ranked": """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY voice ORDER BY ranking_key DESC, id) AS rank_in_voice, row_number() OVER (PARTITION BY domain ORDER BY ranking_key DESC, id) AS rank_in_domain
  FROM (SELECT *, round(greatest(quality, 0.05::DOUBLE) * (0.35::DOUBLE + 0.65::DOUBLE * topic_relevance)
      * pow(0.5::DOUBLE, greatest((1706745600000 - effective) / 86400000.0::DOUBLE, -30.0::DOUBLE) / 10.0::DOUBLE)
      * (0.75::DOUBLE + 0.5::DOUBLE * least(greatest(score, 0.0::DOUBLE), 1.0::DOUBLE))
      * CASE WHEN source_origin IS NULL OR source_origin <> 'seed' THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END * u, 9) AS ranking_key FROM eligible))""",
}
NEEDS = {"keyed": ["articles"], "eligible": ["keyed", "sources", "muted"], "ranked": ["eligible"], "exposures": ["reads"]}


def with_views(query: str, *names: str) -> str:
    """The query behind a WITH of the views it names and of those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return query
    return "WITH " + ",\n".join(VIEWS[n] for n in order) + (",\n" if query.lstrip().startswith("--+") else "\n") + query.replace("--+", "", 1)
