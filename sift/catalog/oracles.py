"""The registered queries as DuckDB SQL, written from the semantics alone.

The statements share views as common table expressions. Rule lists are spelled
out as SQL lists; nothing here goes through the Spark expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

INSTANT, DIGEST, CAP = 85, 70, 15


@dataclass(frozen=True)
class Words:
    """Rule words as this side spells them; the defaults are written out again."""

    roles: tuple[str, ...]
    generic: tuple[str, ...]
    exclude: tuple[str, ...]
    weights: dict[str, int] = field(default_factory=dict)
    sql: tuple[str, ...] = ("sql",)
    python: tuple[str, ...] = ("python",)
    quality: tuple[str, ...] = ("data quality", "testing", "dq")
    senior: tuple[str, ...] = ("principal", "staff", "head of", "director", "vp", "lead")


OFFER_WORDS = Words(
    ("analytics engineer", "data analyst"),
    ("ring", "plate", "brand#1", "small", "large", "standard", "an", "o"),
    ("tirocinio", "intern", "blue anvil"),
)
WEIGHTED_WORDS = Words(
    OFFER_WORDS.roles, OFFER_WORDS.generic, OFFER_WORDS.exclude,
    {"role_match": 30, "skill_sql": -4, "skill_data_quality": 12, "remote": -7, "senior_penalty": -3},
)
DOCUMENT_WORDS = Words(("license",), ("ment", "tion", "ung", "que", "des"), ("token",))
PAGE_WORDS = Words(("the", "les", "der", "los"), ("ment", "tion", "ung", "des"), ("que en",))
LONG_WORDS = Words(
    (*(f"role {n}" for n in range(300)), "data analyst"),
    (*(f"skill {n}" for n in range(300)), "ring", "plate", "small", "large", "an"),
    (*(f"word {n}" for n in range(300)), "intern"),
)


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _any(needles: Sequence[str]) -> str:
    return f"len(list_filter({_list(needles)}, lambda n: contains(t, n))) > 0"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---- views --------------------------------------------------------------------

OFFERS = """
offers_named AS (
  SELECT *, replace(replace(replace(replace(replace(p_name, 'widget', 'data analyst'),
           'gear', 'sql'), 'red', 'staff'), 'cold', 'remote'), 'gizmo', 'intern') AS title
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
offers AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, title,
         p_brand AS company, p_type AS location,
         'https://parts.example/' || p_partkey AS url, 'catalog' AS source,
         CASE WHEN contains(title, 'remote') THEN true
              WHEN l_returnflag = 'N' THEN false END AS remote,
         '' AS description,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'lead' ELSE '' END AS seniority,
         CASE WHEN l_returnflag = 'A' THEN 'testing' ELSE '' END AS contract_type,
         l_returnflag || ' ' || l_linestatus AS tag_text
  FROM offers_named
),
posts AS (
  SELECT *, lower(concat(title, chr(10), company, chr(10), location, chr(10), description,
              chr(10), tag_text, chr(10), seniority, chr(10), contract_type, chr(10))) AS t,
         sha256(lower(trim(source || '|' || company || '|' || url)))[1:16] AS fingerprint
  FROM offers
)"""

DOCUMENTS = """
posts AS (
  SELECT doc_id, source AS title, lang AS company, '' AS location, text AS description,
         'https://docs.example/' || sha256(text) AS url, NULL::BOOLEAN AS remote,
         lower(concat(source, chr(10), lang, chr(10), chr(10), text, chr(10), chr(10), chr(10),
                      chr(10))) AS t,
         sha256(lower('documents|' || lang || '|https://docs.example/' || sha256(text)))[1:16]
           AS fingerprint
  FROM documents
)"""

EVENTS = """
sightings AS (
  SELECT event_id, user_id::VARCHAR AS url, event_type AS company, 'events' AS source,
         event_type || ' ' || event_id AS title,
         sha256('events|' || lower(event_type) || '|' || user_id)[1:16] AS fingerprint,
         date_diff('day', DATE '1970-01-01', ts::DATE) AS batch_id,
         strftime(ts::DATE + INTERVAL 1 DAY, '%Y-%m-%d 00:00:00') AS now,
         least(100, floor(value))::INTEGER AS score
  FROM events
)"""

EVENT_STATE = """
state AS (
  SELECT fingerprint, min(now) AS first_seen, max(now) AS last_seen,
         arg_max(score, event_id) AS score, arg_min(source, event_id) AS source,
         arg_min(company, event_id) AS company, arg_min(title, event_id) AS title,
         arg_min(url, event_id) AS url, min(batch_id) AS first_batch,
         arg_min(score, event_id) AS first_score, min(event_id) AS first_event
  FROM sightings GROUP BY fingerprint
)"""

PAGES = r"""
page AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS token,
         regexp_extract(url, '^https?://([^/]+)/', 1) AS host,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS page_title,
         regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
         TIMESTAMP '2024-01-01' + to_seconds(page_id * 61) AS stamp
  FROM pages
),
anchor AS (
  SELECT page_id, host, token,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1)
           AS pos
  FROM page
),
job AS (
  SELECT page_id AS landed_pos, 0 AS pos, token, host,
         trim(page_title, chr(32) || chr(9) || chr(10) || chr(13)) AS title, url,
         CASE WHEN page_id % 4 < 2
              THEN trim(replace(host, 'blog.', 'Anywhere, ')) ELSE '' END AS location,
         CASE page_id % 3
           WHEN 0 THEN array_to_string(list_filter(
             [trim(html, chr(32) || chr(9) || chr(10) || chr(13)),
              trim(heading, chr(32) || chr(9) || chr(10) || chr(13))],
             lambda p: p <> ''), chr(10) || chr(10))
           WHEN 1 THEN ''
           ELSE trim(heading, chr(32) || chr(9) || chr(10) || chr(13)) END AS description,
         CASE page_id % 5
           WHEN 0 THEN date_trunc('second', stamp)
           WHEN 1 THEN stamp - INTERVAL 150 MINUTE
           WHEN 2 THEN date_trunc('minute', stamp) + INTERVAL 5 HOUR END AS published_at
  FROM page
  UNION ALL
  SELECT page_id, pos, token, host,
         trim(replace(label, 'the', ' '), chr(32) || chr(9) || chr(10) || chr(13)),
         trim('https://' || host || href), '', '', NULL
  FROM anchor
),
board(token, company, board_ord) AS (
  VALUES ('en', 'English pages', 0), ('fr', 'Pages françaises', 1), ('de', 'de', 2),
         ('fr', 'Pages françaises, again', 3), ('it', 'Pagine italiane', 4)
),
mapped AS (
  SELECT *, CASE WHEN contains(x, 'remote') OR contains(x, 'distributed')
                   OR contains(x, 'anywhere') THEN true END AS remote
  FROM (SELECT *, lower(title || ' ' || location || ' ' || description) AS x FROM job)
),
bad AS (
  SELECT landed_pos, host FROM job
  WHERE pos = 0 AND ends_with(url, '#top') AND starts_with(host, 'm.') AND landed_pos <> 0
),
isolated AS (
  SELECT host AS source, title, url, landed_pos, pos FROM job
  WHERE title <> '' AND url <> '' AND host NOT IN (SELECT host FROM bad)
    -- A numeric title of zero is blank, not bad.
    AND NOT (landed_pos = 0 AND pos = 0 AND ends_with(url, '#top') AND starts_with(host, 'm.'))
)"""


FEED = """
posts AS (
  SELECT *, lower(concat(title, chr(10), company, chr(10), location, chr(10), description,
              chr(10), chr(10), chr(10), chr(10))) AS t,
         sha256(lower(trim(source || '|' || company || '|' || url)))[1:16] AS fingerprint
  FROM (
    SELECT mapped.*, mapped.host AS source, token AS company FROM mapped
    WHERE title <> '' AND url <> '' AND host NOT IN (SELECT host FROM bad)
      AND NOT (landed_pos = 0 AND pos = 0 AND ends_with(url, '#top') AND starts_with(host, 'm.'))
  )
)"""


# ---- scoring --------------------------------------------------------------------


def _hits(rules: Words) -> str:
    return f"""
hits AS (
  SELECT *,
    list_filter({_list(rules.exclude)}, lambda n: contains(t, n))[1] AS kill,
    {_any(rules.roles)} AS role_match,
    {_any(rules.sql)} AS group_sql,
    {_any(rules.python)} AS group_python,
    {_any(rules.quality)} AS group_data_quality,
    list_transform(list_filter({_list(rules.generic)}, lambda n: contains(t, n))[1:4],
                   lambda n: n || ':+3') AS generics,
    coalesce(remote, false) AS remote_boost,
    {_any(rules.senior)} AS senior_penalty
  FROM posts
)"""


def _scored(rules: Words) -> str:
    w = {
        key: int(rules.weights.get(key, default))
        for key, default in (
            ("role_match", 20), ("skill_sql", 20), ("skill_python", 10),
            ("skill_data_quality", 10), ("remote", 15), ("senior_penalty", 25),
        )
    }
    return f"""{_hits(rules)},
scored AS (
  SELECT *,
    CASE WHEN kill IS NOT NULL THEN 0 ELSE greatest(0, least(100,
      50 + CASE WHEN role_match THEN {w["role_match"]} ELSE 0 END
         + CASE WHEN group_sql THEN {w["skill_sql"]} ELSE 0 END
         + CASE WHEN group_python THEN {w["skill_python"]} ELSE 0 END
         + CASE WHEN group_data_quality THEN {w["skill_data_quality"]} ELSE 0 END
         + 3 * len(generics)
         + CASE WHEN remote_boost THEN {w["remote"]} ELSE 0 END
         - CASE WHEN senior_penalty THEN {w["senior_penalty"]} ELSE 0 END)) END::INTEGER AS score,
    CASE WHEN kill IS NOT NULL THEN ['kill:' || kill] ELSE list_filter(list_concat(
      [CASE WHEN role_match THEN 'role_match:+{w["role_match"]}' END,
       CASE WHEN group_sql THEN 'sql:+{w["skill_sql"]}' END,
       CASE WHEN group_python THEN 'python:+{w["skill_python"]}' END,
       CASE WHEN group_data_quality THEN 'data_quality:+{w["skill_data_quality"]}' END],
      generics,
      [CASE WHEN remote_boost THEN 'remote:+{w["remote"]}' END,
       CASE WHEN senior_penalty THEN 'senior_penalty:-{w["senior_penalty"]}' END]),
      lambda r: r IS NOT NULL) END AS reason_list
  FROM hits
),
listed AS (SELECT *, array_to_string(reason_list, '|') AS reasons FROM scored)"""


_ARRIVAL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

FIRST = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY {_ARRIVAL}) AS nth,
         first_value(score) OVER (PARTITION BY fingerprint
           ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
                    l_extendedprice DESC) AS last_score
  FROM listed
),
fresh AS (SELECT * FROM ranked WHERE nth = 1)"""

ALERTED = f"""
digest AS (SELECT * FROM fresh WHERE score >= {DIGEST} AND score < {INSTANT}),
capped AS (SELECT * FROM digest ORDER BY {_ARRIVAL} LIMIT {CAP}),
chosen AS (
  SELECT 'instant' AS route, * FROM fresh WHERE score >= {INSTANT}
  UNION ALL SELECT 'digest', * FROM capped
)"""

_TEXT = """printf('[%3d] %s', score, title) || chr(10)
  || '      ' || company || ' — ' || CASE WHEN location = '' THEN 'N/A' ELSE location END
  || ' — ' || CASE WHEN remote THEN 'remote' ELSE 'onsite/unknown' END || chr(10)
  || '      ' || url || chr(10)
  || '      reasons: '
  || CASE WHEN len(reason_list) = 0 THEN '-' ELSE array_to_string(reason_list, ', ') END
  || chr(10)"""

_KEYS = "l_orderkey, l_linenumber, url"

_OFFER_HITS = _with(OFFERS, _hits(OFFER_WORDS))
_OFFER_SCORES = _with(OFFERS, _scored(OFFER_WORDS))
_OFFER_FIRST = _with(OFFERS, _scored(OFFER_WORDS), FIRST)
_OFFER_ALERTS = _with(OFFERS, _scored(OFFER_WORDS), FIRST, ALERTED)
_DOCUMENT_SCORES = _with(DOCUMENTS, _scored(DOCUMENT_WORDS))
_EVENT_STATE = _with(EVENTS, EVENT_STATE)
_PAGES = _with(PAGES)

_STATE = "fingerprint, first_seen, last_seen, score, source, company, title, url"


_NEW_DOCUMENTS = (
    _DOCUMENT_SCORES
    + """SELECT fingerprint, min(doc_id) AS doc_id, arg_min(score, doc_id) AS score
FROM listed
WHERE fingerprint NOT IN (
  SELECT fingerprint FROM listed WHERE doc_id IN (SELECT doc_id FROM labels))
GROUP BY fingerprint"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "run_once": _OFFER_ALERTS
        + "SELECT route, fingerprint, score, title, company, location, remote, url, reasons,"
        + f" {_TEXT} AS text FROM chosen",
        "run_feed": _with(PAGES, FEED, _scored(PAGE_WORDS))
        + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY landed_pos, pos) AS nth FROM listed
),
new AS (
  SELECT * FROM ranked WHERE nth = 1 AND score >= {DIGEST}
    AND fingerprint NOT IN (SELECT fingerprint FROM listed WHERE starts_with(source, 'blog.'))
),
chosen AS (
  SELECT 'instant' AS route, * FROM new WHERE score >= {INSTANT}
  UNION ALL SELECT 'digest', * FROM
    (SELECT * FROM new WHERE score < {INSTANT} ORDER BY landed_pos, pos LIMIT {CAP})
)
SELECT route, fingerprint, score, title, company, location, remote, url, source, reasons,
  {_TEXT} AS text FROM chosen""",
        "long_lists": _with(OFFERS, _scored(LONG_WORDS)) + f"SELECT {_KEYS}, score, reasons FROM listed",
        "landed_lines": _PAGES
        + "SELECT token, pos::INTEGER AS pos, url AS absolute_url FROM job"
        + " WHERE token IN (SELECT token FROM board)",
        "split_bodies": _PAGES
        + "SELECT token, title, url, location, md5(description) AS description_md5 FROM job"
        + " WHERE title <> '' AND url <> ''",
        "run_replay": _EVENT_STATE
        + f""", routed AS (
  SELECT fingerprint, first_score, row_number() OVER (
           PARTITION BY first_batch, first_score >= {INSTANT} ORDER BY first_event) AS nth
  FROM state WHERE first_score >= {DIGEST}
)
SELECT {_STATE}, fingerprint IN (
  SELECT fingerprint FROM routed WHERE first_score >= {INSTANT} OR nth <= {CAP}) AS notified
FROM state""",
        "search_text": _with(DOCUMENTS)
        + "SELECT doc_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM posts",
        "fingerprint": _with(DOCUMENTS) + "SELECT doc_id, fingerprint FROM posts",
        "kill_list": _OFFER_HITS + f"SELECT {_KEYS}, kill FROM hits",
        "role_match": _OFFER_HITS + f"SELECT {_KEYS}, role_match FROM hits",
        "skill_groups": _OFFER_HITS
        + f"SELECT {_KEYS}, group_sql, group_python, group_data_quality FROM hits",
        "capped_bump": _with(DOCUMENTS, _hits(DOCUMENT_WORDS))
        + "SELECT doc_id, array_to_string(generics, '|') AS generic,"
        + " (3 * len(generics))::INTEGER AS points FROM hits",
        "remote_boost": _OFFER_HITS + f"SELECT {_KEYS}, remote, remote_boost FROM hits",
        "senior_penalty": _OFFER_HITS + f"SELECT {_KEYS}, senior_penalty FROM hits",
        "reasons": _OFFER_SCORES + f"SELECT {_KEYS}, reasons FROM listed",
        "score_default": _OFFER_SCORES + f"SELECT {_KEYS}, score FROM listed",
        "score_weighted": _with(OFFERS, _scored(WEIGHTED_WORDS))
        + f"SELECT {_KEYS}, score, reasons FROM listed",
        "score_documents": _DOCUMENT_SCORES
        + "SELECT doc_id, fingerprint, score, reasons FROM listed",
        "dedup_first": _OFFER_FIRST + f"SELECT fingerprint, {_KEYS}, title, score, reasons FROM fresh",
        "filter_new": _NEW_DOCUMENTS,
        "filter_new_merged": _NEW_DOCUMENTS,
        "seen_state": _EVENT_STATE + f"SELECT {_STATE}, false AS notified FROM state",
        "mark_notified": _EVENT_STATE
        + """SELECT fingerprint, coalesce((
  SELECT bool_or(s.batch_id - CASE WHEN s.company = 'view' THEN 1 ELSE 0 END >= state.first_batch)
  FROM sightings s WHERE s.fingerprint = state.fingerprint AND s.score >= 85), false) AS notified
FROM state""",
        "seen_unique": _EVENT_STATE
        + """, keys AS (
  SELECT 'sightings' AS part, fingerprint FROM sightings UNION ALL SELECT 'state', fingerprint FROM state
), counts AS (SELECT part, fingerprint, count(*) AS n FROM keys GROUP BY part, fingerprint)
SELECT part, sum(n)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS n_repeated,
       CASE WHEN max(n) > 1 THEN max(n) ELSE 0 END AS most FROM counts GROUP BY part""",
        "seen_top20": _OFFER_FIRST
        + "SELECT last_score AS score, company, title, source, fingerprint FROM fresh"
        + " ORDER BY last_score DESC, fingerprint LIMIT 20",
        "route_instant": _OFFER_FIRST
        + f"SELECT fingerprint, title, score FROM fresh WHERE score >= {INSTANT}",
        "route_digest": _OFFER_ALERTS + "SELECT fingerprint, title, score FROM digest",
        "digest_cap": _OFFER_ALERTS + "SELECT fingerprint, title, score FROM capped",
        "notified_set": _OFFER_ALERTS + "SELECT fingerprint, route FROM chosen",
        "format_alert": _OFFER_FIRST + f"SELECT fingerprint, {_TEXT} AS text FROM fresh",
        "alerts": _OFFER_ALERTS
        + f"""SELECT CASE route WHEN 'instant' THEN 1 ELSE 2 END AS section, 1 AS is_alert,
       fingerprint, {_TEXT} AS text FROM chosen
UNION ALL SELECT 1, 0, NULL, chr(10) || '=== INSTANT (high match) ==='
FROM fresh WHERE score >= {INSTANT} HAVING count(*) > 0
UNION ALL SELECT 2, 0, NULL, chr(10) || '=== DIGEST (medium match) ==='
FROM digest HAVING count(*) > 0""",
        "board_payload_rows": _PAGES
        + "SELECT token, landed_pos, pos::INTEGER AS pos, url AS absolute_url FROM job",
        "boards_join": _PAGES
        + "SELECT token, company, board_ord, page_id AS landed_pos FROM page JOIN board USING (token)",
        "map_posting": _PAGES
        + """SELECT board_ord, landed_pos, pos::INTEGER AS pos, title, company, location, url,
       'pages' AS source, remote, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
       md5(description) AS description_md5, 0 AS n_tags, url AS raw_url
FROM mapped JOIN board USING (token) WHERE title <> '' AND url <> ''""",
        "required_filter": _PAGES
        + "SELECT landed_pos, pos::INTEGER AS pos, title, url FROM job"
        + " WHERE title <> '' AND url <> ''",
        "poly_location": _PAGES + "SELECT landed_pos, pos::INTEGER AS pos, location FROM job",
        "assemble_description": _PAGES
        + "SELECT landed_pos, pos::INTEGER AS pos, length(description)::INTEGER AS n_chars,"
        + " md5(description) AS text_md5 FROM job",
        "remote_flag": _PAGES + "SELECT landed_pos, pos::INTEGER AS pos, remote FROM mapped",
        "parse_utc": """WITH base AS (
  SELECT o_orderkey, o_orderkey % 9 AS form,
         date_trunc('day', o_orderdate) + to_seconds(o_orderkey % 86400) AS stamp FROM orders
)
SELECT o_orderkey, strftime(CASE form
  WHEN 0 THEN stamp
  WHEN 1 THEN stamp
  WHEN 2 THEN stamp - INTERVAL 330 MINUTE
  WHEN 3 THEN stamp + INTERVAL 210 MINUTE
  WHEN 4 THEN date_trunc('day', stamp)
  WHEN 5 THEN date_trunc('minute', stamp) + INTERVAL 1439 MINUTE
  WHEN 6 THEN stamp + INTERVAL 500 MILLISECOND END, '%Y-%m-%d %H:%M:%S.%f') AS parsed
FROM base""",
        "union_sources": _with(PAGES, OFFERS)
        + """SELECT 0 AS source_ord, 'pages' AS source, company, title, url,
       NULL::BIGINT AS doc_id, NULL::BIGINT AS l_orderkey
FROM job JOIN board USING (token) WHERE title <> '' AND url <> ''
UNION ALL SELECT 1, 'documents', lang, source, 'https://docs.example/' || sha256(text), doc_id, NULL
FROM documents
UNION ALL SELECT 2, source, company, title, url, NULL, l_orderkey FROM offers""",
        "source_isolation": _PAGES
        + "SELECT source, title, url, 0 AS board_ord, landed_pos, pos::INTEGER AS pos FROM isolated",
        "source_quarantine": _PAGES
        + "SELECT host AS source, 'title is not text' AS reject, 0 AS board_ord, landed_pos,"
        + " 0 AS pos FROM bad",
        "source_counts": _PAGES
        + """SELECT source, n_posts, source || ': ' || n_posts || ' posts' AS message FROM (
  SELECT hosts.host AS source, count(isolated.source) AS n_posts
  FROM (SELECT DISTINCT host FROM page) hosts LEFT JOIN isolated ON isolated.source = hosts.host
  GROUP BY hosts.host)""",
    }
