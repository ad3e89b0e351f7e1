"""DuckDB SQL computing the same result as each registered query.

Written independently of the Spark code, over the driver's base tables: the
fixture views of ``sources/fixtures.py`` are restated here as SQL CTEs
(whole texts), and each key's SELECT follows the reference semantics.  Fixed
vocabularies (keywords, aliases, flags) are expanded from ``dims`` into CASE
expressions so both sides use the same fixed values.

Numeric conventions shared with the Spark side: ``esum`` sums each term fixed
to 6 decimals as an integer (order-independent), ``pyround`` is round-half-even
on the scaled double (Python ``round``).
"""

from __future__ import annotations

from .. import dims

CANON = "(" + ", ".join(f"'{r}'" for r in dims.CANONICAL_REGIONS) + ")"
REGIONS_VALUES = (
    "(VALUES " + ", ".join(f"('{r}', {i}, {dims.LEADER_ORDER.index(r)})" for i, r in enumerate(dims.CANONICAL_REGIONS)) + ") AS rg(region, region_ord, leader_ord)"
)
AUTH_RX = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
SCHEME_RX = r"^([A-Za-z][A-Za-z0-9+.-]*):"
HREF_RX = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']""".replace("'", "''")
PY_WS = "(" + " || ".join(f"chr({ord(ch)})" for ch in map(chr, range(0x3001)) if ch.isspace()) + ")"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    """Python str.strip(): trim every whitespace code point."""
    return f"trim({x}, {PY_WS})"


ENTITIES = [("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def esum(x: str) -> str:
    """Order-independent sum: exact decimals."""
    return f"CAST(sum(CAST({x} AS DECIMAL(38,12))) AS DOUBLE)"


def pyround(x: str, d: int) -> str:
    """Correctly rounded decimals, by the formatting routine rather than by scaling."""
    return f"CAST(printf('%.{d}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def norm(x: str) -> str:
    alias = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in dims.REGION_ALIASES.items())
    return (
        f"(CASE WHEN {x} IS NULL OR {x} = '' THEN {x} WHEN {x} IN {CANON} THEN {x} "
        f"ELSE coalesce(CASE lower({strip(x)}) {alias} END, {x}) END)"
    )


def score(title: str = "title", summary: str = "summary") -> str:
    t = f"(coalesce({title}, '') || ' ' || coalesce({summary}, ''))"
    parts = []
    for kws, w, low in (
        (dims.HIGH_PRIORITY, dims.HIGH_WEIGHT, True),
        (dims.MEDIUM_PRIORITY, dims.MEDIUM_WEIGHT, True),
        (dims.HIGH_PRIORITY_INTL, dims.HIGH_WEIGHT, False),
        (dims.MEDIUM_PRIORITY_INTL, dims.MEDIUM_WEIGHT, False),
    ):
        for k in kws:
            if low:
                parts.append(f"CASE WHEN contains(lower({t}), {q(k.lower())}) THEN {w} ELSE 0 END")
            else:
                parts.append(f"CASE WHEN contains({t}, {q(k)}) THEN {w} ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def quarter(d: str) -> str:
    p = f"try_strptime({d}, '%Y-%m-%d')"
    return f"coalesce(strftime({p}, '%Y') || '-Q' || CAST(quarter({p}) AS VARCHAR), 'unknown')"


def trunc(x: str, n: int = 200) -> str:
    c = f"coalesce({x}, '')"
    return f"(CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END)"


def any_contains(x: str, words, lower: bool = True) -> str:
    c = f"lower({x})" if lower else x
    return "(" + " OR ".join(f"contains({c}, {q(w.lower() if lower else w)})" for w in words) + ")"


def count_present(x: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({x}, {q(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def status(val_col: str, three_way: bool) -> str:
    val = f"lower({strip(f'coalesce(CAST({val_col} AS VARCHAR), {q(chr(48))})')})"
    clean = strip(f"replace({val}, '%', '')")
    num_rx = r"^[+-]?((\d+(\.\d*)?)|(\.\d+))([eE][+-]?\d+)?$"
    nan_rx = r"^[+-]?nan$"
    inf_rx = r"^[+-]?inf(inity)?$"
    is_num = f"(regexp_matches({clean}, {q(num_rx)}) OR regexp_matches({clean}, {q(nan_rx)}) OR regexp_matches({clean}, {q(inf_rx)}))"
    num = (
        f"(CASE WHEN regexp_matches({clean}, {q(nan_rx)}) THEN CAST('NaN' AS DOUBLE) "
        f"WHEN regexp_matches({clean}, {q(inf_rx)}) THEN (CASE WHEN starts_with({clean}, '-') THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END) "
        f"ELSE TRY_CAST({clean} AS DOUBLE) END)"
    )
    done = f"(NOT isnan({num}) AND ({num} >= 100.0 OR ({num} >= 1.0 AND NOT contains({val}, '%'))))"
    if not three_way:
        return (
            f"(CASE WHEN {is_num} THEN (CASE WHEN {done} THEN 'Completed' ELSE 'In Progress' END) "
            f"WHEN {any_contains(val, dims.COMPLETED_WORDS, False)} THEN 'Completed' ELSE 'In Progress' END)"
        )
    post = f"((NOT isnan({num}) AND {num} < 0) OR contains({val}, 'postpone') OR contains({val}, 'delay'))"
    return (
        f"(CASE WHEN {is_num} THEN (CASE WHEN {done} THEN 'completed' WHEN {post} THEN 'postponed' ELSE 'in_progress' END) "
        f"WHEN {any_contains(val, dims.COMPLETED_WORDS, False)} THEN 'completed' "
        f"WHEN {any_contains(val, dims.POSTPONED_WORDS, False)} THEN 'postponed' ELSE 'in_progress' END)"
    )


def case_mod(key: str, values) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


TITLES = [
    "6G deployment plans", "Release 21 update", "TERAHERTZ research", "Weather report",
    "6세대 이동통신 기술", "第6世代移動通信", "Radio", "16GB memory",
]
PROFILE_REGIONS = ["US", "EU", "China", "Japan", "Korea", "India", "South Korea", " usa ", "Other"]
TARGETS = ["US", "EU", "China", "Japan", "South Korea", "India", "Mars"]

FIXTURES = f"""
fx_entries AS (
  SELECT doc_id AS entry_ord, source, CAST(substr(source, 4) AS INTEGER) AS feed_ord, lang,
    CASE WHEN doc_id % 50 = 7 THEN ''
         ELSE 'https://news.example.org/a/' || CAST(doc_id
              - CASE WHEN doc_id % 10 = 9 THEN 1 WHEN doc_id % 100 = 45 THEN 20 ELSE 0 END AS VARCHAR) END AS link,
    {case_mod('doc_id % 8', TITLES)} AS title,
    CASE WHEN doc_id % 8 = 6 THEN 'spectrum ' ELSE '' END || text
      || CASE doc_id % 5 WHEN 0 THEN ' IMT-2030 roadmap' WHEN 1 THEN ' millimeter wave' ELSE '' END AS summary,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(DATE '2024-06-30' - CAST(doc_id % 60 AS INTEGER) AS TIMESTAMP) END AS published
  FROM documents),
fx_profiles AS (
  SELECT doc_id, doc_id % 17 <> 0 AS present,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 <> 0 END AS is_relevant,
    {case_mod('doc_id % 9', PROFILE_REGIONS)} AS region_raw,
    CAST(doc_id % 10 + 1 AS DOUBLE) AS importance,
    CAST(DATE '2024-01-01' + CAST(doc_id % 182 AS INTEGER) AS VARCHAR) AS date,
    CAST((doc_id * 3) % 6 AS DOUBLE) AS research_intensity, CAST((doc_id * 5 + 1) % 6 AS DOUBLE) AS standardization_influence,
    CAST((doc_id * 7 + 2) % 6 AS DOUBLE) AS industrial_deployment, CAST((doc_id + 3) % 6 AS DOUBLE) AS spectrum_policy_signal,
    CAST((doc_id * 11 + 4) % 6 AS DOUBLE) AS ecosystem_maturity
  FROM documents),
fx_targets AS (
  SELECT d.doc_id, u.target, CAST((d.doc_id * u.k + u.k - 1) % 6 AS DOUBLE) AS score
  FROM documents d, unnest([{", ".join(q(t) for t in TARGETS)}]) WITH ORDINALITY AS u(target, k)),
fx_terms AS (
  SELECT doc_id, 0 AS pos, 'concept' || CAST(doc_id % 13 AS VARCHAR) AS term FROM documents
  UNION ALL SELECT doc_id, 1 AS pos, 'concept' || CAST((doc_id * doc_id) % 29 AS VARCHAR) AS term FROM documents),
fx_seen AS (
  SELECT md5('https://news.example.org/a/' || CAST(doc_id AS VARCHAR)) AS article_id,
    'https://news.example.org/a/' || CAST(doc_id AS VARCHAR) AS url,
    CASE WHEN doc_id % 30 = 0 THEN 'not-a-date' ELSE CAST(DATE '2024-06-30' - CAST(doc_id % 365 AS INTEGER) AS VARCHAR) END AS processed_date
  FROM documents WHERE doc_id % 3 = 0),
fx_reports AS (
  SELECT doc_id AS meeting_id, CASE doc_id % 3 WHEN 0 THEN 'RAN1' WHEN 1 THEN 'SA2' ELSE 'RAN2' END AS working_group,
    text || '. Meeting held in Berlin, Germany on ' || CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS VARCHAR)
    || CASE doc_id % 4 WHEN 0 THEN '. Agreed: use R1-2312345 and S2-2401234' WHEN 1 THEN '. The item was postponed, rejected'
         WHEN 2 THEN '. Not agreed, further study needed' ELSE '' END AS content
  FROM documents),
fx_work_items AS (
  SELECT o_orderkey AS unique_id, CASE o_orderkey % 4 WHEN 0 THEN 'Rel-21' WHEN 1 THEN 'Rel-20' WHEN 2 THEN 'release 21' ELSE 'Rel-21' END AS release,
    CASE WHEN o_orderkey % 19 = 0 THEN 'nan' ELSE substr(o_orderpriority, 3) END AS resource_names,
    {case_mod('o_orderkey % 9', ["100%", "1", "0.5", "50", "1%", "nan", "", "Postponed", "Approved"])} AS completion
  FROM orders),
fx_articles AS (
  SELECT e.entry_ord, e.feed_ord, md5(e.link) AS article_id, e.source, e.lang, e.title, e.link, {score('e.title', 'e.summary')} AS score,
    p.present, p.is_relevant, p.region_raw, p.importance, p.date, e.summary, e.published,
    p.research_intensity, p.standardization_influence, p.industrial_deployment, p.spectrum_policy_signal, p.ecosystem_maturity,
    'concept' || CAST(e.entry_ord % 13 AS VARCHAR) AS t0, 'concept' || CAST((e.entry_ord * e.entry_ord) % 29 AS VARCHAR) AS t1
  FROM fx_entries e JOIN fx_profiles p ON p.doc_id = e.entry_ord),
fx_pairs AS (
  SELECT a.entry_ord, a.date, a.region_raw, {norm('a.region_raw')} AS source, {norm('t.target')} AS target, t.score, a.importance AS w
  FROM fx_articles a JOIN fx_targets t ON t.doc_id = a.entry_ord
  WHERE a.present AND coalesce(a.is_relevant, false) AND {norm('a.region_raw')} IN {CANON}
    AND {norm('t.target')} IN {CANON} AND t.score > 0),
fx_grid AS (
  SELECT u.source, v.target FROM unnest([{", ".join(q(r) for r in dims.CANONICAL_REGIONS)}]) AS u(source),
    unnest([{", ".join(q(r) for r in dims.CANONICAL_REGIONS)}]) AS v(target)),
fx_regions AS (SELECT * FROM {REGIONS_VALUES}),
fx_meetings AS (
  SELECT CAST(meeting_id AS VARCHAR) AS meeting_id, working_group,
    coalesce({", ".join(f"nullif(regexp_extract(content, {q(p)}, 1), '')" for p in ["(?i)" + d for d in dims.DATE_PATTERNS])}, '') AS date,
    {strip("coalesce(" + ", ".join(f"nullif(regexp_extract(content, {q(p)}, 1), '')" for p in [
        r"(?:held\s+in|location:|venue:)\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?\s*[A-Z][a-z]+)",
        r"([A-Z][a-z]+,\s*[A-Z][a-z]+)(?:\s+meeting)",
    ]) + ", '')")} AS location,
    list_transform(list_filter(list_transform(string_split_regex(content, '[.!?\\n]+'), lambda x: {strip('x')}),
        lambda x: x <> '' AND {any_contains('x', dims.AGREEMENT_KEYWORDS)}), lambda x: substr(x, 1, 200)) AS all_agreements,
    list_slice(all_agreements, 1, 10) AS agreements,
    list_sort(list_distinct(regexp_extract_all(content, '((?:{"|".join(dims.TDOC_PREFIXES)})-\\d{{7}})', 1))) AS all_tdocs,
    list_slice(all_tdocs, 1, 20) AS tdocs,
    {count_present('lower(content)', dims.SENTIMENT_POSITIVE)} AS n_pos,
    {count_present('lower(content)', dims.SENTIMENT_NEUTRAL)} AS n_neu,
    {count_present('lower(content)', dims.SENTIMENT_NEGATIVE)} AS n_neg
  FROM fx_reports),
fx_meetings2 AS (
  SELECT *, CASE WHEN n_pos + n_neu + n_neg = 0 THEN 'neutral' WHEN n_pos > n_neg AND n_pos > n_neu THEN 'positive'
    WHEN n_neg > n_pos THEN 'negative' ELSE 'mixed' END AS sentiment FROM fx_meetings),
fx_items AS (
  SELECT {strip('CAST(unique_id AS VARCHAR)')} AS name, '' AS title, {strip("coalesce(release, '')")} AS release,
    {strip("coalesce(resource_names, '')")} AS working_group, {status('completion', False)} AS status
  FROM fx_work_items),
fx_totals AS (
  SELECT CASE WHEN GROUPING(working_group) = 1 THEN 'total' ELSE 'group' END AS level, working_group,
    count(*) AS total, count(*) FILTER (WHERE lower(status) = 'completed') AS completed,
    count(*) FILTER (WHERE lower(status) <> 'completed' AND NOT (contains(lower(status), 'postpone') OR contains(lower(status), 'delay') OR contains(lower(status), 'suspend'))) AS in_progress,
    count(*) FILTER (WHERE lower(status) <> 'completed' AND (contains(lower(status), 'postpone') OR contains(lower(status), 'delay') OR contains(lower(status), 'suspend'))) AS postponed
  FROM fx_items WHERE release = 'Rel-21' GROUP BY GROUPING SETS ((), (working_group))),
fx_totals2 AS (
  SELECT *, CASE WHEN total > 0 THEN {pyround('completed / total * 100.0', 1)} ELSE 0.0 END AS progress FROM fx_totals),
fx_cands AS (
  SELECT * FROM fx_articles WHERE coalesce(link, '') <> '' AND (published IS NULL OR published >= TIMESTAMP '2024-05-31 00:00:00') AND score >= 2),
fx_new AS (
  SELECT c.* FROM fx_cands c
  WHERE c.article_id NOT IN (SELECT article_id FROM fx_seen) AND (NOT c.present OR coalesce(c.is_relevant, true))),
fx_new2 AS (
  SELECT n.* FROM fx_new n JOIN (SELECT article_id, min(feed_ord) AS m FROM fx_new GROUP BY article_id) f
    ON f.article_id = n.article_id WHERE n.feed_ord = f.m)
"""


def momentum_sql(where: str = "TRUE", src: str = "fx_articles") -> str:
    dimsum = " + ".join(dims.DIMENSIONS)
    wm = lambda v: f"coalesce({pyround(f'{esum(f"({v}) * w")} / nullif({esum("w")}, 0)', 2)}, 0.0)"
    return f"""(
  SELECT region, time_window, {wm('m')} AS momentum_score, {", ".join(f"{wm(d)} AS {d}" for d in dims.DIMENSIONS)}
  FROM (SELECT {norm('region_raw')} AS region, {quarter('date')} AS time_window, coalesce(importance, 1.0) AS w,
          ({dimsum}) / 5 AS m, {", ".join(dims.DIMENSIONS)}
        FROM {src} WHERE present AND coalesce(is_relevant, false) AND {norm('region_raw')} IN {CANON} AND ({where}))
  GROUP BY region, time_window)"""


def influence_sql(where: str = "TRUE") -> str:
    return f"""(
  SELECT g.source, g.target, coalesce(s.weight, 0.0) AS weight
  FROM fx_grid g LEFT JOIN (
    SELECT source, target, {esum('score * w')} AS weight FROM fx_pairs WHERE {where} GROUP BY source, target
  ) s ON s.source = g.source AND s.target = g.target)"""


def snapshots_sql(where: str) -> str:
    return f"""(
  SELECT strftime(date_trunc('month', CAST(date AS DATE)), '%Y-%m-%d') AS date, source, target, {esum('score * w')} AS weight
  FROM fx_pairs WHERE {where} GROUP BY 1, 2, 3)"""


HISTORY = f"""
hist AS (SELECT * FROM {snapshots_sql('TRUE')} WHERE date <= '2024-03-01'),
newsnap AS (SELECT * FROM {snapshots_sql('TRUE')} WHERE date >= '2024-03-01'),
snaps AS (SELECT * FROM hist UNION ALL SELECT * FROM newsnap WHERE date NOT IN (SELECT date FROM hist))
"""

RECENT = """
recent_in AS (
  SELECT article_id, entry_ord, date, title, CASE WHEN entry_ord % 2 = 1 THEN 1 ELSE 0 END AS side
  FROM fx_articles WHERE coalesce(link, '') <> '' AND article_id IS NOT NULL),
recent_merged AS (
  SELECT article_id, entry_ord, date FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY side DESC, entry_ord DESC) AS rn FROM recent_in) WHERE rn = 1)
"""

MOMENTUM_ROWS = f"mom AS {momentum_sql()}"

LATEST = f"""
{MOMENTUM_ROWS},
latest AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY time_window DESC) AS rn FROM mom) WHERE rn = 1)
"""

REGIONAL = f"""
ragg AS (
  SELECT t.target AS region, {esum('t.score')} AS total_score, count(*) FILTER (WHERE t.score > 0) AS article_mentions
  FROM fx_targets t JOIN fx_profiles p ON p.doc_id = t.doc_id WHERE p.present AND t.target IN {CANON} GROUP BY t.target),
rm AS (
  SELECT r.region, r.leader_ord, coalesce(a.total_score, 0.0) AS total_score, coalesce(a.article_mentions, 0) AS article_mentions,
    CASE WHEN coalesce(a.article_mentions, 0) > 0 THEN {pyround('a.total_score / a.article_mentions', 2)} ELSE 0.0 END AS average_impact
  FROM fx_regions r LEFT JOIN ragg a ON a.region = r.region),
leader AS (
  SELECT CASE WHEN bool_or(total_score <> 0) THEN (SELECT region FROM rm ORDER BY total_score DESC, leader_ord LIMIT 1) ELSE 'None' END AS leader FROM rm)
"""

TERMS_PRESENT = "(SELECT t.* FROM fx_terms t JOIN fx_profiles p ON p.doc_id = t.doc_id WHERE p.present)"

PAGE_LINKS = f"""
links AS (
  SELECT p.page_id, CAST(u.pos - 1 AS INTEGER) AS pos, u.href
  FROM pages p, unnest(regexp_extract_all(p.html, '{HREF_RX}', 1)) WITH ORDINALITY AS u(href, pos))
"""


def html_text(h: str) -> str:
    x = f"coalesce({h}, '')"
    x = f"regexp_replace({x}, '(?is)<script\\b.*?</script\\s*>', chr(1), 'g')"
    x = f"regexp_replace({x}, '(?is)<style\\b.*?</style\\s*>', chr(1), 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(1), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', chr(1), 'g')"
    dec = "t"

    # the references that the test tables hold, the ampersand last
    for a, b in ENTITIES:
        dec = f"replace({dec}, {q(a)}, {q(b)})"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(1)), lambda t: {strip(dec)}), lambda t: t <> ''), ' ')"


def safe(u: str) -> str:
    return f"(CASE WHEN lower(regexp_extract(coalesce({u}, ''), {q(SCHEME_RX)}, 1)) IN ('http', 'https') AND regexp_extract(coalesce({u}, ''), {q(AUTH_RX)}, 1) <> '' THEN {u} ELSE '#' END)"


def with_(*ctes: str) -> str:
    body = ",\n".join([FIXTURES.strip()] + [c.strip() for c in ctes])
    return "WITH " + body + "\n"


CAND_SQL = "SELECT * FROM fx_cands"
WM = ", ".join(dims.DIMENSIONS)

ORACLE: dict[str, str] = {
    # 2.1
    "feed_health": with_(
        "reg AS (SELECT 'src' || CAST(i AS VARCHAR) AS source FROM range(25) t(i))",
        "per AS (SELECT source, count(*) AS n_entries, count(*) FILTER (WHERE coalesce(link, '') <> '') AS n_with_link FROM fx_entries GROUP BY source)",
    )
    + """SELECT r.source, coalesce(p.n_entries, 0) AS n_entries, coalesce(p.n_with_link, 0) AS n_with_link,
  CASE WHEN coalesce(p.n_entries, 0) = 0 THEN 'missing' WHEN coalesce(p.n_with_link, 0) = 0 THEN 'empty' ELSE 'ok' END AS status
FROM reg r LEFT JOIN per p ON p.source = r.source""",
    "matrix_densify": with_() + f"""SELECT s.region AS source, t.region AS target, coalesce(m.weight, 0.0) AS weight
FROM (SELECT region FROM fx_regions UNION ALL SELECT 'Mars') s CROSS JOIN (SELECT region FROM fx_regions UNION ALL SELECT 'Mars') t
LEFT JOIN {influence_sql()} m ON m.source = s.region AND m.target = t.region""",
    "page_links": with_(PAGE_LINKS) + "SELECT page_id, pos, href FROM links",
    "fallback_if_empty": with_(
        "arts AS (SELECT * FROM fx_articles WHERE coalesce(link, '') <> '')",
        "late AS (SELECT article_id, date FROM arts WHERE date > '2024-06-30')",
        "prim AS (SELECT article_id, date FROM arts WHERE date > '2024-06-01')",
        "cached AS (SELECT article_id, date FROM arts WHERE coalesce(date, '0000-00-00') >= '2024-04-01' ORDER BY date DESC, entry_ord LIMIT 50)",
    )
    + """SELECT article_id, date, 'live' AS data_source, 'empty' AS primary_side FROM late
UNION ALL SELECT article_id, date, 'cached' AS data_source, 'empty' AS primary_side FROM cached WHERE NOT EXISTS (SELECT 1 FROM late)
UNION ALL SELECT article_id, date, 'live' AS data_source, 'filled' AS primary_side FROM prim
UNION ALL SELECT article_id, date, 'cached' AS data_source, 'filled' AS primary_side FROM cached WHERE NOT EXISTS (SELECT 1 FROM prim)""",
    # 2.2
    "digest_lines": with_(
        "kept AS (SELECT * FROM fx_cands WHERE NOT present OR coalesce(is_relevant, true))",
        "body AS (SELECT * FROM kept WHERE link NOT IN (SELECT url FROM fx_seen))",
        f"""lines AS (
  SELECT source, entry_ord, 1 AS line_no, '### [' || coalesce(title, 'No Title') || '](' || coalesce(link, '#') || ')' AS line FROM body
  UNION ALL SELECT source, entry_ord, 2, '> **Relevance Score:** '
    || CASE WHEN present THEN CAST(score AS VARCHAR) || ' (AI Impact: ' || CAST(importance AS VARCHAR) || ')' ELSE CAST(score AS VARCHAR) END
    || CASE WHEN published IS NOT NULL THEN ' | 📅 ' || strftime(published, '%Y-%m-%d') ELSE '' END FROM body
  UNION ALL SELECT source, entry_ord, 3, CASE WHEN present THEN 'Profile: ' || title ELSE {trunc('summary')} END FROM body
  UNION ALL SELECT source, entry_ord, 4, '---' FROM body)""",
    )
    + """SELECT source, CAST(-1 AS BIGINT) AS entry_ord, 0 AS line_no, '## ' || source || ' — 2024-06-30' AS line FROM (SELECT DISTINCT source FROM kept)
UNION ALL SELECT source, entry_ord, line_no, line FROM lines WHERE NOT (line_no = 3 AND coalesce(line, '') = '')""",
    # 2.3
    "filter_has_link": with_() + "SELECT entry_ord, link FROM fx_entries WHERE coalesce(link, '') <> ''",
    "filter_recent": with_() + "SELECT entry_ord FROM fx_entries WHERE published IS NULL OR published >= TIMESTAMP '2024-05-31 00:00:00'",
    "filter_relevance": with_() + f"SELECT entry_ord, {score()} AS score FROM fx_entries WHERE {score()} >= 2",
    "gate_profile": with_() + "SELECT entry_ord FROM fx_articles WHERE NOT present OR coalesce(is_relevant, true)",
    "filter_aggregable": with_() + "SELECT entry_ord FROM fx_articles WHERE present AND coalesce(is_relevant, false)",
    "filter_canonical_region": with_() + f"SELECT entry_ord, {norm('region_raw')} AS region FROM fx_articles WHERE present AND {norm('region_raw')} IN {CANON}",
    "filter_positive_target": with_() + f"SELECT doc_id, {norm('target')} AS target, score FROM fx_targets WHERE {norm('target')} IN {CANON} AND score > 0",
    "filter_release_exact": with_() + "SELECT name, release FROM fx_items WHERE release = 'Rel-21'",
    "filter_release_fuzzy": with_() + f"SELECT name, release FROM fx_items WHERE {any_contains('coalesce(release, ' + q('') + ')', dims.RELEASE_21_MARKERS)}",
    "fetch_is_html": with_()
    + """SELECT page_id, (contains(lower(coalesce(html, '')), 'incapsula') OR contains(lower(coalesce(html, '')), 'cloudflare')
  OR (contains(lower(coalesce(html, '')), '<html') AND NOT contains(substr(lower(coalesce(html, '')), 1, 100), '<?xml'))) AS is_html FROM pages""",
    "fetch_is_blocked": with_() + f"SELECT page_id, {any_contains('coalesce(html, ' + q('') + ')', dims.BLOCK_PHRASES)} AS is_blocked FROM pages",
    "evict_stale": with_()
    + "SELECT article_id, processed_date FROM fx_seen WHERE coalesce(datediff('day', CAST(try_strptime(processed_date, '%Y-%m-%d') AS DATE), DATE '2024-06-30') <= 180, true)",
    "search_dashboard": with_()
    + """SELECT entry_ord FROM fx_articles WHERE source = 'src3' AND (
  contains(lower(coalesce(title, '')), 'concept1')
  OR contains(lower(CASE WHEN present AND coalesce('Profile: ' || title, '') <> '' THEN 'Profile: ' || title ELSE coalesce(summary, '') END), 'concept1')
  OR contains(lower(CASE WHEN present THEN t0 || ' ' || t1 ELSE '' END), 'concept1'))""",
    # 2.4
    "url_hash": with_() + "SELECT entry_ord, md5(link) AS article_id FROM fx_entries",
    "relevance_score": with_() + f"SELECT entry_ord, {score()} AS score FROM fx_entries",
    "article_project": with_()
    + """SELECT article_id, source, coalesce(title, '') AS title, link, coalesce(score, 0) AS score,
  CASE WHEN present THEN coalesce(region_raw, 'Other') ELSE 'Other' END AS source_region, coalesce(summary, '') AS summary,
  coalesce(strftime(published, '%Y-%m-%d'), '2024-06-30') AS date,
  CASE WHEN present THEN importance END AS importance, CASE WHEN present THEN coalesce(importance, 0.0) END AS impact_score
FROM fx_articles WHERE coalesce(link, '') <> ''""",
    "pub_date": with_() + "SELECT entry_ord, coalesce(strftime(published, '%Y-%m-%d'), '2024-06-30') AS pub_date FROM fx_entries",
    "impact_score": with_() + "SELECT entry_ord, CASE WHEN present THEN coalesce(importance, 0.0) END AS impact_score FROM fx_articles",
    "display_impact": with_()
    + """SELECT entry_ord,
  CASE WHEN present AND importance <> 0 THEN importance WHEN score <> 0 THEN CAST(score AS DOUBLE) END AS impact,
  CASE WHEN present AND importance <> 0 THEN 'Impact' WHEN score <> 0 THEN 'Relevance' ELSE 'Impact' END AS impact_label
FROM fx_articles""",
    "display_summary": with_() + "SELECT entry_ord, CASE WHEN present THEN 'Profile: ' || title ELSE summary END AS display_summary FROM fx_articles",
    "truncate_text": with_() + f"SELECT entry_ord, {trunc('summary')} AS short_summary, substr(coalesce(summary, ''), 1, 200) AS snippet FROM fx_entries",
    "normalize_region": with_() + f"SELECT doc_id, region_raw, {norm('region_raw')} AS region FROM fx_profiles",
    "quarter_label": with_() + f"SELECT doc_id, {quarter('date')} AS time_window FROM fx_profiles",
    "mean_numeric_map": with_() + f"SELECT doc_id, ({' + '.join(dims.DIMENSIONS)}) / 5 AS dim_mean FROM fx_profiles WHERE present",
    "region_flag": with_()
    + "SELECT doc_id, CASE WHEN NOT present THEN '🌍' ELSE coalesce(CASE region_raw "
    + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in dims.REGION_FLAGS.items())
    + " END, '🌍') END AS flag FROM fx_profiles",
    "escape_html": with_()
    + """SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""",
    "safe_url": with_(PAGE_LINKS)
    + f"SELECT page_id, pos, {safe('href')} AS safe_url FROM links UNION ALL SELECT page_id, -1 AS pos, {safe('url')} AS safe_url FROM pages",
    "url_domain": with_() + f"SELECT page_id, regexp_extract(coalesce(url, ''), {q(AUTH_RX)}, 1) AS domain FROM pages",
    "html_to_text": with_() + f"SELECT page_id, {html_text('html')} AS text FROM pages",
    "extract_date": with_() + "SELECT CAST(meeting_id AS BIGINT) AS meeting_id, date FROM fx_meetings",
    "extract_agreements": with_()
    + "SELECT CAST(meeting_id AS BIGINT) AS meeting_id, CAST(u.pos - 1 AS INTEGER) AS pos, u.agreement FROM fx_meetings, unnest(all_agreements) WITH ORDINALITY AS u(agreement, pos)",
    "extract_tdocs": with_() + "SELECT CAST(meeting_id AS BIGINT) AS meeting_id, unnest(all_tdocs) AS tdoc FROM fx_meetings",
    "sentiment": with_() + "SELECT CAST(meeting_id AS BIGINT) AS meeting_id, sentiment, n_pos, n_neu, n_neg FROM fx_meetings2",
    "parse_meeting_reports": with_()
    + """SELECT meeting_id, working_group, date, location, CAST(len(agreements) AS INTEGER) AS n_agreements,
  array_to_string(agreements, ' | ') AS agreements, array_to_string(tdocs, ',') AS tdocs, sentiment, 'live' AS data_source FROM fx_meetings2""",
    "work_item_status_a": with_() + f"SELECT unique_id AS name, completion, {status('completion', False)} AS status FROM fx_work_items",
    "work_item_status_b": with_() + f"SELECT unique_id AS name, completion, {status('completion', True)} AS status FROM fx_work_items",
    "map_work_items": with_() + "SELECT name, title, release, working_group, status FROM fx_items",
    "briefing_context": with_(
        f"topics AS (SELECT term AS topic, count(*) AS c FROM {TERMS_PRESENT} GROUP BY term ORDER BY c DESC, topic LIMIT 5)"
    )
    + """SELECT (SELECT count(*) FROM fx_articles) AS article_count,
  (SELECT coalesce(string_agg(topic, ', ' ORDER BY c DESC, topic), '') FROM topics) AS top_topics,
  coalesce((SELECT progress FROM fx_totals2 WHERE level = 'total'), 0.0) AS progress_percentage""",
    # 2.5
    "anti_seen": with_()
    + "SELECT entry_ord, md5(link) AS article_id FROM fx_entries WHERE coalesce(link, '') <> '' AND md5(link) NOT IN (SELECT article_id FROM fx_seen)",
    "dedup_cross_feed": with_("e AS (SELECT entry_ord, md5(link) AS article_id, feed_ord FROM fx_entries WHERE coalesce(link, '') <> '')")
    + "SELECT e.entry_ord, e.article_id, e.feed_ord FROM e JOIN (SELECT article_id, min(feed_ord) AS m FROM e GROUP BY article_id) f ON f.article_id = e.article_id WHERE e.feed_ord = f.m",
    "bypass_lookup": with_()
    + f"SELECT entry_ord, coalesce(source IN ('src3', 'src7'), false) AS bypass, (coalesce(source IN ('src3', 'src7'), false) OR {score()} >= 2) AS passes FROM fx_entries",
    "enrich_join": with_()
    + "SELECT c.entry_ord, p.doc_id IS NOT NULL AS has_profile, p.importance FROM fx_cands c LEFT JOIN (SELECT doc_id, importance FROM fx_profiles WHERE present) p ON p.doc_id = c.entry_ord",
    "alias_lookup": with_() + f"SELECT doc_id, {norm('region_raw')} AS region FROM fx_profiles",
    "upsert_momentum": with_(f"old AS {momentum_sql('entry_ord % 2 = 0')}", f"new AS {momentum_sql('entry_ord % 2 = 1')}")
    + "SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.region = o.region AND n.time_window = o.time_window)",
    "accumulate_matrix": with_(f"old AS {influence_sql('entry_ord % 2 = 0')}", f"new AS {influence_sql('entry_ord % 2 = 1')}")
    + f"SELECT source, target, {esum('weight')} AS weight FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY source, target",
    "upsert_recent": with_(RECENT) + "SELECT article_id, entry_ord, date FROM recent_merged",
    "append_snapshot_if_absent": with_(HISTORY) + "SELECT date, source, target, weight FROM snaps",
    "matrix_as_of": with_(HISTORY, f"cur AS {influence_sql()}")
    + """SELECT source, target, weight, 'snapshot' AS origin FROM snaps WHERE date = '2024-02-01'
UNION ALL SELECT source, target, weight, 'current' AS origin FROM cur WHERE NOT EXISTS (SELECT 1 FROM snaps WHERE date = '2024-02-01')""",
    "discover_new_sources": with_(
        PAGE_LINKS,
        "hits AS (SELECT l.page_id, l.pos, l.href AS url, p.url AS title, p.html AS snippet FROM links l JOIN pages p ON p.page_id = l.page_id)",
        "cand AS (SELECT * FROM hits WHERE coalesce(url, '') <> '' AND url NOT IN (SELECT url FROM hits WHERE page_id % 2 = 0))",
    )
    + """SELECT url, title, '2024-06-30' AS discovered_at, substr(coalesce(snippet, ''), 1, 200) AS relevance_snippet
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rn FROM cand) WHERE rn = 1""",
    # 2.6
    "momentum": with_() + f"SELECT * FROM {momentum_sql()}",
    "influence_matrix": with_() + f"SELECT * FROM {influence_sql()}",
    "region_article_counts": with_()
    + f"""SELECT r.region, coalesce(c.n, 0) AS article_count FROM fx_regions r LEFT JOIN (
  SELECT {norm('region_raw')} AS region, count(*) AS n FROM fx_articles
  WHERE present AND coalesce(is_relevant, false) AND {norm('region_raw')} IN {CANON} GROUP BY 1) c ON c.region = r.region""",
    "regional_momentum": with_(REGIONAL) + "SELECT region, total_score, article_mentions, average_impact FROM rm",
    "regional_leader": with_(REGIONAL) + "SELECT leader FROM leader",
    "concept_counts": with_() + f"SELECT term AS concept, count(*) AS frequency FROM {TERMS_PRESENT} GROUP BY term HAVING count(*) >= 2",
    "topic_frequency": with_()
    + f"SELECT term AS topic, count(*) AS frequency FROM {TERMS_PRESENT} GROUP BY term ORDER BY frequency DESC, min(doc_id * 2 + pos) LIMIT 8",
    "distinct_concepts": with_() + f"SELECT DISTINCT term AS concept FROM {TERMS_PRESENT}",
    "evidence_flat": with_() + f"SELECT doc_id AS article_ord, CAST(pos AS INTEGER) AS pos, term AS evidence FROM {TERMS_PRESENT}",
    "distinct_sources": with_() + "SELECT DISTINCT source FROM fx_entries",
    "is_quiet": with_() + "SELECT count(*) = 0 AS is_quiet FROM fx_new2",
    "work_item_totals": with_() + "SELECT level, working_group, total, completed, in_progress, postponed, progress FROM fx_totals2",
    "work_items_by_group": with_(
        f"""wb AS (SELECT upper(coalesce(resource_names, 'Other')) AS working_group, {status('completion', True)} AS status
  FROM fx_work_items WHERE {any_contains('coalesce(release, ' + q('') + ')', dims.RELEASE_21_MARKERS)})""",
        """wbt AS (SELECT CASE WHEN GROUPING(working_group) = 1 THEN 'total' ELSE 'group' END AS level, working_group,
  count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'postponed') AS postponed
  FROM wb GROUP BY GROUPING SETS ((), (working_group)))""",
    )
    + f"SELECT level, working_group, total, completed, in_progress, postponed, CASE WHEN total > 0 THEN {pyround('completed / total * 100.0', 1)} ELSE 0.0 END AS progress FROM wbt",
    "outbound_influence": with_(HISTORY) + f"SELECT date, source, {esum('weight')} AS outbound FROM snaps GROUP BY date, source",
    "progress_series": with_(
        """yi AS (SELECT strftime(date_trunc('year', o.o_orderdate), '%Y-%m-%d') AS date, i.status FROM fx_items i
  JOIN orders o ON i.name = CAST(o.o_orderkey AS VARCHAR) WHERE i.release = 'Rel-21')"""
    )
    + f"SELECT date, coalesce({pyround('count(*) FILTER (WHERE lower(status) = ' + q('completed') + ') / count(*) * 100.0', 1)}, 0.0) AS progress FROM yi GROUP BY date",
    "run_metrics": with_("u AS (SELECT source, 1 AS f, 0 AS k FROM fx_entries UNION ALL SELECT source, 0 AS f, 1 AS k FROM fx_new2)")
    + "SELECT source, CAST(sum(f) AS BIGINT) AS fetched_entries, CAST(sum(k) AS BIGINT) AS new_articles FROM u GROUP BY ROLLUP (source)",
    "domain_best_method": with_(
        f"""log AS (SELECT url, NOT {any_contains('coalesce(html, ' + q('') + ')', dims.BLOCK_PHRASES)} AS success,
  CASE WHEN page_id % 2 = 0 THEN 'httpx' ELSE 'playwright' END AS method_used, page_id AS fetched_at FROM pages)"""
    )
    + f"SELECT regexp_extract(coalesce(url, ''), {q(AUTH_RX)}, 1) AS domain, arg_max(method_used, fetched_at) AS method FROM log WHERE success GROUP BY 1",
    # 2.7
    "sort_within_source": with_() + "SELECT entry_ord, feed_ord, score FROM fx_cands",
    "rolling_recent": with_(RECENT)
    + "SELECT article_id, entry_ord, date FROM recent_merged WHERE coalesce(date, '0000-00-00') >= '2024-04-01' ORDER BY date DESC, entry_ord LIMIT 50",
    "top_meetings_per_group": with_("md AS (SELECT working_group, 'TSGR_' || CAST(meeting_id AS VARCHAR) || '/' AS meeting_dir FROM fx_reports)")
    + "SELECT working_group, meeting_dir FROM (SELECT *, row_number() OVER (PARTITION BY working_group ORDER BY meeting_dir DESC) AS rn FROM md) WHERE rn <= 3",
    "first_report_file": "",
    "latest_per_region": with_(LATEST) + f"SELECT region, time_window, momentum_score, {WM} FROM latest",
    "sort_momentum": with_(MOMENTUM_ROWS) + "SELECT region, time_window, momentum_score FROM mom",
    "sort_meetings": with_() + "SELECT meeting_id, date FROM fx_meetings",
    # 2.8
    "union_groups": with_() + "SELECT meeting_id, working_group FROM fx_meetings WHERE working_group IN ('RAN1', 'SA2', 'RAN2')",
    "pivot_momentum": with_(MOMENTUM_ROWS)
    + """SELECT g.region, g.time_window, m.momentum_score
FROM (SELECT region, unnest(['2023-Q4', '2024-Q1', '2024-Q2']) AS time_window FROM fx_regions) g
LEFT JOIN mom m ON m.region = g.region AND m.time_window = g.time_window""",
    "pivot_matrix": with_(f"mx AS {influence_sql()}")
    + "SELECT r.region AS source, "
    + ", ".join(
        f"CAST(floor(coalesce(max(CASE WHEN mx.target = {q(t)} THEN mx.weight END), 0.0) + 0.5) AS BIGINT) AS \"{t}\"" for t in dims.CANONICAL_REGIONS
    )
    + " FROM fx_regions r LEFT JOIN mx ON mx.source = r.region GROUP BY r.region",
    "radar_rows": with_(LATEST)
    + " UNION ALL ".join(
        f"SELECT region, {q(d)} AS dimension, {q(l)} AS label, coalesce({d}, 0.0) AS value FROM latest"
        for d, l in zip(dims.DIMENSIONS, dims.DIMENSION_LABELS)
    ),
    # 2.10
    "q_latest_news": with_(
        "imp AS (SELECT entry_ord, article_id, CASE WHEN present THEN coalesce(importance, 0.0) ELSE 0.0 END AS importance FROM fx_articles)"
    )
    + "SELECT entry_ord, article_id, importance FROM imp WHERE importance >= 5",
    "q_release_status": with_()
    + """SELECT coalesce(max(progress) FILTER (WHERE level = 'total'), 0.0) AS progress_percentage,
  coalesce(max(completed) FILTER (WHERE level = 'total'), 0) AS completed, coalesce(max(total) FILTER (WHERE level = 'total'), 0) AS total_work_items,
  coalesce(max(in_progress) FILTER (WHERE level = 'total'), 0) AS in_progress, coalesce(max(postponed) FILTER (WHERE level = 'total'), 0) AS postponed,
  '2024-06-30' AS last_updated, 'live' AS data_source, count(*) FILTER (WHERE level = 'group') AS working_groups,
  coalesce(string_agg(g, ';' ORDER BY g) FILTER (WHERE level = 'group'), '') AS work_items_by_group
FROM (SELECT *, coalesce(working_group, '') || '/' || total || '/' || completed || '/' || in_progress || '/' || postponed AS g FROM fx_totals2)""",
    "q_recent_meetings": with_() + "SELECT meeting_id, working_group, date, sentiment FROM fx_meetings2 WHERE working_group = 'RAN1'",
    "q_search_topics": with_(
        "imp AS (SELECT *, CASE WHEN present THEN coalesce(importance, 0.0) ELSE 0.0 END AS imp FROM fx_articles)"
    )
    + """SELECT entry_ord, imp AS importance FROM imp WHERE imp >= 3 AND (
  (present AND (contains(lower(t0), 'concept1') OR contains(lower(t1), 'concept1')))
  OR contains(lower(coalesce(title, '')), 'concept1') OR contains(lower(coalesce(summary, '')), 'concept1'))""",
    "q_regional_momentum": with_(REGIONAL)
    + "SELECT region, total_score, article_mentions, average_impact, (SELECT leader FROM leader) AS leader, '2024-06-30' AS date FROM rm",
    "q_emerging_concepts": with_() + f"SELECT term AS concept, count(*) AS frequency FROM {TERMS_PRESENT} GROUP BY term HAVING count(*) >= 2",
}

# -- star-schema scale runs ---------------------------------------------------

STAR = """
star AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, strftime(o.o_orderdate, '%Y-%m-%d') AS date,
    rc.r_name AS cust_region, rs.r_name AS supp_region
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation nc ON c.c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation ns ON s.s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey),
star_rows AS (
  SELECT supp_region AS region, cust_region, date, l_quantity AS w,
    CAST(l_linenumber AS DOUBLE) AS research_intensity, CAST(l_quantity % 6 AS DOUBLE) AS standardization_influence,
    CAST(l_partkey % 6 AS DOUBLE) AS industrial_deployment, CAST(l_suppkey % 6 AS DOUBLE) AS spectrum_policy_signal,
    CAST(l_orderkey % 6 AS DOUBLE) AS ecosystem_maturity
  FROM star)
"""


def _star_wm(v: str) -> str:
    return f"coalesce({pyround(f'{esum(f"({v}) * w")} / nullif({esum("w")}, 0)', 2)}, 0.0)"


TPCH = "('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')"
ORACLE["momentum_star"] = (
    "WITH " + STAR.strip() + "\n"
    + f"SELECT region, {quarter('date')} AS time_window, {_star_wm('(' + ' + '.join(dims.DIMENSIONS) + ') / 5')} AS momentum_score, "
    + ", ".join(f"{_star_wm(d)} AS {d}" for d in dims.DIMENSIONS)
    + f" FROM star_rows WHERE region IN {TPCH} GROUP BY region, time_window"
)
ORACLE["influence_star"] = (
    "WITH " + STAR.strip() + ",\n"
    + "g AS (SELECT u.source, v.target FROM unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']) AS u(source), "
    + "unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST']) AS v(target)),\n"
    + f"sm AS (SELECT region AS source, cust_region AS target, {esum('1.0 * w')} AS weight FROM star_rows WHERE region IN {TPCH} AND cust_region IN {TPCH} GROUP BY 1, 2)\n"
    + "SELECT g.source, g.target, coalesce(sm.weight, 0.0) AS weight FROM g LEFT JOIN sm ON sm.source = g.source AND sm.target = g.target"
)

# -- listing, file, fetch-log and model-text views ---------------------------

LISTING = """
fx_listing AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'RAN1' WHEN 1 THEN 'SA2' ELSE 'RAN2' END AS working_group,
    CASE WHEN doc_id % 10 = 0 THEN 'Templates/'
         ELSE 'TSG' || CASE doc_id % 3 WHEN 0 THEN 'R1' WHEN 1 THEN 'S2' ELSE 'R2' END || '_' || CAST(doc_id AS VARCHAR) || '/' END AS href
  FROM documents),
fx_dirs AS (SELECT * FROM fx_listing WHERE regexp_matches(href, '^TSG[RS]\\d+_\\d+/'))
"""

REPORT_FILES = """
fx_report_files AS (
  SELECT doc_id, CAST(u.pos - 1 AS INTEGER) AS pos, u.href FROM documents, unnest([
    'Agenda_' || CAST(doc_id AS VARCHAR) || '.txt',
    CASE doc_id % 4 WHEN 0 THEN 'Final_Report_' || CAST(doc_id AS VARCHAR) || '.htm'
      WHEN 1 THEN 'Draft_' || CAST(doc_id AS VARCHAR) || '.doc'
      WHEN 2 THEN 'summary_' || CAST(doc_id AS VARCHAR) || '.pdf'
      ELSE 'notes_' || CAST(doc_id AS VARCHAR) || '.txt' END,
    'Report_' || CAST(doc_id AS VARCHAR) || '.html']) WITH ORDINALITY AS u(href, pos)),
fx_reportable AS (
  SELECT * FROM fx_report_files
  WHERE regexp_matches(lower(href), '\\.htm|\\.html|\\.doc|\\.pdf') AND regexp_matches(lower(href), 'report|summary|final'))
"""

WORK_PLAN_FILES = """
fx_wp_files AS (
  SELECT doc_id,
    CASE doc_id % 3 WHEN 0 THEN 'Work_plan_3gpp_' || CAST(doc_id + 240000 AS VARCHAR) || '.xlsx'
      WHEN 1 THEN 'archive/work_plan_3gpp_' || CAST(doc_id AS VARCHAR) || '.XLSX'
      ELSE 'readme_' || CAST(doc_id AS VARCHAR) || '.txt' END AS href
  FROM documents),
fx_wp_names AS (SELECT doc_id, string_split(href, '/')[-1] AS file_name FROM fx_wp_files)
"""

FETCH_LOG = """
fx_fetch_log AS (
  SELECT page_id, url, page_id % 5 <> 1 AS success, html AS content,
    CASE page_id % 5 WHEN 1 THEN 403 WHEN 2 THEN 429 ELSE 200 END AS status_code,
    CASE page_id % 5 WHEN 1 THEN 'Forbidden' WHEN 3 THEN 'Bot check failed' END AS error,
    CASE WHEN page_id % 7 = 0 THEN 'application/rss+xml' ELSE 'text/html' END AS content_type
  FROM pages)
"""

SCHEME = "[A-Za-z][A-Za-z0-9+.-]*"


def resolve_sql(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, '^({SCHEME}://[^/?#]*)', 1)"
    folder = f"regexp_extract({base}, '^({SCHEME}://[^/?#]*/(?:[^?#]*/)?)', 1)"
    return (
        f"(CASE WHEN {href} IS NULL OR {href} = '' THEN {base} "
        f"WHEN regexp_matches({href}, '^{SCHEME}:') THEN {href} "
        f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^({SCHEME}):', 1) || ':' || {href} "
        f"WHEN starts_with({href}, '/') THEN {origin} || {href} "
        f"WHEN starts_with({href}, '?') OR starts_with({href}, '#') THEN regexp_extract({base}, '^([^?#]*)', 1) || {href} "
        f"ELSE (CASE WHEN {folder} <> '' THEN {folder} ELSE {origin} || '/' END) || {href} END)"
    )


def attr(tag: str, name: str) -> str:
    return f"""regexp_extract({tag}, '(?i)\\b{name}\\s*=\\s*["'']([^"'']*)["'']', 1)"""


def html_is_page(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    return f"(contains({low}, 'incapsula') OR contains({low}, 'cloudflare') OR (contains({low}, '<html') AND NOT contains(substr({low}, 1, 100), '<?xml')))"


FEED_TYPES = "(" + ", ".join(q(t) for t in dims.FEED_LINK_TYPES) + ")"
ALT_LINKS = (
    "list_filter(regexp_extract_all(coalesce(content, ''), '(?is)<link\\b[^>]*>', 0), lambda t: "
    f"contains(lower({attr('t', 'rel')}), 'alternate') AND {attr('t', 'type')} IN {FEED_TYPES} AND {attr('t', 'href')} <> '')"
)

MODEL_REGION = case_mod("doc_id % 9", PROFILE_REGIONS)

ORACLE.update(
    {
        "extract_location": with_() + "SELECT CAST(meeting_id AS BIGINT) AS meeting_id, location FROM fx_meetings",
        "filter_meeting_dirs": with_(LISTING) + "SELECT working_group, href FROM fx_dirs",
        "dir_name_trim": with_(LISTING) + "SELECT doc_id, regexp_replace(href, '/+$', '') AS name FROM fx_listing",
        "listing_to_meetings": with_(LISTING)
        + """SELECT regexp_replace(href, '/+$', '') AS meeting_id, working_group, '2024-06-30' AS date, 'TBD' AS location,
  0 AS n_agreements, 'neutral' AS sentiment, 'live' AS data_source
FROM (SELECT *, row_number() OVER (PARTITION BY working_group ORDER BY href DESC) AS rn FROM fx_dirs) WHERE rn <= 3""",
        "filter_report_files": with_(REPORT_FILES) + "SELECT doc_id, pos, href FROM fx_reportable",
        "content_kind": with_(REPORT_FILES)
        + """SELECT doc_id, report_file, CASE WHEN regexp_matches(lower(report_file), '\\.htm|\\.html') THEN 'html' ELSE 'text' END AS content_kind
FROM (SELECT doc_id, arg_min(href, pos) AS report_file FROM fx_reportable GROUP BY doc_id)""",
        "filter_work_plan_files": with_(WORK_PLAN_FILES)
        + "SELECT doc_id, file_name FROM fx_wp_names WHERE starts_with(lower(file_name), 'work_plan_3gpp_') AND ends_with(lower(file_name), '.xlsx')",
        "latest_by_name": with_(WORK_PLAN_FILES)
        + "SELECT max(file_name) AS file_name FROM fx_wp_names WHERE regexp_matches(file_name, '(?i)^Work_plan_3gpp_\\d+\\.xlsx$')",
        "resolve_url": with_(PAGE_LINKS) + f"SELECT l.page_id, l.pos, {resolve_sql('p.url', 'l.href')} AS resolved FROM links l JOIN pages p ON p.page_id = l.page_id",
        "fetch_needs_fallback": with_(FETCH_LOG)
        + f"""SELECT page_id, (status_code IN (403, 429) OR contains(lower(coalesce(error, '')), 'bot') OR contains(lower(coalesce(error, '')), 'cloudflare')
  OR (coalesce(success, false) AND {html_is_page('content')})) AS needs_fallback FROM fx_fetch_log""",
        "feed_autodiscovery": with_(FETCH_LOG)
        + f"""SELECT url, CASE WHEN contains(lower(content_type), 'xml') OR contains(lower(content_type), 'rss') THEN url
  WHEN len({ALT_LINKS}) > 0 THEN {resolve_sql('url', attr(ALT_LINKS + '[1]', 'href'))} END AS feed_url FROM fx_fetch_log""",
        "unpivot_matrix": with_() + f"SELECT * FROM {influence_sql()}",
        "build_prompt": with_()
        + "SELECT entry_ord, 'Site: ' || coalesce(source, '') || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Summary: ' || coalesce(summary, '') || chr(10) || 'Return {json}.' AS prompt FROM fx_entries",
        "parse_profile": with_()
        + f"""SELECT doc_id, doc_id % 4 <> 3 AS has_profile,
  CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 5 IN (0, 1) THEN true ELSE false END AS is_6g_relevant,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE CAST(doc_id % 10 + 1 AS DOUBLE) END AS importance,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE {MODEL_REGION} END AS source_region,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 't' || CAST(doc_id % 3 AS VARCHAR) END AS topics
FROM documents""",
        "json_list_or_items": with_() + "SELECT user_id AS call_id, event_id AS ord, 0 AS pos, CAST(json(props) AS VARCHAR) AS item FROM events",
    }
)

ORACLE["first_report_file"] = with_(REPORT_FILES) + "SELECT doc_id, arg_min(href, pos) AS report_file FROM fx_reportable GROUP BY doc_id"

ORACLE["standards_bundle"] = (
    with_()
    + """SELECT 'progress' AS level, NULL AS key, coalesce(max(total) FILTER (WHERE level = 'total'), 0) AS total,
  coalesce(max(completed) FILTER (WHERE level = 'total'), 0) AS completed, coalesce(max(in_progress) FILTER (WHERE level = 'total'), 0) AS in_progress,
  coalesce(max(postponed) FILTER (WHERE level = 'total'), 0) AS postponed, coalesce(max(progress) FILTER (WHERE level = 'total'), 0.0) AS progress,
  '2024-06-30' AS last_updated, 'live' AS data_source, NULL AS working_group, NULL AS date, NULL AS sentiment, NULL AS agreements
FROM fx_totals2
UNION ALL
SELECT level, coalesce(working_group, ''), total, completed, in_progress, postponed, progress, NULL, NULL, NULL, NULL, NULL, NULL FROM fx_totals2 WHERE level = 'group'
UNION ALL
SELECT 'meeting', meeting_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, working_group, date, sentiment, array_to_string(agreements, ' | ') FROM fx_meetings2"""
)

# The extractors over HTML pages: the report view is defined anew, all views after it follow.
_start = FIXTURES.index("fx_reports AS (")
_end = FIXTURES.index("fx_work_items AS (")
_minutes = """'<div title="a > b"><p>Venue: Sophia Antipolis, France</p><p>Held on ' || CAST(DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER) AS VARCHAR)
    || '</p><!-- agreed: nothing --><p>agreed: R1-23' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') || ' &amp; S2-2401234</p><script>var x = ''rejected'';</script></div>'"""
# a tag whose quoted value holds ">" is cut out first: DuckDB's pattern ends a tag there
_content = html_text("replace(html || " + _minutes + """, '<div title="a > b">', '<div>')""")
HTML_REPORTS = f"fx_reports AS (\n  SELECT page_id AS meeting_id, 'RAN1' AS working_group, {_content} AS content FROM pages),\n"
ORACLE["parse_html_reports"] = ORACLE["parse_meeting_reports"].replace(FIXTURES[_start:_end], HTML_REPORTS)
