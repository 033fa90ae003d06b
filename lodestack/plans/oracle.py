"""The registered queries in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

from collections.abc import Iterable

from lodestack.functions import vocabulary as V
from lodestack.sources.fixture import DAY_MS, LISTS, NOW_MS, START_MS, SUFFIXES


def q(text: str | None) -> str:
    """A literal."""
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def pick(values: Iterable[str | None], number: str) -> str:
    values = list(values)
    return f"[{', '.join(map(q, values))}][(({number}) % {len(values)}) + 1]"


def any_of(text: str, phrases: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {q(p)})" for p in phrases) + ")"


def hits(text: str, phrases: Iterable[str]) -> str:
    """The phrases that occur, joined by bars."""
    return f"array_to_string(list_filter([{', '.join(map(q, phrases))}], lambda p: contains(lower({text}), p)), '|')"


STRIP = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '"'), '&#34;', '"'), '\s+', ' ', 'g'))"""

RANGE, HOURLY, SINGLE = V.SALARY_RANGE, V.SALARY_HOURLY, V.SALARY_SINGLE + r"\b"


def group(text: str, pattern: str, i: int) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {i})"


def amount(text: str, pattern: str, number: int, kilo: int | None = None) -> str:
    value = f"coalesce(try_cast(replace({group(text, pattern, number)}, ',', '') AS DOUBLE), 0.0)"
    return value if kilo is None else f"{value} * (CASE WHEN {group(text, pattern, kilo)} <> '' THEN 1000.0 ELSE 1.0 END)"


def currency(symbol: str) -> str:
    return f"CASE {symbol} WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' END"


def by_pattern(text: str, wide: str, hourly: str, single: str) -> str:
    return f"CASE WHEN regexp_matches({text}, {q(RANGE)}) THEN {wide} WHEN regexp_matches({text}, {q(HOURLY)}) THEN {hourly} WHEN regexp_matches({text}, {q(SINGLE)}) THEN {single} END"


T = "description_clean"
_year = f"{amount(T, HOURLY, 2)} * 2080"
PARSED_MIN = by_pattern(T, amount(T, RANGE, 2, 3), _year, amount(T, SINGLE, 2, 3))
PARSED_MAX = by_pattern(T, amount(T, RANGE, 5, 6), _year, amount(T, SINGLE, 2, 3))
PARSED_CURRENCY = by_pattern(T, currency(group(T, RANGE, 1)), currency(group(T, HOURLY, 1)), currency(group(T, SINGLE, 1)))

_low = f"lower(coalesce(location_raw, '') || ' ' || {T})"
REMOTE = rf"CASE WHEN regexp_matches({_low}, '\bremote\b') THEN 'remote' WHEN regexp_matches({_low}, '\bhybrid\b') THEN 'hybrid' WHEN regexp_matches({_low}, '\bon[-\s]?site\b') THEN 'onsite' ELSE 'unknown' END"
EMPLOYMENT = rf"CASE WHEN regexp_matches(lower({T}), '\bfull[-\s]?time\b') THEN 'full-time' WHEN regexp_matches(lower({T}), '\bpart[-\s]?time\b') THEN 'part-time' WHEN regexp_matches(lower({T}), '\bcontract\b') THEN 'contract' ELSE 'unknown' END"
COMPANY_KEY = rf"regexp_replace(regexp_replace(lower(coalesce(company_name, '')), '\b({'|'.join(V.COMPANY_FORMS)})\b\.?', '', 'g'), '[^a-z0-9]', '', 'g')"

POSTINGS = f"""
WITH ns AS (SELECT count(*) AS ns FROM supplier),
d AS (SELECT doc_id, CASE WHEN doc_id % 20 = 19 THEN doc_id - 1 ELSE doc_id END AS cid FROM documents),
raw AS (
  SELECT d.doc_id AS posting_id, CASE WHEN d.doc_id % 10 <> 7 THEN cid % ns END AS vec_id, cid,
         {START_MS} + CAST((((d.doc_id // 200) * 53 + d.doc_id * 37) % 200) AS BIGINT) * {DAY_MS} AS first_seen_at_ms,
         {pick(LISTS['title'], 'cid')} AS title,
         s_name || {pick(SUFFIXES, 'cid // ns')} AS company_name,
         '<p>' || {pick(LISTS['w'], 'cid')} || ' ' || {pick(LISTS['e'], 'cid')} || ' ' || {pick(LISTS['y'], 'cid')} || '</p><p>' ||
           {pick(LISTS['l'], 'cid')} || ' ' || {pick(LISTS['x'], 'cid')} || '</p><p>' || coalesce(t.text, '') || '</p>' AS description_html,
         {pick(LISTS['location'], 'cid')} AS location_raw,
         CAST(CASE WHEN cid % 6 = 0 THEN 85000 WHEN cid % 6 = 3 THEN 40000 END AS DOUBLE) AS src_min,
         CAST(CASE WHEN cid % 6 = 0 THEN 110000 WHEN cid % 6 = 3 THEN 50000 END AS DOUBLE) AS src_max,
         CASE WHEN cid % 3 = 0 THEN 'CAD' END AS src_currency
  FROM d JOIN documents t ON t.doc_id = d.cid CROSS JOIN ns LEFT JOIN supplier ON s_suppkey = cid % ns),
clean AS (SELECT *, {STRIP.format('description_html')} AS description_clean FROM raw),
p AS (
  SELECT *, coalesce(src_min, {PARSED_MIN}) AS salary_min, coalesce(src_max, {PARSED_MAX}) AS salary_max,
         coalesce(src_currency, {PARSED_CURRENCY}) AS salary_currency, {REMOTE} AS remote_claim, {EMPLOYMENT} AS employment_type,
         sha256(lower(trim(title)) || '|' || lower(trim(coalesce(company_name, ''))) || '|' || lower(substr(description_clean, 1, 500))) AS fingerprint
  FROM clean)
"""


def over(select: str, *more: str) -> str:
    """``select`` over the postings ``p`` and further CTEs."""
    return POSTINGS + "".join(f", {m}" for m in more) + "\n" + select


def place(names: Iterable[str]) -> str:
    words = "|".join(n.replace(".", r"\.") for n in names)
    return f"regexp_matches(lower(coalesce(location_raw, '')), {q(f'(^|[^a-zà-ÿ0-9])({words})($|[^a-zà-ÿ0-9])')})"


COUNTRY = f"CASE WHEN {place(V.CANADA_NAMES)} THEN 'CA' WHEN {place(V.US_NAMES)} THEN 'US' WHEN {place(V.CANADA_CODES)} THEN 'CA' WHEN {place(V.US_CODES)} THEN 'US' WHEN upper(trim(salary_currency)) = 'CAD' THEN 'CA' WHEN upper(trim(salary_currency)) = 'USD' THEN 'US' END"
FAMILY = "CASE " + " ".join(f"WHEN {any_of('title', words)} THEN {q(name)}" for name, words in V.ROLE_FAMILIES) + " END"
BAND = f"CASE WHEN {any_of('title', V.JUNIOR_TITLE_WORDS)} THEN 'junior' WHEN {any_of('title', V.SENIOR_TITLE_WORDS)} THEN 'senior' ELSE 'mid' END"
BENCH = "bench(country, currency, family, p25, median, p75) AS (VALUES " + ", ".join(f"({q(c)}, {q(k)}, {q(f)}, {a}, {b}, {d})" for c, k, f, a, b, d in V.SALARY_BENCHMARKS) + ")"
_point = lambda c: f"floor({c} * m / 100 + 0.5) * 100"
COMPARED = f"""named AS (SELECT *, {COUNTRY} AS country, {FAMILY} AS family, {BAND} AS band, CASE {BAND} WHEN 'junior' THEN 0.7 WHEN 'senior' THEN 1.3 ELSE 1.0 END AS m FROM p),
compared AS (
  SELECT named.*, bench.p25 IS NOT NULL AND coalesce(salary_min, salary_max) IS NOT NULL
           AND (salary_currency IS NULL OR upper(trim(salary_currency)) = bench.currency) AS comparable,
         CASE WHEN coalesce(salary_max, salary_min) < {_point('p25')} THEN 'below' WHEN coalesce(salary_min, salary_max) > {_point('p75')} THEN 'above' ELSE 'within' END AS where_it_is,
         {_point('p25')} AS b25, {_point('p75')} AS b75
  FROM named LEFT JOIN bench USING (country, family)),
placed AS (SELECT *, CASE WHEN comparable THEN where_it_is END AS position FROM compared)"""

VECTORS = """moved AS (
  SELECT posting_id, list_transform(range(0, len(embedding)), lambda i: CAST(embedding[i + 1] AS DOUBLE) + CASE WHEN i = (posting_id * 5) % len(embedding) THEN (posting_id % 7) / 10e0 ELSE 0e0 END) AS m
  FROM p JOIN embeddings ON embeddings.vec_id = p.vec_id % (SELECT count(*) FROM embeddings)),
v AS (SELECT posting_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS vec FROM moved)"""
KEYS = f"keyed AS (SELECT *, {COMPANY_KEY} AS key FROM p)"
PAIRS = "keys AS (SELECT DISTINCT key FROM keyed WHERE key <> ''), pairs AS (SELECT a.key AS a_key, b.key AS b_key FROM keys a JOIN keys b ON contains(a.key, b.key) OR contains(b.key, a.key))"
EXACT = """exact AS (
  SELECT a.posting_id, min(b.posting_id) AS canonical_id FROM p a JOIN p b ON a.fingerprint = b.fingerprint AND b.posting_id < a.posting_id GROUP BY a.posting_id)"""
NEAR = f"""near AS (
  SELECT posting_id, canonical_id, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY similarity DESC, canonical_id) AS rn FROM (
      SELECT a.posting_id, b.posting_id AS canonical_id, list_dot_product(a.vec, b.vec) AS similarity
      FROM w a JOIN pairs ON a.key = a_key JOIN w b ON b.key = b_key AND b.posting_id < a.posting_id)
    WHERE similarity >= {V.DUPLICATE_SIMILARITY}) WHERE rn = 1)"""
LINKS = f"""{EXACT}, {KEYS}, {PAIRS}, {VECTORS}, w AS (SELECT posting_id, key, vec FROM keyed JOIN v USING (posting_id)), {NEAR},
links AS (SELECT posting_id, canonical_id FROM exact UNION ALL SELECT posting_id, canonical_id FROM near WHERE posting_id NOT IN (SELECT posting_id FROM exact))"""
REPOSTS = f"""recent AS (
  SELECT canonical_id, count(*) AS n FROM links JOIN p USING (posting_id) WHERE first_seen_at_ms >= {NOW_MS - V.REPOST_WINDOW_MS} GROUP BY canonical_id),
reposts AS (
  SELECT p.posting_id, coalesce(n, 0) AS reposts FROM p LEFT JOIN links USING (posting_id) LEFT JOIN recent ON recent.canonical_id = coalesce(links.canonical_id, p.posting_id))"""

_text = "(title || chr(10) || description_clean)"
_title_years = "CASE " + " ".join(f"WHEN {any_of('title', words)} THEN {years}" for words, years in V.TITLE_YEARS) + " END"
ASKED = rf"coalesce(list_max(list_filter(list_transform(regexp_extract_all({_text}, '(?i)(\d+)\s*\+?\s*years?\s+(of\s+)?(experience|exp\b)', 1), lambda x: try_cast(x AS DOUBLE)), lambda x: x < 40)), {_title_years})"
SKILLS = f"len(list_filter([{', '.join(map(q, V.SKILL_WORDS))}], lambda s: contains(lower(description_clean), s)))"
YEARS = 4
CHANCE = f"""asked AS (SELECT p.*, reposts, CAST({ASKED} AS DOUBLE) AS asked, {SKILLS} AS skills FROM p JOIN reposts USING (posting_id)),
parts AS (
  SELECT *, CASE WHEN asked IS NULL THEN 0.5e0 WHEN asked <= 0 THEN 1.0e0 ELSE greatest(0.0e0, least(1.0e0, {YEARS}e0 / asked)) END AS seniority, 1 - least(0.5e0, 0.04e0 * skills) AS realism FROM asked),
chance AS (
  SELECT *, CAST(greatest(0, least(100, floor(greatest(0.0e0, least(1.0e0, (seniority * 0.3e0 + realism * 0.2e0) / (0.3e0 + 0.2e0) * (1 / (1 + 0.2e0 * reposts)))) * 100 + 0.5e0))) AS INTEGER) AS interview_chance FROM parts)"""
SECTIONS = "(" + " + ".join(f"CAST({any_of(T, words)} AS INTEGER)" for _, words in V.SECTION_GROUPS) + ") / 4.0e0"
CREDIBLE = f"CASE WHEN remote_claim = 'remote' AND {any_of(T, V.ONSITE_PHRASES)} THEN 0.3e0 WHEN remote_claim = 'remote' THEN 0.9e0 WHEN remote_claim = 'hybrid' THEN 0.7e0 WHEN remote_claim = 'onsite' THEN 1.0e0 ELSE 0.5e0 END"
QUALITY = f"""quality AS (
  SELECT posting_id, CAST(greatest(0, least(100, floor((CASE WHEN salary_min IS NULL THEN ({CREDIBLE} * 0.35e0 + {SECTIONS} * 0.4e0) / (0.35e0 + 0.4e0)
         ELSE (0.7e0 * 0.25e0 + {CREDIBLE} * 0.35e0 + {SECTIONS} * 0.4e0) / (0.25e0 + 0.35e0 + 0.4e0) END) * 100 + 0.5e0))) AS INTEGER) AS job_quality FROM p)"""
SCORES = f"""{LINKS}, {REPOSTS}, {CHANCE}, {QUALITY},
scores AS (SELECT posting_id, interview_chance, job_quality, CAST(floor(0.55e0 * interview_chance + 0.45e0 * job_quality + 0.5e0) AS INTEGER) AS combined FROM chance JOIN quality USING (posting_id))"""

FRENCH = f"len(list_filter(regexp_split_to_array(lower({_text}), '[^\\p{{L}}\\p{{M}}]+'), lambda t: list_contains([{', '.join(map(q, V.FRENCH_WORDS))}], t) OR regexp_matches(t, {q(V.FRENCH_LETTERS)})))"
QUEBEC = rf"({any_of(chr(99) + 'oalesce(location_raw, ' + q('') + ')', V.QUEBEC_PLACES)} OR regexp_matches(lower(coalesce(location_raw, '')), '\bqc\b') OR regexp_matches(lower(coalesce(location_raw, '')), '\b[ghj]\d[a-z]\s?\d[a-z]\d\b'))"
FLAGS = f"""flagged AS (
  SELECT posting_id, 'scam_risk' AS type, 'warning' AS severity FROM p WHERE {any_of(T, V.SCAM_HARD_PHRASES + V.SCAM_SOFT_PHRASES)}
  UNION ALL SELECT posting_id, 'fake_repost', 'warning' FROM reposts WHERE reposts >= 3
  UNION ALL SELECT posting_id, 'remote_misleading', 'warning' FROM p WHERE remote_claim = 'remote' AND {any_of(T, V.ONSITE_PHRASES)}
  UNION ALL SELECT posting_id, 'salary_below_market', CASE WHEN salary_min IS NULL THEN 'info' ELSE 'warning' END FROM placed WHERE salary_min IS NULL OR position = 'below' OR salary_min < 30000
  UNION ALL SELECT posting_id, 'toxic_culture', 'warning' FROM p WHERE {any_of(T, V.TOXIC_PHRASES)}
  UNION ALL SELECT posting_id, 'illegal_practice', 'warning' FROM p WHERE {any_of(T, V.ILLEGAL_PHRASES)}
  UNION ALL SELECT posting_id, 'staffing_intermediary', 'warning' FROM p WHERE {any_of(T, V.STAFFING_PHRASES)} OR {any_of("coalesce(company_name, '')", V.STAFFING_COMPANY_WORDS)}
  UNION ALL SELECT posting_id, 'quebec_language_law', 'warning' FROM p WHERE {QUEBEC} AND {FRENCH} < 10)"""


EVALUATED = "(SELECT posting_id, CASE posting_id % 5 WHEN 1 THEN 'knocked_out' WHEN 2 THEN 'needs_review' ELSE 'passed' END AS outcome FROM p WHERE posting_id % 5 <> 0)"
RATED = "(SELECT posting_id, CASE posting_id % 6 WHEN 1 THEN 'up' ELSE 'down' END AS label FROM p WHERE posting_id % 6 IN (1, 2))"


def _language() -> tuple[str, str]:
    """CTEs for required languages, and their name: one row per posting and language."""
    letter = r"[^\p{L}\p{M}]"
    every = "|".join(n for _, _, forms in V.LANGUAGES for n in forms)
    tests = []
    for code, _, forms in V.LANGUAGES:
        own = "|".join(sorted(forms, key=lambda n: -len(n)))
        wheres = [f"regexp_matches(low, {q(f'(^|{letter})(?:' + p.replace('{name}', f'(?:{own})') + f')($|{letter})')})" for p in V.LANGUAGE_PHRASES]
        for p in V.LANGUAGE_PAIR_PHRASES:
            for first, second in ((own, every), (every, own)):
                body = p.replace("({name})", f"(?:{first})", 1).replace("({name})", f"(?:{second})", 1)
                wheres.append(f"regexp_matches(low, {q(f'(^|{letter})(?:{body})($|{letter})')})")
        tests.append(f"SELECT posting_id, {q(code)} AS code FROM lowered WHERE {' OR '.join(wheres)}")
    return f"lowered AS (SELECT posting_id, lower({_text}) AS low FROM p), required AS ({' UNION ALL '.join(tests)})", "required"


LANGUAGES, _ = _language()
SPOKEN = ("en", "fr")
LANGUAGE_FAILS = f"(SELECT DISTINCT posting_id FROM required WHERE code NOT IN ({', '.join(map(q, SPOKEN))}))"

def unescaped(text: str) -> str:
    """The character references that the pages have, the ampersand's last."""
    for name, plain in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, {q(name)}, {q(plain)})"
    return text


def page_text(html: str) -> str:
    """Readable text of a page."""
    bare = rf"regexp_replace({html}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g')"
    return rf"trim(regexp_replace({unescaped(f"regexp_replace({bare}, '<[^>]+>', ' ', 'g')")}, '[\s\x{{85}}\x{{A0}}]+', ' ', 'g'))"


def _plain(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9à-ÿ]+', ' ', 'g'))"


def _phrase(words: str, phrase: str) -> str:
    return f"contains(' ' || {words} || ' ', ' ' || {phrase} || ' ')"


PAGES = f"""WITH paged AS (
  SELECT page_id, url, html, regexp_extract(url, '://(?:[a-z]+\\.)?([a-z-]+)\\.', 1) AS label, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, substr({page_text("html")}, 1, 6000) AS text FROM pages)"""

SQL: dict[str, str] = {
    "q01_strip_html": f"SELECT page_id, {STRIP.format('html')} AS text FROM pages",
    "q02_parse_salary": over(f"SELECT posting_id, {PARSED_MIN} AS parsed_min, {PARSED_MAX} AS parsed_max, {PARSED_CURRENCY} AS parsed_currency, salary_min, salary_max, salary_currency FROM p"),
    "q03_remote_claim": over("SELECT posting_id, remote_claim FROM p"),
    "q04_employment_type": over("SELECT posting_id, employment_type FROM p"),
    "q05_fingerprint": over("SELECT posting_id, fingerprint FROM p"),
    "q06_company_key": over(rf"SELECT posting_id, {COMPANY_KEY} AS dedupe_key, regexp_replace(lower(trim(company_name)), '\s+', ' ', 'g') AS intel_key FROM p"),
    "q07_field_predicates": over("""SELECT posting_id, coalesce(salary_min >= 80000, FALSE) AS at_least, coalesce(salary_min < 80000, FALSE) AS below,
       salary_min IS NOT NULL AS disclosed, location_raw IS NULL AS nowhere, remote_claim IN ('remote', 'hybrid') AS flexible, coalesce(contains(lower(company_name), 'staffing'), FALSE) AS staffing,
       title = 'Data Engineer' AS is_title, company_name IS NOT NULL AS not_a_number, FALSE AS text_is_number FROM p"""),
    "q08_pattern_any_all": over(f"""SELECT posting_id, {any_of(T, ['telegram', 'family', 'relocation'])} AS some, (contains(lower(description_clean), 'remote') AND contains(lower(description_clean), 'contract')) AS every,
       {hits(T, V.ONSITE_PHRASES)} AS onsite_hits FROM p"""),
    "q09_language_rule": over(
        f"SELECT posting_id, string_agg(code, '|' ORDER BY code) AS codes, posting_id NOT IN {LANGUAGE_FAILS} AS spoken FROM required GROUP BY posting_id", LANGUAGES
    ),
    "q10_cascade_outcome": over(
        f"""SELECT posting_id, CASE WHEN posting_id IN {LANGUAGE_FAILS} OR remote_claim = 'onsite' OR NOT coalesce(salary_min >= 40000, FALSE) OR similarity < 0.9 THEN 'knocked_out' WHEN similarity IS NULL THEN 'needs_review' ELSE 'passed' END AS outcome,
       CAST((CASE WHEN posting_id IN (SELECT posting_id FROM required) THEN 1 ELSE 0 END) + (CASE WHEN posting_id IN {LANGUAGE_FAILS} THEN 0 WHEN remote_claim = 'onsite' THEN 1 WHEN NOT coalesce(salary_min >= 40000, FALSE) THEN 2 ELSE 3 END) AS INTEGER) AS n_results
FROM (SELECT p.*, list_dot_product(v.vec, (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 3)) AS similarity FROM p LEFT JOIN v USING (posting_id))""",
        LANGUAGES,
        VECTORS,
    ),
    "q11_anti_join_existing": over("SELECT posting_id, external_id FROM (SELECT posting_id, CAST(posting_id AS VARCHAR) AS external_id FROM p) WHERE posting_id % 2 = 1"),
    "q12_fingerprint_links": over("SELECT posting_id, canonical_id FROM exact", EXACT),
    "q13_fuzzy_company_pairs": over("SELECT a_key, b_key FROM pairs", KEYS, PAIRS),
    "q14_semantic_links": over(
        "SELECT posting_id, canonical_id, round(similarity, 6) AS similarity FROM near",
        KEYS, PAIRS, VECTORS, "w AS (SELECT posting_id, key, vec FROM keyed JOIN v USING (posting_id))", NEAR,
    ),
    "q15_repost_counts": over("SELECT posting_id, CAST(reposts AS BIGINT) AS reposts, round(1 / (1 + 0.2 * reposts), 6) AS discount FROM reposts", LINKS, REPOSTS),
    "q16_country": over(f"SELECT posting_id, {COUNTRY} AS country FROM p"),
    "q17_role_band": over(f"SELECT posting_id, {FAMILY} AS role_family, {BAND} AS band FROM p"),
    "q18_salary_position": over("SELECT posting_id, position, CASE WHEN comparable THEN CAST(b25 AS DOUBLE) END AS p25, CASE WHEN comparable THEN CAST(b75 AS DOUBLE) END AS p75 FROM placed", BENCH, COMPARED),
    "q19_chance_score": over("SELECT posting_id, interview_chance, asked, CAST(skills AS INTEGER) AS skills FROM chance", LINKS, REPOSTS, CHANCE),
    "q20_quality_score": over("SELECT posting_id, job_quality FROM quality", QUALITY),
    "q21_combined_topk": over("SELECT posting_id, interview_chance, job_quality, combined FROM scores ORDER BY combined DESC, posting_id DESC LIMIT 50", SCORES),
    "q22_flags_long": over("SELECT posting_id, type, severity FROM flagged", LINKS, REPOSTS, BENCH, COMPARED, FLAGS),
    "q23_salary_flags": over("SELECT posting_id, CASE WHEN salary_min IS NULL THEN 'undisclosed' WHEN position = 'below' THEN 'below' ELSE 'floor' END AS reason FROM placed WHERE salary_min IS NULL OR position = 'below' OR salary_min < 30000", BENCH, COMPARED),
    "q24_quebec_flag": over(f"SELECT posting_id, {QUEBEC} AS quebec, CAST({FRENCH} AS INTEGER) AS french_signals FROM p"),
    "q25_flagged_anti_join": over("SELECT posting_id FROM p WHERE posting_id NOT IN (SELECT posting_id FROM flagged)", LINKS, REPOSTS, BENCH, COMPARED, FLAGS),
    "q26_label_gate": """SELECT n_up, n_down, n_up + n_down AS n_labels, n_up + n_down >= 20 AND n_up >= 5 AND n_down >= 5 AS ready
FROM (SELECT count(*) FILTER (quality = 1) AS n_up, count(*) FILTER (quality = 0) AS n_down FROM labels)""",
    "q27_ranked_list": over(
        f"""SELECT posting_id, combined, outcome, label, string_agg(type, '|' ORDER BY type) AS flags
FROM (SELECT * FROM p JOIN scores USING (posting_id) LEFT JOIN {EVALUATED} USING (posting_id) LEFT JOIN {RATED} USING (posting_id) ORDER BY combined DESC, posting_id DESC LIMIT 50) LEFT JOIN flagged USING (posting_id) GROUP BY posting_id, combined, outcome, label""",
        SCORES,
        BENCH,
        COMPARED,
        FLAGS,
    ),
    "q28_session_rank": over(
        """SELECT CAST(row_number() OVER (ORDER BY combined DESC, interview_chance DESC, posting_id DESC) AS INTEGER) AS rank, posting_id, combined, interview_chance, job_quality
FROM (SELECT * FROM p ORDER BY first_seen_at_ms DESC, posting_id DESC LIMIT 200) JOIN scores0 USING (posting_id)
WHERE remote_claim IN ('remote', 'hybrid') AND coalesce(salary_min >= 60000, FALSE) AND posting_id NOT IN (SELECT posting_id FROM flagged WHERE type = 'staffing_intermediary')
ORDER BY rank LIMIT 25""",
        LINKS,
        "reposts AS (SELECT posting_id, 0 AS reposts FROM p)",
        CHANCE,
        QUALITY,
        BENCH,
        COMPARED,
        FLAGS,
        "scores0 AS (SELECT posting_id, interview_chance, job_quality, CAST(floor(0.55e0 * interview_chance + 0.45e0 * job_quality + 0.5e0) AS INTEGER) AS combined FROM chance JOIN quality USING (posting_id))",
    ),
    "q29_upsert_latest": "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'",
    "q30_score_order": over("SELECT posting_id, CAST(row_number() OVER (ORDER BY CASE WHEN posting_id % 3 = 0 THEN 1 ELSE 0 END, posting_id) AS INTEGER) AS place FROM p ORDER BY place LIMIT 100"),
    "q31_redact_urls": f"SELECT page_id, regexp_replace(u, '([?&](?:{'|'.join(V.SECRET_PARAMETERS)})=)[^&#]*', '\\1***', 'gi') AS url FROM (SELECT page_id, CASE WHEN contains(url, '?') THEN regexp_replace(url, '\\?', '?Api_Key=s3cret&') ELSE url END AS u FROM pages)",
    "q32_domain_label": "SELECT page_id, CASE WHEN len(h) >= 2 THEN h[len(h) - 1] WHEN len(h) = 1 THEN h[1] ELSE '' END AS label FROM (SELECT page_id, list_filter(string_split(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':.*$', '')), '.'), lambda x: x <> '') AS h FROM pages)",
    "q33_page_identity": f"""{PAGES}, n AS (SELECT *, CASE page_id % 3 WHEN 0 THEN label WHEN 1 THEN label || ' Group Inc' ELSE label || ' the and Ltd' END AS company FROM paged),
m AS (SELECT a.page_id, b.company, {_plain("a.title || ' ' || a.url")} AS head, {_plain("substr(a.text, 1, 3000)")} AS early, {_plain("b.company")} AS name FROM n a JOIN n b ON b.page_id = (a.page_id + (a.page_id % 2)) % (SELECT count(*) FROM pages)),
t AS (SELECT *, list_filter(string_split(name, ' '), lambda x: x <> '' AND NOT list_contains([{', '.join(map(q, V.COMPANY_FORM_TOKENS))}], x)) AS tokens FROM m),
l AS (SELECT *, list_transform(tokens, lambda x: len(x)) AS sizes, array_to_string(list_transform(tokens, lambda x: x[1]), '') AS acronym FROM t),
k AS (SELECT *, tokens[list_position(sizes, list_max(sizes))] AS longest FROM l)
SELECT page_id, company, coalesce(name <> '' AND ({_phrase("head", "name")} OR {_phrase("early", "name")} OR (len(longest) >= 4 AND {_phrase("head", "longest")}) OR (len(tokens) >= 2 AND {_phrase("head", "acronym")})), FALSE) AS about FROM k""",
}

SQL |= {
    "q34_join_kinds": """SELECT CAST(o_custkey % 7 AS INTEGER) AS k, count(*) AS n_full, count(o_orderkey) AS n_orders, count(c_custkey) AS n_customers, round(sum(coalesce(o_totalprice, 0)), 2) AS total
FROM orders FULL JOIN customer ON o_custkey = c_custkey + (SELECT count(*) // 3 FROM customer) GROUP BY 1""",
    "q35_cube": """SELECT coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS g, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "q36_rollup_having": "SELECT coalesce(c_mktsegment, '-') AS segment, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment) HAVING count(*) > 10",
    "q37_window_frames": """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS quarter, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "q38_set_operations": "SELECT k, 'both' AS kind FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT k, 'none' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)",
    "q39_tumbling_window": "SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "q40_sessions": """SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2""",
    "q41_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "q42_regional_revenue": "SELECT r_name AS region, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
}
