"""The queries of the catalogue as DuckDB SQL, written on their own to check the results."""

from __future__ import annotations

import re

from leadlane import rules
from leadlane.plans import catalogue
from leadlane.sources.order_leads import ORDER_LEADS_SQL

_TEXT = ", ".join(
    f"CASE WHEN lower(trim({c})) IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-', '?') THEN NULL ELSE trim({c}) END AS {c}"
    for c in rules.COLUMNS
)


def _squeeze(c: str) -> str:
    return f"regexp_replace({c}, '\\s+', ' ', 'g')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _search(pattern: str) -> str:
    """RE2 has no lookbehind: the one pattern that needs it hides the text it must not follow."""
    if pattern.startswith("(?<!no )"):
        return f"regexp_matches(replace(note_text, 'no real budget', '#'), {_quote(pattern[len('(?<!no )'):])})"
    return f"regexp_matches(note_text, {_quote(pattern)})"


CTES: list[tuple[str, str]] = [
    ("raw_leads", ORDER_LEADS_SQL),
    ("cells", f"SELECT source_row, lead_id AS raw_id, created AS raw_created, notes AS raw_notes, {_TEXT} FROM raw_leads"),
    (
        "judged",
        f"""SELECT *, CASE
  WHEN coalesce({', '.join(rules.COLUMNS)}) IS NULL THEN 'blank_row'
  WHEN lower(lead_id) IN ('header', 'lead_id') OR (
    {' + '.join(f"coalesce(CAST(lower({c}) = '{c}' AS INT), 0)" for c in rules.COLUMNS)} > 0 AND
    2 * ({' + '.join(f"coalesce(CAST(lower({c}) = '{c}' AS INT), 0)" for c in rules.COLUMNS)})
      >= {' + '.join(f"CAST({c} IS NOT NULL AS INT)" for c in rules.COLUMNS)}) THEN 'embedded_header_row'
  WHEN lower(lead_id) IN ('testrow', 'test')
    OR regexp_matches(lower(notes), 'qa test entry|test test ignore|please ignore')
    OR (len([x FOR x IN [name, company, title, source] IF x IS NOT NULL]) >= 3
        AND len(list_distinct([lower(name), lower(company), lower(title), lower(source)])) = 1
        AND regexp_full_match(coalesce(name, company), '[A-Za-z]{{1,6}}')) THEN 'test_placeholder_row'
  END AS junk FROM cells""",
    ),
    (
        "parsed",
        f"""SELECT source_row, raw_id, raw_created, raw_notes, junk, lead_id AS lead_id_raw,
  nullif(regexp_extract(lead_id, '\\d{{2,}}'), '') AS lead_id_canonical,
  coalesce(regexp_matches(lead_id, '(?i)-dup$'), false) AS lead_id_is_explicit_dup,
  created AS created_cell,
  CAST(CASE
    WHEN regexp_full_match(created, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime(created, '%m/%d/%Y')
    WHEN regexp_full_match(created, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN try_strptime(created, '%m/%d/%y')
    WHEN regexp_full_match(created, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime(created, '%Y-%m-%d')
    WHEN regexp_full_match(created, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime(created, '%d-%m-%Y')
    WHEN regexp_full_match(created, '[A-Za-z]{{3}} \\d{{1,2}} \\d{{4}}') THEN try_strptime(created, '%b %d %Y')
  END AS DATE) AS created_date,
  {_squeeze('name')} AS name, {_squeeze('company')} AS company, {_squeeze('title')} AS title,
  lower({_squeeze('source')}) AS source, coalesce({_squeeze('notes')}, '') AS notes,
  replace(lower(regexp_replace(email, '(?i)\\s*[\\[(]\\s*at\\s*[\\])]\\s*', '@', 'g')), ' ', '') AS address,
  nullif(lower(rtrim(regexp_replace(regexp_replace(website, '(?i)^https?://', ''), '(?i)^www\\.', ''), '/')), '') AS website,
  CASE WHEN regexp_matches(employees, '\\d+\\s*-\\s*\\d+')
         THEN (CAST(regexp_extract(employees, '(\\d+)\\s*-\\s*(\\d+)', 1) AS DOUBLE)
             + CAST(regexp_extract(employees, '(\\d+)\\s*-\\s*(\\d+)', 2) AS DOUBLE)) / 2
       WHEN regexp_matches(employees, '~\\s*\\d+') THEN CAST(regexp_extract(employees, '~\\s*(\\d+)', 1) AS DOUBLE)
       WHEN regexp_matches(employees, '\\d+\\s*\\+') THEN CAST(regexp_extract(employees, '(\\d+)\\s*\\+', 1) AS DOUBLE)
       WHEN regexp_matches(employees, '\\d') THEN CAST(regexp_extract(employees, '\\d+') AS DOUBLE) END AS employees,
  trim(regexp_replace(regexp_replace(replace(replace(lower(monthly_budget), '$', ''), ',', ''),
    '/\\s*mo(nth)?\\b', '', 'g'), '\\bper\\s*month\\b', '', 'g')) AS budget_text
FROM judged""",
    ),
    (
        "cleaned",
        """SELECT * EXCLUDE (budget_text, address),
  CASE WHEN contains(address, '@') THEN address END AS email,
  coalesce(regexp_full_match(address, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'), false) AS email_valid,
  CASE WHEN lead_id_canonical IS NOT NULL THEN lead_id_raw ELSE 'ROW-' || CAST(source_row AS VARCHAR) END AS lead_id,
  coalesce(strftime(created_date, '%Y-%m-%d'), regexp_replace(created_cell, '\\s+', ' ', 'g'), '') AS created,
  CASE WHEN regexp_full_match(budget_text, '\\d+(\\.\\d+)?\\s*k?\\s*-\\s*\\d+(\\.\\d+)?\\s*k?')
    THEN CASE WHEN contains(budget_text, 'k') THEN 1000.0 ELSE 1.0 END::DOUBLE
      * (CAST(regexp_extract(budget_text, '^(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE)
       + CAST(regexp_extract(budget_text, '-\\s*(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE)) / 2
    WHEN regexp_full_match(budget_text, '\\d+(\\.\\d+)?\\s*k?')
    THEN CASE WHEN contains(budget_text, 'k') THEN 1000.0 ELSE 1.0 END::DOUBLE
      * CAST(regexp_extract(budget_text, '^(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) END AS monthly_budget
FROM parsed""",
    ),
    (
        "filled",
        "SELECT *, "
        + " + ".join(
            f"CAST({c} IS NOT NULL AS INT)" if c in ("employees", "monthly_budget") else f"CAST(coalesce({c}, '') <> '' AS INT)"
            for c in rules.COMPLETENESS_FIELDS
        )
        + " AS filled FROM cleaned",
    ),
    (
        "resolved",
        """SELECT *, lead_id_canonical IS NULL OR row_number() OVER pick = 1 AS is_primary,
  first_value(coalesce(lead_id_raw, lead_id_canonical)) OVER pick AS kept_label
FROM filled WHERE junk IS NULL
WINDOW pick AS (PARTITION BY lead_id_canonical
  ORDER BY contains(lower(notes), '(duplicate submission)'), filled DESC, created_date DESC NULLS LAST, source_row)""",
    ),
    ("kept", "SELECT * FROM resolved WHERE is_primary"),
    ("note_texts", "SELECT *, lower(notes) AS note_text FROM cleaned WHERE junk IS NULL"),
    (
        "note_hits",
        "SELECT source_row, note_text, "
        + ", ".join(f"{_search(p)} AS {r}" for r, p, _ in rules.HARD_DISQUALIFIERS)
        + ", "
        + ", ".join(f"{_search(p)} AS {t}" for t, _, _, p, _ in rules.INTENT_SIGNALS)
        + f", {_search(rules.NOT_AGENCY_PATTERN)} AS not_agency, {_search(rules.AGENCY_PATTERN)} AS agency,"
        + f" {_search(rules.ADJACENT_PATTERN)} AS adjacent FROM note_texts",
    ),
    (
        "hits",
        "SELECT *, " + " OR ".join(r for r, *_ in rules.HARD_DISQUALIFIERS) + " AS hard, "
        + "[x FOR x IN ["
        + ", ".join(f"CASE WHEN {r} THEN {_quote(r)} END" for r, *_ in rules.HARD_DISQUALIFIERS)
        + "] IF x IS NOT NULL] AS reasons, [x FOR x IN ["
        + ", ".join(f"CASE WHEN {r} THEN {_quote(label)} END" for r, _, label in rules.HARD_DISQUALIFIERS)
        + "] IF x IS NOT NULL] AS reason_labels FROM note_hits",
    ),
    (
        "signals",
        "SELECT *, CASE WHEN hard THEN [] ELSE [x FOR x IN ["
        + ", ".join(f"CASE WHEN {t} THEN {_quote(t)} END" for t, *_ in rules.INTENT_SIGNALS)
        + "] IF x IS NOT NULL] END AS tags, [x FOR x IN ["
        + ", ".join(f"CASE WHEN {t} THEN {_quote(label)} END" for t, *_, label in rules.INTENT_SIGNALS)
        + "] IF x IS NOT NULL] AS tag_labels, CAST(CASE WHEN hard THEN 0 ELSE "
        + " + ".join(f"CASE WHEN {t} THEN {w} ELSE 0 END" for t, w, *_ in rules.INTENT_SIGNALS)
        + " END AS DOUBLE) AS weights, CASE WHEN hard THEN 'cold' WHEN "
        + " OR ".join(t for t, _, s, *_ in rules.INTENT_SIGNALS if s == "sales_ready")
        + " THEN 'sales_ready' WHEN "
        + " OR ".join(t for t, _, s, *_ in rules.INTENT_SIGNALS if s == "warm")
        + """ THEN 'warm' ELSE 'cold' END AS stage,
  NOT hard AND NOT not_agency AND agency AS is_agency_icp,
  NOT hard AND (not_agency OR (NOT agency AND adjacent)) AS is_adjacent_icp FROM hits""",
    ),
    (
        "titles",
        """SELECT source_row, CASE WHEN title IS NULL THEN 'unknown'
  WHEN regexp_matches(lower(title), '\\b(student|freelancer|developer|recruiter|intern)\\b') THEN 'low_authority'
  WHEN regexp_matches(lower(title), '\\b(ceo|cto|coo|founder|owner|managing director|managing partner|president|partner)\\b')
    THEN 'decision_maker'
  WHEN regexp_matches(lower(title), '\\b(vp|head of|director)\\b') THEN 'influencer' ELSE 'other' END AS tier
FROM parsed""",
    ),
    (
        "points",
        """SELECT k.*, s.note_text, s.hard AS hard_notes, s.reason_labels, s.tags, s.tag_labels, s.stage,
  s.is_agency_icp, s.is_adjacent_icp, s.budget_approved, s.budgeted_serious, s.urgency,
  t.tier, name IS NULL AND email IS NULL AND company IS NULL AS no_contact,
  CASE t.tier WHEN 'decision_maker' THEN 10.0 WHEN 'influencer' THEN 7.0 WHEN 'low_authority' THEN 0.0 ELSE 4.0 END
    + CASE WHEN employees IS NULL THEN 4.0 WHEN employees >= 3 THEN 10.0 ELSE 2.0 END
    + CASE WHEN s.is_agency_icp THEN 20.0 WHEN s.is_adjacent_icp THEN 10.0 ELSE 0.0 END AS fit_raw,
  CASE WHEN len(s.tags) = 0 THEN 3.0 ELSE s.weights END
    + CASE WHEN monthly_budget IS NULL THEN 2.0 WHEN monthly_budget >= 8000 THEN 10.0 WHEN monthly_budget >= 4000 THEN 7.0
           WHEN monthly_budget >= 1000 THEN 3.0 ELSE 0.0 END AS intent_raw,
  CASE s.stage WHEN 'sales_ready' THEN 20.0 WHEN 'warm' THEN 10.0 ELSE 0.0 END AS stage_raw
FROM kept k JOIN signals s USING (source_row) JOIN titles t USING (source_row)""",
    ),
    (
        "scores",
        """SELECT *, no_contact OR hard_notes AS hard_disqualify,
  CAST(CASE WHEN no_contact OR hard_notes THEN 0 ELSE greatest(0, least(40, fit_raw)) END AS DOUBLE) AS fit_score,
  CAST(CASE WHEN no_contact OR hard_notes THEN 0 ELSE greatest(0, least(40, intent_raw)) END AS DOUBLE) AS intent_score,
  CAST(CASE WHEN no_contact OR hard_notes THEN 0 ELSE stage_raw END AS DOUBLE) AS engagement_score,
  CAST(CASE WHEN no_contact OR hard_notes THEN 0 ELSE fit_raw + intent_raw + stage_raw END AS DOUBLE) AS raw_score,
  CASE WHEN no_contact OR hard_notes THEN 'unknown' ELSE tier END AS title_tier,
  CASE WHEN no_contact OR hard_notes THEN 'Cold' WHEN stage = 'sales_ready' THEN 'Sales-Ready'
       WHEN stage = 'warm' THEN 'Warm' ELSE 'Cold' END AS engagement_stage
FROM points""",
    ),
    ("scored", "SELECT *, fit_score + intent_score + engagement_score AS score FROM scores"),
    (
        "verdicts",
        """SELECT *, CASE WHEN hard_disqualify THEN 'Disqualify' WHEN score >= 65 THEN 'Contact Now'
  WHEN score >= 40 THEN 'Nurture' ELSE 'Disqualify' END AS recommendation,
  CASE WHEN is_agency_icp THEN 'Agency icp fit' WHEN is_adjacent_icp THEN 'Adjacent-market fit' ELSE 'Off-icp' END AS fit_text
FROM scored""",
    ),
    (
        "explained",
        """SELECT *, CASE WHEN no_contact THEN 'No name, email, or company to act on'
  WHEN hard_notes THEN upper(substr(array_to_string(reason_labels, '; '), 1, 1)) || lower(substr(array_to_string(reason_labels, '; '), 2))
  WHEN len(tags) = 0 THEN fit_text || '; notes are blank/too vague to assess intent, scored conservatively; ' || lower(engagement_stage)
  ELSE fit_text || CASE title_tier WHEN 'decision_maker' THEN ' with decision-maker authority'
      WHEN 'influencer' THEN ' with influencer authority' WHEN 'low_authority' THEN ' with low authority' ELSE '' END
    || '; ' || array_to_string(tag_labels[1:2], ' and ') || '; ' || lower(engagement_stage)
  END || ' -- ' || recommendation || '.' AS justification FROM verdicts""",
    ),
    (
        "ranked",
        """SELECT row_number() OVER (ORDER BY score DESC, raw_score DESC, lead_id, source_row) AS rank, lead_id, created,
  coalesce(name, '') AS name, coalesce(email, '') AS email, email_valid, coalesce(company, '') AS company,
  coalesce(website, '') AS website, employees, coalesce(title, '') AS title, coalesce(source, '') AS source,
  monthly_budget, notes, fit_score, intent_score, engagement_score, score, engagement_stage, recommendation, justification
FROM explained""",
    ),
    (
        "excluded",
        """SELECT source_row, coalesce(raw_id, '') AS lead_id, junk AS reason,
  CASE junk WHEN 'blank_row' THEN 'Row has no data in any column.'
    WHEN 'embedded_header_row' THEN 'A stray header row leaked into the data.'
    ELSE 'QA/placeholder row, not a real lead.' END AS detail, coalesce(raw_notes, '') AS notes
FROM cleaned WHERE junk IS NOT NULL
UNION ALL SELECT source_row, lead_id, 'duplicate_submission', 'Duplicate of ' || kept_label, notes
FROM resolved WHERE NOT is_primary""",
    ),
    (
        "cohort",
        "SELECT k.*, s.note_text FROM kept k JOIN signals s USING (source_row) "
        "WHERE NOT s.hard AND (s.budget_approved OR s.budgeted_serious) AND s.urgency",
    ),
]

_RANKED = ", ".join(rules.RANKED_COLUMNS)
_FILTER = (
    "recommendation IN ({buckets}) AND score BETWEEN {low} AND {high} AND ("
    "contains(lower(coalesce(name, '')), '{needle}') OR contains(lower(coalesce(company, '')), '{needle}') "
    "OR contains(lower(coalesce(email, '')), '{needle}') OR contains(lower(coalesce(title, '')), '{needle}'))"
).format(
    buckets=", ".join(_quote(b) for b in catalogue.FILTER_BUCKETS),
    low=catalogue.SCORE_RANGE[0],
    high=catalogue.SCORE_RANGE[1],
    needle=catalogue.SEARCH,
)
_GRID = ", ".join(f"({c}::DOUBLE, {n}::DOUBLE)" for c, n in catalogue.SWEEP)


def _profile(metric: str) -> str:
    return (
        f"SELECT '{metric}' AS metric, count({metric}) AS n, min({metric}) AS min, quantile_cont({metric}, 0.25) AS q1, "
        f"quantile_cont({metric}, 0.5) AS median, quantile_cont({metric}, 0.75) AS q3, max({metric}) AS max FROM cohort"
    )


FINAL: dict[str, str] = {
    "clean_text_fields": (
        f"SELECT source_row, {_squeeze('name')} AS name, {_squeeze('company')} AS company, {_squeeze('title')} AS title, "
        f"{_squeeze('notes')} AS notes, lower({_squeeze('source')}) AS source FROM cells"
    ),
    "clean_email": "SELECT source_row, email, email_valid FROM cleaned",
    "email_domain": "SELECT source_row, nullif(regexp_extract(email, '@([^@]*)$', 1), '') AS domain FROM cleaned",
    "clean_website": "SELECT source_row, website FROM cleaned",
    "website_tld": (
        "SELECT nullif(regexp_extract(website, '\\.([a-z]+)(/|$)', 1), '') AS tld, count(*) AS leads FROM kept GROUP BY 1"
    ),
    "parse_lead_id": (
        "SELECT source_row, lead_id_raw AS raw, lead_id_canonical AS canonical, lead_id_is_explicit_dup AS is_explicit_dup, "
        "lead_id_canonical IS NOT NULL AS looks_valid FROM cleaned"
    ),
    "parse_date": "SELECT source_row, strftime(created_date, '%Y-%m-%d') AS created_date FROM cleaned",
    "parse_employees": "SELECT source_row, employees FROM cleaned",
    "parse_budget": "SELECT source_row, monthly_budget FROM cleaned",
    "junk_reason": "SELECT source_row, junk AS reason FROM judged",
    "junk_counts": "SELECT junk AS reason, count(*) AS rows FROM judged GROUP BY 1",
    "clean_records": (
        "SELECT source_row, lead_id_raw, lead_id_canonical, lead_id_is_explicit_dup, lead_id, raw_created AS created_raw, "
        "strftime(created_date, '%Y-%m-%d') AS created_date, created, name, email, email_valid, company, employees, website, "
        "title, source, monthly_budget, notes FROM cleaned WHERE junk IS NULL"
    ),
    "completeness": "SELECT source_row, filled FROM filled WHERE junk IS NULL",
    "dedup_kept": "SELECT source_row, lead_id, lead_id_canonical FROM kept",
    "dedup_dropped": "SELECT source_row, lead_id, kept_label AS duplicate_of FROM resolved WHERE NOT is_primary",
    "note_disqualify_reasons": (
        "SELECT source_row, hard AS hard_disqualify, array_to_string(reasons, ',') AS reasons FROM signals"
    ),
    "note_intent_tags": (
        "SELECT source_row, array_to_string(tags, ',') AS tags, NOT hard AND len(tags) = 0 AS notes_too_vague FROM signals"
    ),
    "engagement_stage": "SELECT source_row, stage, stage AS stage_of_tags FROM signals",
    "icp_class": "SELECT source_row, is_agency_icp, is_adjacent_icp FROM signals",
    "notes_intent_clamped": (
        "SELECT source_row, CASE WHEN len(tags) = 0 THEN 3.0 ELSE greatest(0, least(30, weights)) END::DOUBLE AS points, "
        "weights AS raw_points FROM signals"
    ),
    "title_tier": (
        "SELECT source_row, CASE tier WHEN 'decision_maker' THEN 10 WHEN 'influencer' THEN 7 WHEN 'low_authority' THEN 0 "
        "ELSE 4 END::DOUBLE AS points, tier FROM titles"
    ),
    "employee_points": (
        "SELECT source_row, CASE WHEN employees IS NULL THEN 4 WHEN employees >= 3 THEN 10 ELSE 2 END::DOUBLE AS points "
        "FROM cleaned"
    ),
    "budget_points": (
        "SELECT source_row, CASE WHEN monthly_budget IS NULL THEN 2 WHEN monthly_budget >= 8000 THEN 10 "
        "WHEN monthly_budget >= 4000 THEN 7 WHEN monthly_budget >= 1000 THEN 3 ELSE 0 END::DOUBLE AS points FROM cleaned"
    ),
    "fit_intent_stage": (
        "SELECT source_row, fit_score, intent_score, engagement_score, score, raw_score, title_tier FROM scored"
    ),
    "recommendation": "SELECT source_row, hard_disqualify, recommendation, engagement_stage FROM verdicts",
    "justification": "SELECT source_row, justification FROM explained",
    "ranked_leads": f"SELECT rank, {_RANKED} FROM ranked",
    "excluded_leads": "SELECT * FROM excluded",
    "top_leads": f"SELECT {_RANKED} FROM ranked WHERE rank <= {catalogue.TOP_N}",
    "run_stats": (
        "SELECT (SELECT count(*) FROM raw_leads) AS total_rows_read, "
        "(SELECT count(*) FROM judged WHERE junk IS NOT NULL) AS junk_rows_dropped, "
        "(SELECT count(*) FROM resolved WHERE NOT is_primary) AS duplicate_rows_dropped, "
        "count(*) AS qualified_rows, count(*) FILTER (recommendation = 'Contact Now') AS contact_now, "
        "count(*) FILTER (recommendation = 'Nurture') AS nurture, "
        "count(*) FILTER (recommendation = 'Disqualify') AS disqualify FROM verdicts"
    ),
    "recommendation_counts": (
        "SELECT b.position, b.recommendation, count(v.source_row) AS leads FROM (VALUES (0, 'Contact Now'), (1, 'Nurture'), "
        "(2, 'Disqualify')) b(position, recommendation) LEFT JOIN verdicts v USING (recommendation) GROUP BY ALL"
    ),
    "excluded_counts": (
        "SELECT b.position, b.reason, count(e.source_row) AS excluded_rows FROM (VALUES (0, 'blank_row'), "
        "(1, 'embedded_header_row'), (2, 'test_placeholder_row'), (3, 'duplicate_submission')) b(position, reason) "
        "LEFT JOIN excluded e USING (reason) GROUP BY ALL"
    ),
    "filtered_leads": (
        f"SELECT * EXCLUDE (rank) REPLACE (CASE recommendation WHEN 'Contact Now' THEN '\U0001F7E2 ' "
        f"WHEN 'Nurture' THEN '\U0001F7E1 ' ELSE '\U0001F534 ' END || recommendation AS recommendation) "
        f"FROM ranked WHERE {_FILTER}"
    ),
    "filtered_counts": f"SELECT count(*) FILTER ({_FILTER}) AS shown, count(*) AS total FROM verdicts",
    "threshold_sweep": (
        "SELECT g.contact_now, g.nurture, count(*) FILTER (NOT hard_disqualify AND score >= g.contact_now) AS "
        "contact_now_leads, count(*) FILTER (NOT hard_disqualify AND score < g.contact_now AND score >= g.nurture) AS "
        "nurture_leads, count(*) FILTER (hard_disqualify OR (score < g.contact_now AND score < g.nurture)) AS disqualify_leads "
        f"FROM scored, (VALUES {_GRID}) g(contact_now, nurture) GROUP BY 1, 2"
    ),
    "icp_cohort": "SELECT source_row, lead_id, title, employees, monthly_budget, website FROM cohort",
    "icp_profile": _profile("employees") + " UNION ALL " + _profile("monthly_budget"),
    "icp_titles": "SELECT title, count(*) AS leads FROM cohort GROUP BY 1",
    "icp_verticals": (
        "SELECT nullif(regexp_extract(note_text, '(\\w+(?: \\w+)?) agency', 1), '') AS vertical, count(*) AS leads "
        "FROM cohort GROUP BY 1"
    ),
    "pain_points": " UNION ALL ".join(
        f"SELECT {_quote(label)} AS pain_point, count(*) FILTER (contains(note_text, {_quote(p)})) AS leads FROM cohort"
        for label, p in rules.PAIN_POINTS
    ),
    "email_matches_website": (
        "SELECT source_row, nullif(regexp_extract(email, '@([^@]*)$', 1), '') = website AS same_domain "
        "FROM cleaned WHERE junk IS NULL"
    ),
    "csv_round_trip": f"SELECT {_RANKED} FROM ranked",
    "stream_ingest": "SELECT source_row, lead_id, score, recommendation FROM verdicts",
}


def check_sql() -> dict[str, str]:
    """One self-contained statement per query: only the CTEs it needs, in order."""
    bodies = dict(CTES)

    def needs(text: str) -> set[str]:
        found = {name for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text) if name in bodies}
        return found.union(*[needs(bodies[name]) for name in found])

    statements = {}
    for query, final in FINAL.items():
        wanted = needs(final)
        parts = [f"{name} AS ({body})" for name, body in CTES if name in wanted]
        statements[query] = "WITH " + ",\n".join(parts) + "\n" + final
    return statements
