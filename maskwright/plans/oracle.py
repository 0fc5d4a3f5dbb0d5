"""DuckDB SQL of the scan, put together from the same detector rows."""

from __future__ import annotations

from ..operators.detectors import Detector, weighted

M = "chr(1)"
DOCS = "docs AS (SELECT source || '/' || doc_id || '.txt' AS path, text, lang, doc_id FROM documents WHERE text IS NOT NULL)"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN = f"(length({_DIGITS}) >= 12 AND list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN (2 * substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1)::INT) // 10 + (2 * substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1)::INT) % 10 ELSE substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1)::INT END)) % 10 = 0)"
ENTROPY = "coalesce(-list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: (length(value) - length(replace(value, c, ''))) / length(value) * log2((length(value) - length(replace(value, c, ''))) / length(value)))), 0)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Patterns whose bounds are too large for DuckDB; the longest match is checked apart.
PORTABLE = {"jwt": r"\bey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "password_assignment": r"(?i)(\b\w{0,64}(?:password|passwd|pwd|secret)\w{0,64}\s{0,32}[:=]\s{0,32})([^\s,;]{4,})"}


def re2(pattern: str) -> str:
    return pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace("(?iu)", "(?i)")


def spans(detectors: list[Detector], source: str = "docs", keys: str = "path, text") -> str:
    """CTEs parts and raw: (keys, detector_id, start, end, value)."""
    parts = []
    for d in detectors:
        mark = f"'\\1' || {M} || '\\2' || {M}" if d.value else f"{M} || '\\0' || {M}"
        parts.append(f"SELECT {keys}, {quoted(d.id)} AS detector_id, string_split(regexp_replace(text, {quoted(PORTABLE.get(d.id) or re2(d.pattern))}, {mark}, 'g'), {M}) AS p FROM {source}")
    keep = " AND ".join([f"length(value) <= CASE detector_id {' '.join(f'WHEN {quoted(d.id)} THEN {d.max_match_length}' for d in detectors)} END", *(f"(detector_id <> {quoted(d.id)} OR {ENTROPY} >= {d.entropy_threshold})" for d in detectors if d.method == "entropy")])
    return f"""parts AS ({" UNION ALL ".join(parts)}),
hits AS (SELECT {keys}, detector_id, p, unnest(generate_series(2, len(p), 2)) AS i FROM parts WHERE len(p) > 1),
raw0 AS (SELECT {keys}, detector_id, list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::INT AS start, p[i] AS value FROM hits),
raw AS (SELECT *, (start + length(value))::INT AS "end" FROM raw0 WHERE {keep})"""


def scored(detectors: list[Detector], categories: tuple[str, ...] = (), limit: float = 0.85, source: str = "docs", keys: str = "path, text", scale: float = 1.25, offset: float = 0.0) -> str:
    """CTEs up to det: the detections with confidence, tier and the detectors' fields."""
    case, fields = [], []
    for d in (weighted(d, scale, offset) for d in detectors):
        terms = [repr(d.base) + "::DOUBLE"]
        for r in d.rules():
            holds = f"regexp_matches(near, {quoted(re2(r.pattern))})" if r.pattern else f"regexp_matches(path, {quoted(re2(r.in_path))})" if r.in_path else LUHN
            terms.append(f"CASE WHEN {'NOT ' if r.invert else ''}{holds} THEN {r.weight!r}::DOUBLE ELSE 0 END")
        case.append(f"WHEN {quoted(d.id)} THEN {' + '.join(terms)}")
        chosen = d.origin == "user_target" or not categories or d.category in categories
        fields.append(f"({quoted(d.id)}, {quoted(d.category)}, {d.specificity}, [{', '.join(map(quoted, d.suppresses))}]::VARCHAR[], {quoted(d.origin)}, {chosen})")
    return spans(detectors, source, keys) + f""",
fields(fid, category, specificity, suppresses, origin, category_selected) AS (VALUES {", ".join(fields)}),
near AS (SELECT *, substr(text, greatest(start - 100, 0) + 1, "end" + 100 - greatest(start - 100, 0)) AS near, substr(text, 1, start) AS before FROM raw),
det0 AS (SELECT *, greatest(0, least(1, CASE detector_id {" ".join(case)} END)) AS confidence,
         (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line, (length(list_last(string_split(before, chr(10)))) + 1)::INT AS "column" FROM near),
det AS (SELECT det0.* EXCLUDE (text, near, before), fields.*, CASE WHEN confidence >= {limit!r} THEN 'A' ELSE 'B' END AS tier FROM det0 JOIN fields ON fid = detector_id)"""


FINDINGS = """
num AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start, "end" DESC, detector_id) AS n FROM det),
link AS (SELECT a.path, a.n AS x, b.n AS y FROM num a JOIN num b ON a.path = b.path AND a.n <> b.n AND
  ((a.start = b.start AND a."end" = b."end") OR (a.start <= b.start AND a."end" >= b."end" AND list_contains(a.suppresses, b.detector_id))
   OR (b.start <= a.start AND b."end" >= a."end" AND list_contains(b.suppresses, a.detector_id)))),
walk AS (SELECT path, n AS x, n AS y FROM num UNION SELECT walk.path, walk.x, link.y FROM walk JOIN link ON link.path = walk.path AND link.x = walk.y),
comp AS (SELECT path, x AS n, min(y) AS component FROM walk GROUP BY 1, 2),
mem AS (SELECT num.*, component, EXISTS (SELECT 1 FROM num o WHERE o.path = num.path AND o.n <> num.n AND o.start <= num.start AND o."end" >= num."end" AND list_contains(o.suppresses, num.detector_id)) AS suppressed
        FROM num JOIN comp ON comp.path = num.path AND comp.n = num.n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path, component ORDER BY suppressed, -specificity, start - "end", detector_id, start, "end") AS rk FROM mem),
grp AS (SELECT path, component, min(start) AS group_start, max("end") AS group_end, count(*) AS raw_count, count(*) FILTER (suppressed AND rk > 1) AS suppressed_count,
        string_agg(detector_id || ':' || start || ':' || "end", '|' ORDER BY start, "end", detector_id) AS sig, bool_or(origin = 'user_target') AS has_user_target FROM ranked GROUP BY 1, 2),
sup0 AS (SELECT r.path, r.component, r.detector_id, r.confidence, CASE WHEN r.suppressed THEN 'suppressed' WHEN r.start = p.start AND r."end" = p."end" THEN 'same_span' ELSE 'overlap_chain' END AS rel,
         row_number() OVER (PARTITION BY r.path, r.component, r.detector_id ORDER BY r.confidence DESC, r.rk) AS k
         FROM ranked r JOIN ranked p ON p.path = r.path AND p.component = r.component AND p.rk = 1 WHERE r.rk > 1),
sup AS (SELECT path, component, string_agg(detector_id || ':' || rel, ',' ORDER BY detector_id) AS supporting FROM sup0 WHERE k = 1 GROUP BY 1, 2),
find AS (SELECT r.path, substr(sha256(r.path || ':' || group_start || ':canonical:' || group_end || ':' || sig), 1, 16) AS id, detector_id, category, start, "end", line, "column", value, confidence, tier,
         category_selected, has_user_target, group_start, group_end, raw_count::INT AS raw_count, suppressed_count::INT AS suppressed_count, coalesce(supporting, '') AS supporting,
         CASE WHEN tier = 'A' THEN 'anonymize' ELSE 'review' END AS suggested_action,
         CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 2) || repeat('*', least(length(value) - 4, 28)) || right(value, 2) END AS preview
         FROM ranked r JOIN grp USING (path, component) LEFT JOIN sup USING (path, component) WHERE rk = 1)"""

_FULL = "repeat('*', length(value))"
#: Values here never lie inside their masks, but synthetic ones are checked as in the plan.
REPLACEMENT = f"""CASE WHEN detector_id = 'credit_card' AND length(value) > 4 THEN repeat('*', length(value) - 4) || right(value, 4)
  WHEN detector_id = 'email' AND NOT contains('redacted.user@example.invalid', lower(value)) THEN 'redacted.user@example.invalid'
  WHEN detector_id = 'phone' AND NOT contains('000-000-0000', lower(value)) THEN '000-000-0000' ELSE {_FULL} END"""

ISLANDS = """
reach AS (SELECT *, max("end") OVER (PARTITION BY path ORDER BY start, "end" DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM find),
isl AS (SELECT *, sum(CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY start, "end" DESC, id ROWS UNBOUNDED PRECEDING) AS island FROM reach),
span AS (SELECT path, island, min(start) AS start, max("end") AS "end", count(*) AS n, min(""" + REPLACEMENT + """) AS own FROM isl GROUP BY 1, 2),
spans_ AS (SELECT path, start, "end", CASE WHEN n = 1 THEN own ELSE repeat('*', "end" - start) END AS text FROM span)"""
