"""DuckDB SQL with the rows of the registered facility queries, built from the same parameters."""

from __future__ import annotations

import re

from ..functions import vocab
from ..operators import extraction, queries
from ..operators.bm25 import B, EPSILON, K1
from . import fixture

BLANKS = "('', '[]', 'null', 'None', 'nan')"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lst(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def camel(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"


def tags(x: str, terms: dict) -> str:
    hit = lambda words: r"'\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + r")\b'"
    items = ", ".join(f"CASE WHEN regexp_matches(lower({camel(x)}), {hit(words)}) THEN '{t}' END" for t, words in terms.items())
    return f"list_sort(list_filter([{items}], lambda x: x IS NOT NULL))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def has(*xs: str) -> str:
    return "(" + " OR ".join(f"{strip(x)} NOT IN {BLANKS}" for x in xs) + ")"


def flat(x: str) -> str:
    return f"CASE WHEN {x} LIKE '[%]' AND json_valid({x}) THEN array_to_string(list_filter(list_transform(CAST(CAST({x} AS JSON) AS VARCHAR[]), lambda e: coalesce(e, 'null')), lambda e: e <> ''), ' ') ELSE {strip(x)} END"


def gather(*xs: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {strip(x)} NOT IN {BLANKS} THEN {camel(strip(x))} END" for x in xs) + "], lambda x: x IS NOT NULL), '. ')"


def sentences(x: str) -> str:
    marked = rf"regexp_replace(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+|\|', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, ' -•·' || chr(9) || ',;')), lambda s: length(s) > 4)"


def shortest(s: str, needles: str) -> str:
    ranked = f"list_transform({s}, lambda x, i: {{'n': length(x), 'i': i, 's': x}})"
    return f"substr((list_sort(list_filter({ranked}, lambda x: len(list_filter({needles}, lambda w: contains(lower(x.s), w))) > 0))[1]).s, 1, 240)"


def shorten(x: str) -> str:
    return rf"CASE WHEN length({strip(x)}) <= 240 THEN {strip(x)} ELSE regexp_replace(substr({strip(x)}, 1, 239), '\s+$', '') || '...' END"


def words_of(found: str, terms: dict) -> str:
    return "flatten([" + ", ".join(f"CASE WHEN list_contains({found}, '{t}') THEN {lst(w)} ELSE [] END" for t, w in terms.items()) + "])"


def state(x: str) -> str:
    when = " ".join(f"WHEN {q(a)} THEN {q(s)}" for a, s in vocab.STATE_ALIASES.items())
    return f"nullif(CASE lower({strip(x)}) {when} ELSE lower({strip(x)}) END, '')"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ')"


VALID = "(" + ", ".join(map(q, vocab.STATES)) + ")"
KEEP = ["district", "specialties", "equipment", "procedure", "capability", "notes", "staff", "facility_type", "extraction_json", "verified_json"]


def _clean() -> str:
    cells = ", ".join(f"{flat(c)} AS {c}" if c in vocab.LISTS else c for c in KEEP)
    pin = strip(r"regexp_replace(pin_code, '\.0$', '')")
    return f"SELECT hospital_id, hospital_name, state, {pin} AS pin_code, {cells}, latitude, longitude FROM raw"


def _tagged() -> str:
    full = "procedure || ' ' || capability || ' ' || notes"
    return f"SELECT *, {tags('specialties', vocab.SPECIALTIES)} AS st, {tags('equipment', vocab.EQUIPMENT)} AS et, {tags(f'''(specialties || ' ' || {full})''', vocab.SPECIALTIES)} AS stf, {tags(f'''(equipment || ' ' || {full})''', vocab.EQUIPMENT)} AS etf FROM clean"


def _scored() -> str:
    blob = "lower(staff || ' ' || notes || ' ' || capability)"
    word = " OR ".join(f"contains({blob}, '{w}')" for w in vocab.STAFF_WORDS)
    number = " OR ".join(rf"regexp_full_match({strip(c)}, '0*[1-9]\d*')" for c in ("staff", "notes", "capability"))
    return rf"""SELECT *, CAST(greatest(0, least(100, 20 * major::INT + 20 * equip::INT + 20 * staffed::INT - 30 * clash::INT - CASE WHEN missing > 2 THEN 10 ELSE 0 END + bonus)) AS INT) AS trust_score FROM (
 SELECT *, major AND NOT equip AND NOT staffed AS clash,
  (NOT {has('specialties')})::INT + (NOT {has('equipment', 'procedure', 'capability')})::INT + (NOT ({has('staff')} OR staffed))::INT + (NOT {has('notes')})::INT + ({strip('state')} || {strip('pin_code')} = '')::INT AS missing,
  least(20, greatest(0, len(sp) + len(eq) - 1) * 2) AS bonus FROM (
  SELECT *, len(majors) > 0 AS major, len(eq) > 0 OR {has('equipment', 'procedure', 'capability')} AS equip, (({word}) AND regexp_matches({blob}, '\b\d{{1,5}}\b')) OR {number} AS staffed FROM (
   SELECT *, list_filter(sp, lambda t: list_contains({lst(vocab.MAJOR)}, t)) AS majors FROM (
    SELECT *, CASE WHEN len(stf) > 0 THEN stf ELSE st END AS sp, CASE WHEN len(etf) > 0 THEN etf ELSE et END AS eq FROM tagged))))"""


def _cited() -> str:
    gaps = ", ".join(f"CASE WHEN NOT {has(c)} THEN '{label}' END" for label, c in [("specialties", "specialties"), ("equipment", "equipment"), ("staff", "staff"), ("notes", "notes"), ("location", "state")])
    s1, s2, s3 = (sentences(gather(*c)) for c in (("notes", "capability", "procedure", "specialties"), ("notes", "capability", "procedure", "equipment"), ("staff", "notes", "capability")))
    spec = f"coalesce({shortest('s1', words_of('majors', vocab.SPECIALTIES))}, upper(array_to_string(majors, ', ')) || ' — listed in specialty tags')"
    raw = lambda c: f"CASE WHEN {strip(c)} NOT IN ('', '[]') THEN {strip(c)} END"
    equip = f"coalesce({shortest('s2', words_of('eq', vocab.EQUIPMENT))}, {shortest('s2', lst(vocab.EQUIPMENT_HINTS))}, {raw('equipment')})"
    staff = f"coalesce({shortest('s3', lst(vocab.STAFF_CITED))}, 'Staff field: ' || {raw('staff')})"
    names = f"array_to_string(list_filter([{gaps}], lambda x: x IS NOT NULL), ', ')"
    return f"""SELECT *, CASE WHEN major THEN {shorten('''('Claim: "' || ev_specialty || '" -- but no equipment or staffing details were extracted from the notes.')''')} END AS ev_contradiction FROM (
 SELECT *, CASE WHEN major THEN {shorten('e1')} END AS ev_specialty, {shorten('e2')} AS ev_equipment, {shorten('e3')} AS ev_staff, CASE WHEN missing > 0 THEN {shorten(f"('Missing canonical fields: ' || coalesce(nullif(gap, ''), 'multiple'))")} END AS ev_missing FROM (
  SELECT *, {spec} AS e1, {equip} AS e2, {staff} AS e3, {names} AS gap FROM (SELECT *, {s1} AS s1, {s2} AS s2, {s3} AS s3 FROM scored)))"""


def with_(last: str, *, upto: str = "cited") -> str:
    parts = {"raw": fixture.raw_sql(), "clean": _clean(), "tagged": _tagged(), "scored": _scored(), "cited": _cited()}
    names = list(parts)[: list(parts).index(upto) + 1]
    return "WITH " + ", ".join(f"{n} AS ({parts[n]})" for n in names) + " " + last


def _breakdown() -> str:
    item = lambda rule, delta, ev: f"{rule} || '|' || ({delta}) || '|' || coalesce({ev}, '')"
    rows = [
        f"CASE WHEN major THEN {item(q('Major specialty (ICU / dialysis / trauma / cardio / neuro) present'), 20, 'ev_specialty')} ELSE 'No major specialty detected|0|' END",
        f"CASE WHEN equip THEN {item(q('Equipment info present'), 20, 'ev_equipment')} ELSE 'Equipment info missing|0|' END",
        f"CASE WHEN staffed THEN {item(q('Staffing info present'), 20, 'ev_staff')} ELSE 'Staffing info missing|0|' END",
        f"CASE WHEN clash THEN {item(q('Contradiction: claims major specialty but no equipment or staff'), -30, 'ev_contradiction')} END",
        f"CASE WHEN missing > 2 THEN {item('''('Too many missing fields (' || missing || '/5)')''', -10, 'ev_missing')} END",
        f"CASE WHEN bonus > 0 THEN {item('''('Rich tagging bonus (+' || bonus || ')')''', 'bonus', q(''))} END",
    ]
    return f"array_to_string(list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL), chr(10))"


SPEC_ROWS = f"sr AS (SELECT hospital_id, unnest(list_filter(stf, lambda t: list_contains({lst(vocab.MAJOR)}, t))) AS specialty, CASE WHEN {state('state')} IN {VALID} THEN {title(state('state'))} END AS state FROM scored), cells AS (SELECT specialty, state, count(*) AS facility_count FROM sr WHERE state IS NOT NULL GROUP BY ALL), best AS (SELECT state FROM cells GROUP BY state ORDER BY sum(facility_count) DESC, state LIMIT 20), matrix AS (SELECT * FROM cells WHERE state IN (SELECT state FROM best))"


def scored_with(more: str, last: str) -> str:
    return with_("", upto="scored").rstrip() + ", " + more + " " + last


DESERTS = f"""deserts AS (SELECT {title('s')} AS state, count(*) AS facility_count, sum(h) AS hospital_count, avg(trust_score) AS t, avg(m) AS m, avg(h) AS hs FROM (
 SELECT *, {state('state')} AS s, (len(list_filter(stf, lambda t: list_contains({lst(vocab.MAJOR)}, t))) > 0)::INT AS m, (lower(facility_type) = 'hospital')::INT AS h FROM scored) WHERE s IN {VALID} GROUP BY s),
 ranked AS (SELECT *, (1 - m) * 0.5 + (1 - t / 100) * 0.5 AS d FROM deserts)"""

COORDS = rf"""pins AS ({fixture.pins_sql()}), px AS (SELECT substr(pin_code, 1, 3) AS k, avg(latitude) AS lat, avg(longitude) AS lon FROM pins GROUP BY 1), ds AS (SELECT lower(district) AS k, avg(latitude) AS lat, avg(longitude) AS lon FROM pins GROUP BY 1),
 ss AS (SELECT lower(state) AS k, avg(latitude) AS lat, avg(longitude) AS lon FROM pins GROUP BY 1),
 dig AS (SELECT *, regexp_replace(pin_code, '[^0-9]', '', 'g') AS d FROM scored), p6 AS (SELECT *, CASE WHEN length(d) >= 3 THEN substr(CASE WHEN length(d) < 6 THEN lpad(d, 6, '0') ELSE d END, 1, 6) END AS p FROM dig),
 fac AS (SELECT f.*, CASE WHEN f.latitude IS NOT NULL AND f.longitude IS NOT NULL THEN f.latitude ELSE coalesce(pins.latitude, px.lat, ds.lat, ss.lat) END AS lat, CASE WHEN f.latitude IS NOT NULL AND f.longitude IS NOT NULL THEN f.longitude ELSE coalesce(pins.longitude, px.lon, ds.lon, ss.lon) END AS lon
  FROM p6 f LEFT JOIN pins ON pins.pin_code = f.p LEFT JOIN px ON px.k = substr(f.p, 1, 3) LEFT JOIN ds ON ds.k = lower({strip('f.district')}) LEFT JOIN ss ON ss.k = lower({strip('f.state')}))"""


def km(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(2 * {vocab.EARTH_KM} * asin(sqrt({h})))"


STOP = "(" + ", ".join(map(q, vocab.STOPWORDS)) + ")"
TOKENS = lambda x: rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '' AND NOT list_contains({lst(vocab.STOPWORDS)}, w))"


def _status() -> str:
    j = lambda p, d: f"coalesce(json_extract_string(j, '$.{p}'), '{d}')"
    claimed = lambda x: f"{x} IN ('confirmed', 'claimed')"
    here = lambda x: f"{x} IN ('full_time', 'on_call')"
    icu, vent, an, gen, cs, card = j("icu.present", "uncertain"), j("ventilator.present", "not_present"), j("staff.anesthesiologist", "unknown"), j("surgery.general_surgery", "uncertain"), j("surgery.caesarean", "uncertain"), j("surgery.cardiac", "uncertain")
    dia, em = j("dialysis.present", "uncertain"), j("emergency.emergency_care", "uncertain")
    pop = f"(({icu} <> 'uncertain')::INT + ({vent} <> 'uncertain')::INT + ({an} <> 'unknown')::INT + ({em} <> 'uncertain')::INT + ({gen} <> 'uncertain')::INT + ({dia} <> 'uncertain')::INT)"
    fired = {
        "SURGERY_NO_ANESTHESIOLOGIST": f"({claimed(gen)} OR {claimed(cs)}) AND {an} = 'unknown'", "ICU_NON_FUNCTIONAL": f"{claimed(icu)} AND {j('icu.functional_status', 'unknown')} = 'non_functional'",
        "ICU_NO_BEDS": f"{icu} = 'confirmed' AND json_extract_string(j, '$.icu.bed_count') IS NULL", "24_7_NO_STAFF": f"{j('emergency.is_24_7', 'false')} = 'true' AND NOT {here(j('staff.general_physician', 'unknown'))} AND NOT {here(j('staff.surgeon', 'unknown'))}",
        "CARDIAC_SURGERY_RURAL_CLINIC": f"{claimed(card)} AND contains(lower(facility_type), 'clinic')", "ZERO_DOCTORS_MANY_SPECIALTIES": f"{j('staff.total_doctor_count', '-1')} = '0' AND coalesce(json_array_length(j, '$.staff.specialist_types'), 0) > 3",
        "VENTILATOR_NO_ICU": f"{claimed(vent)} AND {icu} = 'not_present'", "CAESAREAN_NO_ANESTHESIOLOGIST": f"{claimed(cs)} AND {an} = 'unknown'", "MISSING_CRITICAL_FIELDS": f"{pop} < 3", "EMPTY_DESCRIPTION": f"trim({j('raw_text_used', '')}) = ''",
    }
    take = " - ".join(f"CASE WHEN {w} THEN {extraction.RULES[k][1]} ELSE 0 END" for k, w in fired.items())
    names = ", ".join(f"CASE WHEN {w} THEN '{k}' END" for k, w in fired.items())
    count = lambda *kinds: "(" + " + ".join(f"({w})::INT" for k, w in fired.items() if extraction.RULES[k][0] in kinds) + ")"
    return rf"""st AS (SELECT *, TRY_CAST(nullif(regexp_extract(extraction_json, '(?s)\{{.*\}}'), '') AS JSON) AS j FROM scored), ex AS (SELECT *, j IS NULL AS bad, list_filter([{names}], lambda x: x IS NOT NULL) AS flags, round(greatest(0.05, least(1.0, CAST(1.0 AS DOUBLE) - {take})), 3) AS rule_trust, {pop} / 6.0 AS completeness,
 greatest(0.0, 1 - {count('HIGH', 'CRITICAL')} * 0.25 - {count('MEDIUM')} * 0.10) AS consistency, CASE WHEN length(notes) > 1000 THEN 0.85 WHEN length(notes) > 400 THEN 0.65 WHEN length(notes) > 100 THEN 0.45 ELSE 0.20 END AS reliability,
 {icu} AS icu_status, {dia} AS dialysis_status, {em} AS emergency_status, {gen} AS surgery_status, {claimed(icu)} AND {j('icu.functional_status', 'unknown')} <> 'non_functional' AS icu_functional FROM st),
 conf AS (SELECT *, completeness * 0.40 + consistency * 0.35 + reliability * 0.25 AS overall FROM ex),
 pd0 AS (SELECT pin_code, state, count(*) AS facility_count, avg(trust_score) AS avg_trust_score, {', '.join(f"round(avg({claimed(k + '_status')}::INT), 3) AS {k}_coverage" for k in extraction.RISK)}, avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon FROM conf WHERE pin_code <> '' GROUP BY ALL),
 pd AS (SELECT *, round({' + '.join(f'CAST({w} AS DOUBLE) * (1 - {k}_coverage)' for k, w in extraction.RISK.items())}, 3) AS risk, list_filter([{', '.join(f"CASE WHEN {k}_coverage < 0.1 THEN '{k.upper()}_DESERT' END" for k in extraction.RISK)}], lambda x: x IS NOT NULL) AS kinds FROM pd0)"""


STATUS = _status()


def _bm25(docs: str, asked: str) -> str:
    """(query, doc_id, score) of documents (doc_id, text) and queries (query, text)."""
    return f"""docs AS (SELECT doc_id, {TOKENS('text')} AS tk FROM ({docs})), post AS (SELECT doc_id, len(tk) AS dl, w AS term, count(*) AS tf FROM docs, unnest(tk) AS u(w) GROUP BY ALL),
 corp AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM docs), t0 AS (SELECT term, count(*) AS df, ln((SELECT n FROM corp) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post GROUP BY term),
 terms AS (SELECT term, df, CASE WHEN raw < 0 THEN {EPSILON} * (SELECT avg(raw) FROM t0) ELSE raw END AS idf FROM t0), qs AS (SELECT query, w AS term, count(*) AS times FROM ({asked}), unnest({TOKENS('text')}) AS u(w) GROUP BY ALL),
 bm AS (SELECT query, doc_id, sum(idf * times * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / (SELECT avgdl FROM corp)))) AS score FROM qs JOIN terms USING (term) JOIN post USING (term) GROUP BY ALL)"""


BM25 = _bm25("SELECT doc_id, text FROM documents", "SELECT item_id AS query, text FROM benchmark")
SEARCH_TEXT = strip("(hospital_name || ' | ' || specialties || ' | ' || equipment || ' | ' || procedure || ' | ' || capability || ' | ' || notes || ' | ' || facility_type || ' | ' || state || ' ' || district)")

NEAREST = "x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), pr AS (SELECT a.vec_id AS query, b.vec_id AS id, list_inner_product(a.v, b.v) AS s FROM x a, x b WHERE a.vec_id % 50 = 0), near AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 200)"


def _parsed(source: str) -> str:
    """(query_id, q, low, state, pin, radius_km, specialties, requirements, sort) of the queries in `source` (query_id, query)."""
    full = " ".join(rf"WHEN regexp_matches(low, '\b{s}\b') THEN '{s}'" for s in sorted(vocab.STATES, key=len, reverse=True))
    valid = {a: s for a, s in vocab.STATE_ALIASES.items() if s in vocab.STATES and len(a) <= 3}
    short = "list_filter(regexp_extract_all(low, '\\b([a-z&]{2,3})\\b', 1), lambda w: list_contains(" + lst(list(valid)) + ", w))[1]"
    alias = " ".join(f"WHEN '{a}' THEN '{s}'" for a, s in valid.items())
    urgent, km = queries.URGENT.replace("'", "''"), queries._KM
    return rf"""p0 AS (SELECT query_id, {strip('query')} AS q, lower({strip('query')}) AS low FROM ({source})), p1 AS (SELECT *, nullif(regexp_extract(q, '\b(\d{{6}})\b', 1), '') AS pin, regexp_matches(low, '{urgent}') AS urgent,
  coalesce(CASE {full} END, CASE {short} {alias} END) AS st, coalesce(nullif(regexp_extract(low, '\bwithin\s+{km}', 1), ''), nullif(regexp_extract(low, '\b{km}', 1), '')) AS km FROM p0),
 parsed AS (SELECT *, {title('st')} AS state, coalesce(CAST(km AS DOUBLE), CASE WHEN urgent OR pin IS NOT NULL THEN 30.0 END) AS radius_km, CASE WHEN urgent OR pin IS NOT NULL THEN 'distance' ELSE 'relevance' END AS sort, {tags('low', vocab.SPECIALTIES)} AS specialties, {tags('low', vocab.EQUIPMENT)} AS requirements FROM p1)"""


def _candidates() -> str:
    """All pairs of the fixed queries that are left after state and radius, and every facility for queries without any."""
    d = km("q_lat", "q_lon", "lat", "lon")
    where = "CASE WHEN q_lat IS NOT NULL AND radius_km > 0 THEN km <= radius_km AND (want IS NULL OR want = have) WHEN want IS NOT NULL THEN want = have ELSE false END"
    name = f"CASE WHEN want = have THEN 1.0 WHEN want = lower({strip('district')}) THEN 0.5 ELSE 0.0 END"
    return f"""{_parsed(fixture.batch_sql(False))}, asked AS (SELECT parsed.*, {state('parsed.state')} AS want, coalesce(pins.latitude, px.lat) AS q_lat, coalesce(pins.longitude, px.lon) AS q_lon FROM parsed LEFT JOIN pins ON pins.pin_code = parsed.pin LEFT JOIN px ON px.k = substr(parsed.pin, 1, 3)),
 met AS (SELECT query_id, hospital_id, want, radius_km, q_lat, {state('fac.state')} AS have, district, {d} AS km FROM asked, fac), hit AS (SELECT *, coalesce({where}, false) AS here FROM met), hits AS (SELECT query_id, bool_or(here) AS any_here FROM hit GROUP BY 1),
 cand AS (SELECT hit.*, CASE WHEN km IS NULL THEN {name} WHEN radius_km > 0 THEN greatest(0.0, 1 - km / radius_km) ELSE 1 / (1 + km / 50) END AS location FROM hit JOIN hits USING (query_id) WHERE here OR NOT any_here)"""


def _hybrid() -> str:
    """The ten best candidates of each query by keyword, trust and place."""
    own = _bm25(f"SELECT hospital_id AS doc_id, {SEARCH_TEXT} AS text FROM scored", "SELECT query_id AS query, q AS text FROM parsed")
    return f"""{_candidates()}, {own},
 k AS (SELECT cand.query_id, cand.hospital_id, location, coalesce(bm.score, 0.0) AS kw, trust_score / 100.0 AS tr, sort FROM cand JOIN scored USING (hospital_id) JOIN parsed USING (query_id) LEFT JOIN bm ON bm.query = cand.query_id AND bm.doc_id = cand.hospital_id),
 m AS (SELECT *, CASE WHEN max(kw) OVER w - min(kw) OVER w < 1e-9 THEN (max(kw) OVER w <> 0)::INT ELSE (kw - min(kw) OVER w) / (max(kw) OVER w - min(kw) OVER w) END AS kn, count(*) OVER w AS total_candidates FROM k WINDOW w AS (PARTITION BY query_id)),
 h AS (SELECT *, CASE WHEN sort = 'distance' THEN 0.7 * location + 0.2 * tr ELSE 0.2 * kn + 0.2 * tr + 0.1 * location END AS score FROM m), hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hospital_id) AS rank FROM h)"""


def _evidence() -> str:
    j = lambda p, d: f"coalesce(json_extract_string(j, '$.{p}'), '{d}')"
    an, cs = j("staff.anesthesiologist", "unknown"), j("surgery.caesarean", "uncertain")
    says = {
        "SURGERY_NO_ANESTHESIOLOGIST": f"'surgery=' || {j('surgery.general_surgery', 'uncertain')} || ', caesarean=' || {cs} || ', anesthesiologist=' || {an}", "ICU_NON_FUNCTIONAL": f"'icu.present=' || {j('icu.present', 'uncertain')} || ', icu.functional_status=' || {j('icu.functional_status', 'unknown')}",
        "ICU_NO_BEDS": "'ICU confirmed but bed_count=null'", "24_7_NO_STAFF": f"'is_24_7=true but GP=' || {j('staff.general_physician', 'unknown')} || ', surgeon=' || {j('staff.surgeon', 'unknown')}", "CARDIAC_SURGERY_RURAL_CLINIC": f"'cardiac=' || {j('surgery.cardiac', 'uncertain')} || ', facility_type=' || facility_type",
        "ZERO_DOCTORS_MANY_SPECIALTIES": "'total_doctors=0, specialist_types_count=' || json_array_length(j, '$.staff.specialist_types')", "VENTILATOR_NO_ICU": f"'ventilator=' || {j('ventilator.present', 'not_present')} || ', icu=' || {j('icu.present', 'uncertain')}",
        "CAESAREAN_NO_ANESTHESIOLOGIST": f"'caesarean=' || {cs} || ', anesthesiologist=' || {an}", "MISSING_CRITICAL_FIELDS": "'Only ' || CAST(round(completeness * 6) AS INT) || '/6 core fields extracted'", "EMPTY_DESCRIPTION": "'raw_text_used is empty'",
    }
    grave, cites = " ".join(f"WHEN {q(k)} THEN {q(extraction.RULES[k][0])}" for k in says), " ".join(f"WHEN {q(k)} THEN {v}" for k, v in says.items())
    return f"SELECT hospital_id, rule, CASE rule {grave} END AS severity, CASE rule {cites} END AS evidence FROM (SELECT *, unnest(flags) AS rule FROM conf)"


def _verified() -> str:
    all_of = lambda p, when: f"list_filter(CAST(json_extract(j, '$.{p}') AS JSON[]), lambda s: {when})"
    get = lambda s, k: f"coalesce(json_extract_string({s}, '$.{k}'), '')"
    spec, grave = all_of("verified_specialties", f"json_extract_string(s, '$.has') = 'true' AND list_contains({lst(vocab.MAJOR)}, json_extract_string(s, '$.specialty'))"), all_of("contradictions", "json_extract_string(s, '$.severity') IN ('high', 'medium')")
    has_it = "json_extract_string(s, '$.has') = 'true'"
    tools = f"array_to_string(list_transform({all_of('verified_equipment', has_it)}, lambda s: json_extract_string(s, '$.equipment')), ', ')"
    row = lambda when, rule, delta, cite: f"CASE WHEN {when} THEN {{'rule': {rule}, 'delta': {delta}, 'evidence': {cite}}} END"
    gaps = "CAST(json_extract(j, '$.completeness_flags.missing_fields') AS VARCHAR[])"
    rows = ", ".join([
        row("len(sp) > 0", "'Has major specialty: ' || " + get("sp[1]", "specialty"), 20, get("sp[1]", "evidence")), row("json_array_length(j, '$.verified_equipment') > 0", f"'Has equipment: ' || {tools}", 20, "coalesce(json_extract_string(j, '$.verified_equipment[0].evidence'), '')"),
        row("json_extract_string(j, '$.staffing.model') <> 'unknown'", "'Staffing model documented: ' || json_extract_string(j, '$.staffing.model')", 20, "coalesce(json_extract_string(j, '$.staffing.evidence'), '')"),
        row("len(gr) > 0", f"'Contradiction detected: ' || {get('gr[1]', 'claim')} || ' vs ' || {get('gr[1]', 'gap')}", -30, f"'Claim: ' || {get('gr[1]', 'evidence_claim')} || ' | Gap: ' || {get('gr[1]', 'evidence_gap')}"),
        row("json_array_length(j, '$.completeness_flags.missing_fields') > 2", "'Incomplete data: >2 key fields missing'", -10, f"array_to_string({gaps}, ', ')"),
    ])
    return f"v AS (SELECT hospital_id, CAST(verified_json AS JSON) AS j FROM scored), w AS (SELECT *, {spec} AS sp, {grave} AS gr FROM v), b AS (SELECT hospital_id, unnest(list_filter([{rows}], lambda x: x IS NOT NULL)) AS b FROM w)"


def _embedding() -> str:
    j = lambda p, d: f"coalesce(json_extract_string(j, '$.{p}'), '{d}')"
    return f"substr('Facility: ' || hospital_name || '. Location: ' || district || ', ' || state || ', PIN ' || pin_code || '. Type: ' || facility_type || '. Specialties: . ICU: ' || {j('icu.present', 'unknown')} || '. Emergency: ' || {j('emergency.emergency_care', 'unknown')} || '. Trust Score: ' || rule_trust || '. ' || substr({j('raw_text_used', '')}, 1, 300), 1, 2000)"


ORACLES = {
    "canonical_facilities": with_("SELECT hospital_id, hospital_name, state, district, pin_code, specialties, equipment, procedure, capability, staff, facility_type, latitude, longitude FROM clean", upto="clean"),
    "facility_tags": with_("SELECT hospital_id, array_to_string(st, ', ') AS specialty_tags, array_to_string(et, ', ') AS equipment_tags, array_to_string(stf, ', ') AS specialty_tags_full, array_to_string(etf, ', ') AS equipment_tags_full FROM tagged", upto="tagged"),
    "trust_scores": with_("SELECT hospital_id, trust_score, CASE WHEN trust_score >= 80 THEN 'strong' WHEN trust_score >= 50 THEN 'moderate' ELSE 'low' END AS tier, CAST(missing AS INT) AS missing, staffed AS has_staff FROM scored", upto="scored"),
    "trust_breakdown": with_(f"SELECT hospital_id, {_breakdown()} AS breakdown FROM cited"),
    "search_text": with_(f"""SELECT hospital_id, {strip("(hospital_name || ' | ' || specialties || ' | ' || equipment || ' | ' || procedure || ' | ' || capability || ' | ' || notes || ' | ' || facility_type || ' | ' || state || ' ' || district)")} AS search_text, CAST(length(concat_ws(' | ', hospital_name, notes, specialties, procedure, equipment, capability)) AS INT) AS composite_length,
 {state('state')} AS state_norm FROM clean""", upto="clean"),
    "state_deserts": scored_with(DESERTS, "SELECT state, facility_count, CAST(hospital_count AS BIGINT) AS hospital_count, round(t, 6) AS avg_trust_score, round(m, 6) AS major_specialty_share, round(hs, 6) AS hospital_share, round(d, 6) AS desert_score FROM ranked ORDER BY d DESC, state LIMIT 36"),
    "worst_state": scored_with(DESERTS, "SELECT max_by(state, d) AS state, round(max(d), 6) AS desert_score FROM ranked"),
    "overview": scored_with("k AS (SELECT coalesce(nullif(lower(facility_type), ''), 'unknown') AS kind, count(*) AS n FROM scored GROUP BY 1)", "SELECT count(*) AS total, round(avg(trust_score), 6) AS avg_trust, count(DISTINCT state) AS states_represented, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM k) AS facility_types FROM scored"),
    "specialty_state_counts": scored_with(SPEC_ROWS, "SELECT specialty, state, facility_count FROM cells"),
    "specialty_summary": scored_with(SPEC_ROWS, "SELECT specialty, count(*) AS total_facilities, count(DISTINCT state) AS states_covered, (SELECT string_agg(state || '=' || facility_count, ',' ORDER BY facility_count DESC, state) FROM (SELECT * FROM cells c WHERE c.specialty = sr.specialty ORDER BY facility_count DESC, state LIMIT 5)) AS top_states FROM sr GROUP BY specialty"),
    "specialty_matrix": scored_with(SPEC_ROWS, "SELECT specialty, state, facility_count FROM matrix"),
    "heatmap": scored_with(SPEC_ROWS, "SELECT specialty, state, coalesce(facility_count, 0) AS facility_count, round(coalesce(facility_count, 0) / greatest(1, max(coalesce(facility_count, 0)) OVER (PARTITION BY specialty)), 6) AS intensity FROM (SELECT DISTINCT specialty FROM matrix) CROSS JOIN (SELECT DISTINCT state FROM matrix) LEFT JOIN matrix USING (specialty, state)"),
    "flagged_contradictions": with_("SELECT hospital_id, hospital_name, nullif(state, '') AS state, nullif(pin_code, '') AS pin_code, trust_score, coalesce(ev_contradiction, '') AS evidence FROM cited WHERE clash ORDER BY hospital_id LIMIT 50"),
    "flagged_search": with_("SELECT * FROM (SELECT hospital_id, hospital_name, nullif(state, '') AS state, trust_score FROM cited WHERE clash ORDER BY hospital_id LIMIT 50) WHERE contains(lower(hospital_name), 'del') OR contains(lower(coalesce(state, '')), 'del')"),
    "quality_report": with_("SELECT count(*) AS total, count_if(notes <> '') AS with_description, count_if(equipment NOT IN ('', '[]')) AS with_equipment, count_if(latitude IS NOT NULL AND longitude IS NOT NULL) AS with_coords, count_if(pin_code <> '') AS with_zip FROM clean", upto="clean"),
    "state_counts": with_("SELECT state, count(*) AS k FROM clean GROUP BY state ORDER BY k DESC, state LIMIT 20", upto="clean"),
    "facility_coords": scored_with(COORDS, "SELECT hospital_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fac"),
    "radius_join": scored_with(COORDS + ", asked AS (SELECT pin_code AS query_pin, latitude AS q_lat, longitude AS q_lon FROM pins UNION ALL SELECT 'at ' || hospital_id, lat, lon FROM fac WHERE hospital_id % 50 = 0)",
        f"SELECT query_pin, hospital_id, round({km('q_lat', 'q_lon', 'lat', 'lon')}, 6) AS distance_km FROM asked, fac WHERE {km('q_lat', 'q_lon', 'lat', 'lon')} <= 150"),
    "tokens": f"SELECT doc_id, array_to_string({TOKENS('text')}, ' ') AS tokens FROM documents",
    "sentences": f"SELECT doc_id, len({sentences('text')}) AS n_sentences, {shortest(sentences('text'), lst(['idiot', 'the', 'license']))} AS quote FROM documents",
    "bm25_topk": f"WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) SELECT query, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "vector_topk": "WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_inner_product(a.v, b.v) AS score FROM x a, x b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, round(score, 6) AS score, rank FROM r WHERE rank <= 200",
    "minmax_rank": f"""WITH {NEAREST}, k AS (SELECT near.query AS query_id, near.id AS hospital_id, s, (a.label = b.label)::INT::DOUBLE AS kw, 1 / (1 + abs(a.label - b.label)) AS loc, 1 / (1 + abs(CAST(b.embedding[1] AS DOUBLE))) AS tr FROM near JOIN embeddings a ON a.vec_id = near.query JOIN embeddings b ON b.vec_id = near.id),
 m AS (SELECT *, CASE WHEN max(s) OVER w - min(s) OVER w < 1e-9 THEN (max(s) OVER w <> 0)::INT ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS n, CASE WHEN max(kw) OVER w - min(kw) OVER w < 1e-9 THEN (max(kw) OVER w <> 0)::INT ELSE (kw - min(kw) OVER w) / (max(kw) OVER w - min(kw) OVER w) END AS k FROM k WINDOW w AS (PARTITION BY query_id)),
 c AS (SELECT *, round(CASE WHEN query_id // 50 % 2 = 1 THEN 0.7 * loc + 0.2 * tr + 0.1 * n ELSE 0.5 * n + 0.2 * k + 0.2 * tr + 0.1 * loc END, 9) AS score FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hospital_id) AS rank FROM c) SELECT query_id, hospital_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "l2_normalize": "SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))",
    "extraction_trust": scored_with(STATUS, "SELECT hospital_id, bad AS failed, array_to_string(flags, ',') AS flags, rule_trust, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(overall, 6) AS overall, round(greatest(0, overall - 0.05 - 0.02 * len(flags)), 6) AS ci_low, CASE WHEN rule_trust >= 0.85 THEN 'A' WHEN rule_trust >= 0.7 THEN 'B' WHEN rule_trust >= 0.55 THEN 'C' WHEN rule_trust >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM conf"),
    "verified_trust": scored_with("v AS (SELECT hospital_id, CAST(verified_json AS JSON) AS j FROM scored)", f"""SELECT hospital_id, CAST(greatest(0, least(100, 20 * (len(list_filter(CAST(json_extract(j, '$.verified_specialties') AS JSON[]), lambda s: json_extract_string(s, '$.has') = 'true' AND list_contains({lst(vocab.MAJOR)}, json_extract_string(s, '$.specialty')))) > 0)::INT + 20 * (json_array_length(j, '$.verified_equipment') > 0)::INT
 + 20 * (json_extract_string(j, '$.staffing.model') <> 'unknown')::INT - 30 * (len(list_filter(CAST(json_extract(j, '$.contradictions') AS JSON[]), lambda s: json_extract_string(s, '$.severity') IN ('high', 'medium'))) > 0)::INT - 10 * (json_array_length(j, '$.completeness_flags.missing_fields') > 2)::INT)) AS INT) AS verified_score FROM v"""),
    "extraction_status": scored_with(STATUS, "SELECT hospital_id, icu_status, dialysis_status, emergency_status, surgery_status, icu_functional FROM conf"),
    "pin_deserts": scored_with(STATUS, "SELECT pin_code, state, facility_count, round(avg_trust_score, 6) AS avg_trust_score, icu_coverage, dialysis_coverage, emergency_coverage, surgery_coverage, round(centroid_lat, 6) AS centroid_lat, risk AS desert_risk_score, risk >= 0.7 AS is_high_risk, CASE WHEN len(kinds) > 0 THEN array_to_string(kinds, ',') ELSE 'ADEQUATE_COVERAGE' END AS desert_categories FROM pd"),
    "kept_deserts": scored_with(STATUS, "SELECT pin_code, state, facility_count, round(avg_trust_score, 6) AS avg_trust_score, icu_coverage, dialysis_coverage, emergency_coverage, surgery_coverage, round(centroid_lat, 6) AS centroid_lat, round(centroid_lon, 6) AS centroid_lon, risk AS desert_risk_score, risk >= 0.7 AS is_high_risk, CASE WHEN len(kinds) > 0 THEN array_to_string(kinds, ',') ELSE 'ADEQUATE_COVERAGE' END AS desert_categories FROM pd"),
    "state_risk_rollup": scored_with(STATUS, "SELECT state, count(*) AS pin_codes, CAST(sum((risk >= 0.7)::INT) AS BIGINT) AS high_risk_pins, round(avg(risk), 6) AS avg_desert_risk FROM pd GROUP BY state ORDER BY round(avg(risk), 6) DESC, state LIMIT 10"),
    "desert_map": scored_with(STATUS, "SELECT pin_code, state, risk AS desert_risk_score FROM pd WHERE list_contains(kinds, 'DIALYSIS_DESERT') ORDER BY risk DESC, pin_code, state LIMIT 100"),
    "desert_summary": scored_with(STATUS + ", m AS (SELECT * FROM pd ORDER BY risk DESC, pin_code, state LIMIT 100)", "SELECT count(*) AS total_regions, count_if(risk >= 0.7) AS high_risk_regions, round(count_if(risk >= 0.7) / count(*) * 100, 6) AS high_risk_percentage FROM m"),
    "needs_correction": scored_with(STATUS, "SELECT hospital_id, rule_trust, length(notes) AS note_length FROM conf WHERE rule_trust < 0.65"),
    "merge_updates": scored_with(STATUS, "SELECT hospital_id, CASE WHEN rule_trust < 0.65 THEN least(1.0, round(rule_trust + 0.1, 3)) ELSE rule_trust END AS rule_trust, CASE WHEN rule_trust < 0.65 THEN 1 ELSE 0 END AS correction_iterations FROM conf"),
    "merge_buckets": scored_with(STATUS, "SELECT hospital_id, CASE WHEN rule_trust < 0.65 THEN least(1.0, round(rule_trust + 0.1, 3)) ELSE rule_trust END AS rule_trust, CASE WHEN rule_trust < 0.65 THEN 1 ELSE 0 END AS correction_iterations FROM conf"),
    "tfidf_features": f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({lst(vocab.ENGLISH)}, x)) AS ws FROM documents),
 t AS (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, contains(term, ' '), term LIMIT 50000), n AS (SELECT count(*) AS n FROM documents),
 x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term), n), s AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM x GROUP BY doc_id)
 SELECT doc_id AS id, term, round(w / s, 6) AS weight FROM x JOIN s USING (doc_id)""",
    "parsed_queries": f"WITH {_parsed(f'SELECT c_custkey AS query_id, {fixture.asked_columns(False)} AS query FROM customer')} SELECT query_id, q AS raw_query, state, pin, radius_km, array_to_string(specialties, ',') AS specialties, array_to_string(requirements, ',') AS requirements, sort FROM parsed",
    "search_candidates": scored_with(COORDS + ", " + _candidates(), "SELECT query_id, hospital_id, round(km, 6) AS distance_km, round(location, 6) AS location FROM cand"),
    "hybrid_ranking": scored_with(COORDS + ", " + _hybrid(), "SELECT query_id, CAST(rank AS INT) AS rank, hospital_id, round(score, 6) AS score, round(kn, 6) AS keyword, round(location, 6) AS location, total_candidates FROM hr WHERE rank <= 10"),
    "nonempty_facilities": with_("SELECT hospital_id, CASE WHEN hospital_id % 2 = 0 THEN '' ELSE hospital_name END AS hospital_name FROM clean WHERE hospital_id % 2 <> 0 OR specialties <> '' OR notes <> '' OR equipment <> '' OR procedure <> '' OR capability <> ''", upto="clean"),
    "facility_ids": with_("SELECT state, hospital_name, hospital_id AS old_id, row_number() OVER (ORDER BY state, hospital_name, hospital_id) - 1 AS hospital_id FROM clean", upto="clean"),
    "bronze": with_("SELECT hospital_id, sha256(hospital_name) AS facility_id, true AS stamped FROM clean", upto="clean"),
    "geo_export": scored_with(COORDS, """SELECT '{"hospital_id":' || hospital_id || ',"latitude":' || round(lat, 4) || ',"longitude":' || round(lon, 4) || '}' AS record FROM fac WHERE lat IS NOT NULL AND lon IS NOT NULL"""),
    "facility_records": scored_with(COORDS, "SELECT hospital_id, hospital_name, trust_score, round(lat, 6) AS lat, array_to_string(stf, ',') AS tags FROM fac WHERE hospital_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)"),
    "vector_rerank": scored_with(NEAREST, "SELECT query AS query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS INT) AS rank, id AS hospital_id, round(s, 6) AS semantic, trust_score FROM near JOIN scored ON scored.hospital_id = near.id WHERE trust_score >= 30 AND lower(facility_type) = 'hospital' QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 20"),
    "trust_evidence": scored_with(STATUS, _evidence()),
    "verified_evidence": scored_with(_verified(), "SELECT hospital_id, b.rule AS rule, CAST(b.delta AS INT) AS delta, b.evidence AS evidence FROM b"),
    "gold_records": scored_with(STATUS, f"SELECT hospital_id, rule_trust, {_embedding()} AS embedding_text, 0 AS correction_iterations, '1.0' AS extraction_version FROM conf WHERE NOT bad"),
    "export_geo": scored_with(COORDS, "SELECT count(*) AS records FROM fac WHERE lat IS NOT NULL AND lon IS NOT NULL"),
}
