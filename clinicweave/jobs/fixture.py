"""A facility table derived from the customer table by key arithmetic, in Spark SQL and in DuckDB."""

from __future__ import annotations

STATES = ["Bihar", "UP", "Kerala", "tamil nadu", "Ambernath", "", "MH", "Delhi", "wb", "Assam", "Goa", "or"]
DISTRICTS = ["Patna", "Lucknow", "Kochi", "Chennai", "", "Mumbai", "New Delhi", "Kolkata", "Guwahati", "Gaya", "Delhi"]
PINS = ["800001", "226001.0", "682001", "600001", "400001", "110001", "", "700001", "800999", "999999", "12", "781001", "403001"]
SPECIALTIES = ['["icu","generalSurgery"]', "cardiologyAndNeurology", "[]", "", '["pediatrics","dialysis"]', "Trauma center, ortho", '["dentistry",null,""]']
EQUIPMENT = ['["CT scan","oxygen cylinder"]', "", "[]", "X-ray and ventilator", '["MRI"]']
PROCEDURE = ["", '["Performs dialysis"]', "", "[]", "Cardiac surgery with cath lab", "", "", "Blood storage", ""]
CAPABILITY = ["", '["24/7 emergency services"]', "", "[]", "", "Has 12 nurses and 3 doctors on duty", "", "Ambulance 108 available"]
NOTES = [
    "", "Fully equipped ICU with 10 beds. Open daily.", "General clinic.", "Heart care by visiting consultant. Oxygen supply is stable. Phone first.", "", "Trauma cases are referred. No ventilator.", "Maternity ward and nicu.",
    "Staff of 25 works in shifts", "Brain and neuro care\\nStaff 4 doctors", "", "Dialysis machine x 5 | Renal unit", "Cancer care. Chemo unit!", "Emergency ward open round the clock. Blood bank on site.", "", "Accident ward. Needs doctors.", "Labour room; gynecology", "Kidney care on Mondays? Yes.",
]
STAFF = ["", "5", "0", "12 doctors, 30 nurses", "[]", "visiting physician"]
FENCE = "`" * 3
EXTRACTIONS = [
    '{"icu":{"present":"confirmed","functional_status":"functional","bed_count":10},"ventilator":{"present":"confirmed","count":2},"staff":{"anesthesiologist":"full_time","surgeon":"full_time","general_physician":"full_time","specialist_types":["a","b"],"total_doctor_count":8},"emergency":{"emergency_care":"confirmed","is_24_7":true},"surgery":{"general_surgery":"confirmed","caesarean":"confirmed","cardiac":"uncertain"},"dialysis":{"present":"confirmed"},"raw_text_used":"full"}',
    '{"icu":{"present":"claimed","functional_status":"non_functional"},"staff":{"anesthesiologist":"unknown","specialist_types":["a","b","c","d"],"total_doctor_count":0},"surgery":{"general_surgery":"claimed","caesarean":"claimed","cardiac":"claimed"},"emergency":{"emergency_care":"claimed","is_24_7":true},"raw_text_used":""}',
    FENCE + 'json{"icu":{"present":"not_present"},"ventilator":{"present":"claimed"},"dialysis":{"present":"uncertain"},"raw_text_used":"some"}' + FENCE,
    "no json here",
    '{"icu":{"present":"confirmed","bed_count":null},"surgery":{"cardiac":"confirmed"},"raw_text_used":"x"}',
]
VERIFIED = [
    '{"verified_specialties":[{"specialty":"icu","has":true,"evidence":"e"}],"verified_equipment":[{"equipment":"mri","has":true,"evidence":"m"}],"staffing":{"model":"full_time","evidence":"s"},"contradictions":[],"completeness_flags":{"missing_fields":[]}}',
    '{"verified_specialties":[{"specialty":"icu","has":false,"evidence":"e"}],"verified_equipment":[],"staffing":{"model":"unknown","evidence":""},"contradictions":[{"claim":"c","gap":"g","severity":"low"},{"claim":"c","gap":"g","severity":"high"}],"completeness_flags":{"missing_fields":["a","b","c"]}}',
    '{"verified_specialties":[{"specialty":"trauma","has":true,"evidence":"e"}],"verified_equipment":[{"equipment":"ct","has":false,"evidence":""}],"staffing":{"model":"visiting","evidence":"v"},"contradictions":[{"claim":"c","gap":"g","severity":"medium"}],"completeness_flags":{"missing_fields":["a"]}}',
]
QUERIES = [
    "closest ICU in Bihar that has oxygen, urgent", "dialysis near 800001 within 50 km", "cardiology in UP", "maternity hospital in Tamil Nadu", "urgent trauma care 110001", "icu or trauma", "x-ray and ct scan in west bengal",
    "blood bank 999999 within 10 km", "heart care in goa within 100 km", "", "emergency ambulance in Kerala 682001 within 0 km", "child care in Sikkim",
]
PIN_TABLE = [
    ("800001", "Bihar", "Patna", 25.61, 85.14), ("800020", "Bihar", "Patna", 25.58, 85.16), ("823001", "Bihar", "Gaya", 24.79, 85.0), ("226001", "Uttar Pradesh", "Lucknow", 26.85, 80.95), ("682001", "Kerala", "Kochi", 9.97, 76.24),
    ("600001", "Tamil Nadu", "Chennai", 13.08, 80.27), ("400001", "Maharashtra", "Mumbai", 18.94, 72.84), ("110001", "Delhi", "New Delhi", 28.63, 77.22), ("700001", "West Bengal", "Kolkata", 22.57, 88.36), ("781001", "Assam", "Guwahati", 26.18, 91.75), ("403001", "Goa", "Panaji", 15.49, 73.83),
]
COLUMNS = {
    "district": DISTRICTS, "pin_code": PINS, "specialties": SPECIALTIES, "equipment": EQUIPMENT, "procedure": PROCEDURE, "capability": CAPABILITY, "notes": NOTES, "staff": STAFF,
    "extraction_json": EXTRACTIONS, "verified_json": VERIFIED,
}
KINDS = {"BUILDING": "Hospital", "AUTOMOBILE": "Clinic", "MACHINERY": "hospital", "HOUSEHOLD": ""}


def raw_columns(spark: bool) -> list[str]:
    """Expressions over customer for the raw facility table; text lists are still JSON."""

    def lit(x: str) -> str:
        return "'" + (x if spark else x.replace("\\n", "\n")) + "'"

    def pick(values: list[str], key: str) -> str:
        items = ", ".join(map(lit, values))
        return f"element_at(array({items}), cast({key} % {len(values)} + 1 as int))" if spark else f"list_extract([{items}], {key} % {len(values)} + 1)"

    kind = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())
    own = lambda base, by: f"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast({base} as double) + (c_custkey % 100) / cast({by} as double) END"
    return [
        "c_custkey AS hospital_id", "c_name AS hospital_name", f"{pick(STATES, 'c_nationkey')} AS state", *(f"{pick(v, 'c_custkey')} AS {k}" for k, v in COLUMNS.items()),
        f"CASE c_mktsegment {kind} ELSE 'farmacy' END AS facility_type", f"{own(20, 100)} AS latitude", f"{own(75, 50)} AS longitude",
    ]


def raw_sql() -> str:
    return f"SELECT {', '.join(raw_columns(False))} FROM customer"


def values_sql(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"cast({x} as double)" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def pins_sql() -> str:
    return values_sql(PIN_TABLE, "pin_code, state, district, latitude, longitude")


# Parts of the query text of each customer.
WISH = ["icu", "heart surgery", "dialysis", "X-ray and CT scan", "maternity", "trauma", "", "eye care", "vent and o2"]
MANNER = ["", "nearest", "urgent", "find", "24/7", "good"]
PLACE = ["in Bihar", "or West Bengal", "near 800001", "in UP", "", "around 12345", "at 110001 in delhi", "in a & b", "Tamil Nadu"]
REACH = ["", "within 50 km", "12 kms", "within 5 kilometers", "100km away", "km"]


def asked_columns(spark: bool) -> str:
    """An expression over customer: a query text, from the parts by key arithmetic."""
    lit = lambda values: ", ".join(f"'{x}'" for x in values)
    pick = lambda values: f"element_at(array({lit(values)}), cast(c_custkey % {len(values)} + 1 as int))" if spark else f"list_extract([{lit(values)}], c_custkey % {len(values)} + 1)"
    return f"concat(' ', {', chr(32), '.join(pick(v) for v in (MANNER, WISH, PLACE, REACH))}, ' ')"


def queries_sql() -> str:
    return values_sql(list(enumerate(QUERIES)), "query_id, query")


def batch_sql(spark: bool) -> str:
    """The fixed queries, and the text of every customer whose key 50 divides, numbered from 100 on."""
    return f"{queries_sql()} UNION ALL SELECT c_custkey + 100 AS query_id, {asked_columns(spark)} AS query FROM customer WHERE c_custkey % 50 = 0"
