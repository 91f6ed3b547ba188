"""Extracted records (nested JSON): parsing, rule-based trust, confidence, coverage gaps, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab

# Fields of extracted and of verified records.
SCHEMA = """icu struct<present:string,functional_status:string,bed_count:int,neonatal_icu:string,source_text:string>,
ventilator struct<present:string,count:int,reliability_note:string,source_text:string>,
staff struct<anesthesiologist:string,surgeon:string,general_physician:string,specialist_types:array<string>,total_doctor_count:int,source_text:string>,
emergency struct<emergency_care:string,is_24_7:boolean,ambulance:string,trauma_capability:string,source_text:string>,
surgery struct<general_surgery:string,appendectomy:string,caesarean:string,orthopedic:string,cardiac:string,source_text:string>,
dialysis struct<present:string,machine_count:int,source_text:string>,
specialties_extracted array<string>, extraction_notes string, raw_text_used string, _corrupt string"""

VERIFIED = """verified_specialties array<struct<specialty:string,has:boolean,evidence:string>>, verified_equipment array<struct<equipment:string,has:boolean,evidence:string>>,
staffing struct<model:string,evidence:string>, contradictions array<struct<claim:string,gap:string,severity:string,evidence_claim:string,evidence_gap:string>>,
completeness_flags struct<missing_fields:array<string>>"""

# Rules of the trust score, their weight and what they take off.
RULES = {
    "SURGERY_NO_ANESTHESIOLOGIST": ("CRITICAL", 0.30), "ICU_NON_FUNCTIONAL": ("HIGH", 0.20), "ICU_NO_BEDS": ("MEDIUM", 0.10), "24_7_NO_STAFF": ("HIGH", 0.20),
    "CARDIAC_SURGERY_RURAL_CLINIC": ("HIGH", 0.20), "ZERO_DOCTORS_MANY_SPECIALTIES": ("MEDIUM", 0.15), "VENTILATOR_NO_ICU": ("MEDIUM", 0.10),
    "CAESAREAN_NO_ANESTHESIOLOGIST": ("HIGH", 0.25), "MISSING_CRITICAL_FIELDS": ("LOW", 0.10), "EMPTY_DESCRIPTION": ("LOW", 0.05),
}
RISK = {"icu": 0.35, "dialysis": 0.20, "emergency": 0.30, "surgery": 0.15}
HIGH_RISK, DESERT = 0.70, 0.10


def parse(df: DataFrame, json_col: str = "extraction_json") -> DataFrame:
    """Adds x, the record without code fences, and parse_error where there is none."""
    body = F.regexp_extract(F.coalesce(json_col, F.lit("")), r"(?s)\{.*\}", 0)
    x = F.from_json(body, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = (body == "") | x["_corrupt"].isNotNull()
    return df.withColumn("x", F.when(~bad, x)).withColumn("parse_error", F.when(bad, F.lit("not a JSON object")))


def _get(path: str, default: str) -> Column:
    return F.coalesce(F.col(f"x.{path}"), F.lit(default))


def _claimed(c: Column) -> Column:
    return c.isin("confirmed", "claimed")


def populated() -> Column:
    fields = [_get("icu.present", "uncertain") != "uncertain", _get("ventilator.present", "not_present") != "uncertain", _get("staff.anesthesiologist", "unknown") != "unknown", _get("emergency.emergency_care", "uncertain") != "uncertain", _get("surgery.general_surgery", "uncertain") != "uncertain", _get("dialysis.present", "uncertain") != "uncertain"]
    return sum((f.cast("int") for f in fields), F.lit(0))


def rule_trust(df: DataFrame, type_col: str = "facility_type") -> DataFrame:
    """Adds flags (rule, severity, penalty, evidence) and rule_trust: 1 less the penalties, between 0.05 and 1."""
    icu, vent, an = _get("icu.present", "uncertain"), _get("ventilator.present", "not_present"), _get("staff.anesthesiologist", "unknown")
    gp, surgeon = _get("staff.general_physician", "unknown"), _get("staff.surgeon", "unknown")
    general, caesarean, cardiac = (_get(f"surgery.{k}", "uncertain") for k in ("general_surgery", "caesarean", "cardiac"))
    here = lambda c: c.isin("full_time", "on_call")
    fired = {
        "SURGERY_NO_ANESTHESIOLOGIST": (_claimed(general) | _claimed(caesarean)) & (an == "unknown"),
        "ICU_NON_FUNCTIONAL": _claimed(icu) & (_get("icu.functional_status", "unknown") == "non_functional"),
        "ICU_NO_BEDS": (icu == "confirmed") & F.col("x.icu.bed_count").isNull(),
        "24_7_NO_STAFF": F.coalesce("x.emergency.is_24_7", F.lit(False)) & ~here(gp) & ~here(surgeon),
        "CARDIAC_SURGERY_RURAL_CLINIC": _claimed(cardiac) & F.contains(F.lower(F.coalesce(type_col, F.lit("unknown"))), F.lit("clinic")),
        "ZERO_DOCTORS_MANY_SPECIALTIES": (F.coalesce("x.staff.total_doctor_count", F.lit(-1)) == 0) & (F.coalesce(F.size("x.staff.specialist_types"), F.lit(0)) > 3),
        "VENTILATOR_NO_ICU": _claimed(vent) & (icu == "not_present"),
        "CAESAREAN_NO_ANESTHESIOLOGIST": _claimed(caesarean) & (an == "unknown"),
        "MISSING_CRITICAL_FIELDS": populated() < 3,
        "EMPTY_DESCRIPTION": text.strip(_get("raw_text_used", "")) == "",
    }
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    # What a rule cites.
    cited = {
        "SURGERY_NO_ANESTHESIOLOGIST": said("surgery=", general, ", caesarean=", caesarean, ", anesthesiologist=", an), "ICU_NON_FUNCTIONAL": said("icu.present=", icu, ", icu.functional_status=", _get("icu.functional_status", "unknown")),
        "ICU_NO_BEDS": said("ICU confirmed but bed_count=null"), "24_7_NO_STAFF": said("is_24_7=true but GP=", gp, ", surgeon=", surgeon), "CARDIAC_SURGERY_RURAL_CLINIC": said("cardiac=", cardiac, ", facility_type=", F.col(type_col)),
        "ZERO_DOCTORS_MANY_SPECIALTIES": said("total_doctors=0, specialist_types_count=", F.size("x.staff.specialist_types")), "VENTILATOR_NO_ICU": said("ventilator=", vent, ", icu=", icu),
        "CAESAREAN_NO_ANESTHESIOLOGIST": said("caesarean=", caesarean, ", anesthesiologist=", an), "MISSING_CRITICAL_FIELDS": said("Only ", populated(), "/6 core fields extracted"), "EMPTY_DESCRIPTION": said("raw_text_used is empty"),
    }
    items = F.array(*(F.when(when, F.struct(F.lit(k).alias("rule"), F.lit(RULES[k][0]).alias("severity"), F.lit(RULES[k][1]).alias("penalty"), cited[k].alias("evidence"))) for k, when in fired.items()))
    df = df.withColumn("flags", F.array_compact(items))
    left = F.aggregate("flags", F.lit(1.0), lambda a, f: a - f["penalty"])
    return df.withColumn("rule_trust", F.round(F.greatest(F.lit(0.05), F.least(F.lit(1.0), left)), 3))


def confidence(df: DataFrame, length_col: str = "text_length") -> DataFrame:
    """Adds completeness, consistency, reliability, overall and its interval."""
    count = lambda *kinds: F.size(F.filter("flags", lambda f: f["severity"].isin(*kinds)))
    n = F.col(length_col)
    df = df.withColumns({
        "completeness": populated() / 6, "consistency": F.greatest(F.lit(0.0), 1 - count("HIGH", "CRITICAL") * 0.25 - count("MEDIUM") * 0.10),
        "reliability": F.when(n > 1000, 0.85).when(n > 400, 0.65).when(n > 100, 0.45).otherwise(0.20),
    })
    df = df.withColumn("overall", F.col("completeness") * 0.40 + F.col("consistency") * 0.35 + F.col("reliability") * 0.25)
    noise = 0.05 + F.size("flags") * 0.02
    return df.withColumns({"ci_low": F.greatest(F.lit(0.0), F.col("overall") - noise), "ci_high": F.least(F.lit(1.0), F.col("overall") + noise)})


def grade(c: Column) -> Column:
    return F.when(c >= 0.85, "A").when(c >= 0.70, "B").when(c >= 0.55, "C").when(c >= 0.40, "D").otherwise("F")


def verified_trust(df: DataFrame, json_col: str = "verified_json") -> DataFrame:
    """Adds verified_score and verified_breakdown (rule, delta, evidence) from a verified record.

    What counts: a major specialty, equipment, staffing, the first grave contradiction, and gaps.
    """
    v = F.from_json(json_col, VERIFIED)
    major = F.exists(v["verified_specialties"], lambda s: s["has"] & s["specialty"].isin(*vocab.MAJOR))
    clash = F.exists(v["contradictions"], lambda c: c["severity"].isin("high", "medium"))
    n = lambda c, by: F.coalesce(c, F.lit(False)).cast("int") * by
    total = n(major, 20) + n(F.size(v["verified_equipment"]) > 0, 20) + n(v["staffing"]["model"] != "unknown", 20) - n(clash, 30) - n(F.size(v["completeness_flags"]["missing_fields"]) > 2, 10)
    first = lambda c, when: F.try_element_at(F.filter(c, when), F.lit(1))
    spec = first(v["verified_specialties"], lambda s: s["has"] & s["specialty"].isin(*vocab.MAJOR))
    grave = first(v["contradictions"], lambda c: c["severity"].isin("high", "medium"))
    tools = F.array_join(F.transform(F.filter(v["verified_equipment"], lambda e: e["has"]), lambda e: e["equipment"]), ", ")
    gaps, text_of = v["completeness_flags"]["missing_fields"], lambda c: F.coalesce(c, F.lit(""))
    item = lambda when, rule, delta, cite: F.when(when, F.struct(rule.alias("rule"), F.lit(delta).alias("delta"), text_of(cite).alias("evidence")))
    # The wording of the rules.
    rows = F.array(
        item(major, F.concat(F.lit("Has major specialty: "), spec["specialty"]), 20, spec["evidence"]), item(F.size(v["verified_equipment"]) > 0, F.concat(F.lit("Has equipment: "), tools), 20, v["verified_equipment"][0]["evidence"]),
        item(v["staffing"]["model"] != "unknown", F.concat(F.lit("Staffing model documented: "), v["staffing"]["model"]), 20, v["staffing"]["evidence"]),
        item(clash, F.concat(F.lit("Contradiction detected: "), text_of(grave["claim"]), F.lit(" vs "), text_of(grave["gap"])), -30, F.concat(F.lit("Claim: "), text_of(grave["evidence_claim"]), F.lit(" | Gap: "), text_of(grave["evidence_gap"]))),
        item(F.size(gaps) > 2, F.lit("Incomplete data: >2 key fields missing"), -10, F.array_join(gaps, ", ")),
    )
    return df.withColumns({"verified_score": F.greatest(F.lit(0), F.least(F.lit(100), total)), "verified_breakdown": F.array_compact(rows)})


def embedding_text(name: str = "hospital_name", state: str = "state", district: str = "district", pin: str = "pin_code", kind: str = "facility_type") -> Column:
    """What a facility is searched by: place, type, extracted specialties and status, trust, the start of its text; 2000 characters at most."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    # The wording of the sentence.
    return F.substring(F.concat(
        F.lit("Facility: "), of(name), F.lit(". Location: "), of(district), F.lit(", "), of(state), F.lit(", PIN "), of(pin), F.lit(". Type: "), of(kind), F.lit(". Specialties: "),
        F.coalesce(F.array_join("x.specialties_extracted", ", "), F.lit("")), F.lit(". ICU: "), _get("icu.present", "unknown"), F.lit(". Emergency: "), _get("emergency.emergency_care", "unknown"),
        F.lit(". Trust Score: "), of("rule_trust"), F.lit(". "), F.substring(_get("raw_text_used", ""), 1, 300),
    ), 1, 2000)


def status(df: DataFrame) -> DataFrame:
    cols = {"icu": "icu.present", "dialysis": "dialysis.present", "emergency": "emergency.emergency_care", "surgery": "surgery.general_surgery"}
    df = df.withColumns({f"{k}_status": _get(p, "uncertain") for k, p in cols.items()})
    df = df.withColumns({f"has_{k}": _claimed(F.col(f"{k}_status")).cast("int") for k in cols})
    return df.withColumn("icu_functional", _claimed(F.col("icu_status")) & (_get("icu.functional_status", "unknown") != "non_functional"))


def desert_sums(df: DataFrame, pin: str = "pin_code", state: str = "state", trust: str = "trust_score", sign: int = 1) -> DataFrame:
    """Sums by postal code and state from which deserts follow; those of batches add up, and removed rows count with `sign` -1.

    For each value its sum and how many rows have it, so that nulls count as they do in a mean. Rows
    without a code are left out before grouping.
    """
    values = {"trust": trust, **{k: f"has_{k}" for k in RISK}, "lat": "latitude", "lon": "longitude"}
    rows = df.where(F.coalesce(pin, F.lit("")) != "")
    each = [x for k, c in values.items() for x in ((F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)) * sign).alias(f"{k}_sum"), (F.count(c) * sign).alias(f"{k}_n"))]
    return rows.groupBy(F.col(pin).alias("pin_code"), F.col(state).alias("state")).agg((F.count(F.lit(1)) * sign).alias("facility_count"), *each)


def merge_sums(*sums: DataFrame) -> DataFrame:
    """The sums of several batches; groups of which all rows were removed are gone."""
    every = sums[0]
    for more in sums[1:]:
        every = every.unionByName(more)
    names = [c for c in every.columns if c not in ("pin_code", "state")]
    return every.groupBy("pin_code", "state").agg(*(F.sum(c).alias(c) for c in names)).where("facility_count > 0")


def deserts_of(sums: DataFrame) -> DataFrame:
    """Coverage and risk by postal code and state, from their sums."""
    mean = lambda k: F.when(F.col(f"{k}_n") > 0, F.col(f"{k}_sum") / F.col(f"{k}_n"))
    got = sums.select("pin_code", "state", "facility_count", mean("trust").alias("avg_trust_score"), *(F.round(mean(k), 3).alias(f"{k}_coverage") for k in RISK), mean("lat").alias("centroid_lat"), mean("lon").alias("centroid_lon"))
    risk = sum((w * (1 - F.col(f"{k}_coverage")) for k, w in RISK.items()), F.lit(0.0))
    got = got.withColumn("desert_risk_score", F.round(risk, 3))
    kinds = F.array_compact(F.array(*(F.when(F.col(f"{k}_coverage") < DESERT, F.lit(f"{k.upper()}_DESERT")) for k in RISK)))
    return got.withColumn("is_high_risk", F.col("desert_risk_score") >= HIGH_RISK).withColumn("desert_categories", F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("ADEQUATE_COVERAGE"))))


def pin_deserts(df: DataFrame, pin: str = "pin_code", state: str = "state", trust: str = "trust_score") -> DataFrame:
    """Coverage and risk by postal code and state; rows without a code are left out before grouping."""
    return deserts_of(desert_sums(df, pin, state, trust)).withColumnsRenamed({"pin_code": pin, "state": state})


def state_risk(deserts: DataFrame, state: str = "state", n: int = 10) -> DataFrame:
    got = deserts.groupBy(state).agg(F.count(F.lit(1)).alias("pin_codes"), F.sum(F.col("is_high_risk").cast("int")).alias("high_risk_pins"), F.avg("desert_risk_score").alias("avg_desert_risk"))
    return got.orderBy(F.desc("avg_desert_risk"), state).limit(n)


def desert_map(deserts: DataFrame, state: str | None = None, high_risk: bool = False, kind: str | None = None, n: int = 100, pin: str = "pin_code") -> DataFrame:
    rows = deserts.where(F.col("state") == state) if state else deserts
    rows = rows.where("is_high_risk") if high_risk else rows
    rows = rows.where(F.array_contains("desert_categories", kind)) if kind else rows
    return rows.orderBy(F.desc("desert_risk_score"), pin, "state").limit(n)


def desert_summary(regions: DataFrame) -> DataFrame:
    high = F.count_if("is_high_risk")
    return regions.agg(F.count(F.lit(1)).alias("total_regions"), high.alias("high_risk_regions"), F.when(F.count(F.lit(1)) > 0, high / F.count(F.lit(1)) * 100).otherwise(0.0).alias("high_risk_percentage"))


def assemble_gold(silver: DataFrame, bronze: DataFrame, key: str = "facility_id") -> DataFrame:
    """Extractions beside their facilities, scored and with their embedding text; of facilities that share an id, the first by its columns.

    Records that are no JSON object have no row.
    """
    rest = [c for c in bronze.columns if c != key]
    one = bronze.groupBy(key).agg(F.min(F.struct(*rest)).alias("b")).select(key, "b.*")
    rows = confidence(rule_trust(parse(silver.join(one, key, "left")).where("parse_error is null")))
    return rows.withColumns({"embedding_text": embedding_text(), "correction_iterations": F.lit(0), "extraction_version": F.lit("1.0")})


def needs_correction(gold: DataFrame, bronze: DataFrame, below: float = 0.65, key: str = "facility_id") -> DataFrame:
    return gold.where(F.col("rule_trust") < below).join(bronze, key, "left")


def merge_updates(gold: DataFrame, updates: DataFrame, columns: list[str], key: str = "facility_id") -> DataFrame:
    """Rows with an update get its values in `columns`, others stay as they are; keys are unique in updates."""
    new = updates.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    rows = gold.join(new, key, "left")
    return rows.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*gold.columns)
