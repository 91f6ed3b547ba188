"""Tags, trust score and citations of facilities: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab


def tag_facilities(df: DataFrame) -> DataFrame:
    both = lambda *cs: F.concat_ws(" ", *cs)
    return df.withColumns({
        "specialty_tags": text.tags(F.col("specialties"), vocab.SPECIALTIES),
        "equipment_tags": text.tags(F.col("equipment"), vocab.EQUIPMENT),
        "specialty_tags_full": text.tags(both("specialties", "procedure", "capability", "notes"), vocab.SPECIALTIES),
        "equipment_tags_full": text.tags(both("equipment", "procedure", "capability", "notes"), vocab.EQUIPMENT),
    })


def search_text() -> Column:
    parts = ["hospital_name", "specialties", "equipment", "procedure", "capability", "notes", "facility_type"]
    cells = [x for p in parts for x in (F.coalesce(F.col(p), F.lit("")), F.lit(" | "))]
    return text.strip(F.concat(*cells, F.coalesce("state", F.lit("")), F.lit(" "), F.coalesce("district", F.lit(""))))


def composite_text() -> Column:
    return F.concat_ws(" | ", "hospital_name", "notes", "specialties", "procedure", "equipment", "capability")


def has_staff() -> Column:
    fields = [text.strip(F.coalesce(F.col(c), F.lit(""))) for c in ("staff", "notes", "capability")]
    blob = F.lower(F.concat_ws(" ", *fields))
    word = F.lit(False)
    for w in vocab.STAFF_WORDS:
        word = word | F.contains(blob, F.lit(w))
    number = F.lit(False)
    for f in fields:
        number = number | f.rlike(r"^0*[1-9]\d*$")
    return (word & blob.rlike(r"\b\d{1,5}\b")) | number


def missing_fields() -> Column:
    place = F.concat(text.strip(F.coalesce("state", F.lit(""))), text.strip(F.coalesce("pin_code", F.lit(""))))
    kept = [text.has_content(F.col("specialties")), text.has_content(F.col("equipment"), F.col("procedure"), F.col("capability")), text.has_content(F.col("staff")) | F.col("_staff"), text.has_content(F.col("notes")), place != ""]
    return sum(((~k).cast("int") for k in kept), F.lit(0))


def score(df: DataFrame) -> DataFrame:
    """Adds trust_score; the flags that decide it are named _major, _equip, _staff, _missing, _bonus."""
    spec = F.when(F.size("specialty_tags_full") > 0, F.col("specialty_tags_full")).otherwise(F.col("specialty_tags"))
    equip = F.when(F.size("equipment_tags_full") > 0, F.col("equipment_tags_full")).otherwise(F.col("equipment_tags"))
    df = df.withColumns({"_spec": spec, "_equip_tags": equip, "_staff": has_staff()})
    df = df.withColumns({"_majors": F.array_intersect("_spec", text.strings(vocab.MAJOR)), "_equip": (F.size("_equip_tags") > 0) | text.has_content(F.col("equipment"), F.col("procedure"), F.col("capability")), "_missing": missing_fields(), "_bonus": F.least(F.lit(20), F.greatest(F.lit(0), F.size("_spec") + F.size("_equip_tags") - 1) * 2)})
    df = df.withColumns({"_major": F.size("_majors") > 0})
    df = df.withColumn("_clash", F.col("_major") & ~F.col("_equip") & ~F.col("_staff"))
    n = lambda c, by: F.col(c).cast("int") * by
    total = n("_major", 20) + n("_equip", 20) + n("_staff", 20) - n("_clash", 30) - (F.col("_missing") > 2).cast("int") * 10 + F.col("_bonus")
    return df.withColumn("trust_score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"))


def cite(df: DataFrame) -> DataFrame:
    """Adds the sentence behind each rule: ev_specialty, ev_equipment, ev_staff, ev_contradiction, ev_missing."""
    c = F.col
    df = df.withColumns({
        "_s1": text.sentences(text.gather(c("notes"), c("capability"), c("procedure"), c("specialties"))),
        "_s2": text.sentences(text.gather(c("notes"), c("capability"), c("procedure"), c("equipment"))),
        "_s3": text.sentences(text.gather(c("staff"), c("notes"), c("capability"))),
    })
    listed = F.concat(F.upper(F.array_join("_majors", ", ")), F.lit(" — listed in specialty tags"))
    raw = lambda name: F.when(~text.strip(F.coalesce(c(name), F.lit(""))).isin("", "[]"), text.strip(c(name)))
    gaps = [("specialties", "specialties"), ("equipment", "equipment"), ("staff", "staff"), ("notes", "notes"), ("location", "state")]
    names = F.array_join(F.array_compact(F.array(*(F.when(~text.has_content(c(col)), F.lit(label)) for label, col in gaps))), ", ")
    df = df.withColumns({
        "ev_specialty": F.when(c("_major"), text.shorten(F.coalesce(text.shortest_with(c("_s1"), text.needles(c("_majors"), vocab.SPECIALTIES)), listed))),
        "ev_equipment": text.shorten(F.coalesce(text.shortest_with(c("_s2"), text.needles(c("_equip_tags"), vocab.EQUIPMENT)), text.shortest_with(c("_s2"), text.strings(vocab.EQUIPMENT_HINTS)), raw("equipment"))),
        "ev_staff": text.shorten(F.coalesce(text.shortest_with(c("_s3"), text.strings(vocab.STAFF_CITED)), F.concat(F.lit("Staff field: "), raw("staff")))),
        "ev_missing": F.when(c("_missing") > 0, text.shorten(F.concat(F.lit("Missing canonical fields: "), F.when(names != "", names).otherwise("multiple")))),
    })
    claim = F.concat(F.lit('Claim: "'), c("ev_specialty"), F.lit('" -- but no equipment or staffing details were extracted from the notes.'))
    return df.withColumn("ev_contradiction", F.when(c("_major"), text.shorten(claim)))


def breakdown(df: DataFrame) -> DataFrame:
    """Adds trust_breakdown: the rules that count, in order, with their points and sentences."""
    c = F.col

    def item(rule, delta, evidence) -> Column:
        rule, delta = (x if isinstance(x, Column) else F.lit(x) for x in (rule, delta))
        return F.struct(rule.alias("rule"), delta.cast("int").alias("delta"), F.coalesce(evidence, F.lit("")).alias("evidence"))

    none = F.lit("")
    rules = F.array(
        F.when(c("_major"), item("Major specialty (ICU / dialysis / trauma / cardio / neuro) present", 20, c("ev_specialty"))).otherwise(item("No major specialty detected", 0, none)),
        F.when(c("_equip"), item("Equipment info present", 20, c("ev_equipment"))).otherwise(item("Equipment info missing", 0, none)),
        F.when(c("_staff"), item("Staffing info present", 20, c("ev_staff"))).otherwise(item("Staffing info missing", 0, none)),
        F.when(c("_clash"), item("Contradiction: claims major specialty but no equipment or staff", -30, c("ev_contradiction"))),
        F.when(c("_missing") > 2, item(F.concat(F.lit("Too many missing fields ("), c("_missing").cast("string"), F.lit("/5)")), -10, c("ev_missing"))),
        F.when(c("_bonus") > 0, item(F.concat(F.lit("Rich tagging bonus (+"), c("_bonus").cast("string"), F.lit(")")), c("_bonus"), none)),
    )
    return df.withColumn("trust_breakdown", F.array_compact(rules))


def tier(c: Column) -> Column:
    return F.when(c >= 80, "strong").when(c >= 50, "moderate").otherwise("low")


def enrich(df: DataFrame) -> DataFrame:
    """Tags, score, sentences, breakdown and search text."""
    out = breakdown(cite(score(tag_facilities(df))))
    return out.withColumns({"search_text": search_text(), "state_lc": F.lower("state"), "district_lc": F.lower("district"), "state_norm": text.normal_state(F.col("state"))}).drop("_s1", "_s2", "_s3")
