"""Aggregates over scored facilities; groups are few and partial sums come before each shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from . import scoring


def overview(df: DataFrame) -> DataFrame:
    kinds = df.groupBy(F.when(F.coalesce("facility_type", F.lit("")) == "", "unknown").otherwise(F.lower("facility_type")).alias("kind")).count()
    kinds = kinds.agg(F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), F.col("count").cast("string")))), ",").alias("facility_types"))
    return df.agg(F.count(F.lit(1)).alias("total"), F.avg("trust_score").alias("avg_trust"), F.countDistinct("state").alias("states_represented")).crossJoin(kinds)  # one row each


def state_deserts(df: DataFrame, n: int = 36) -> DataFrame:
    major = (F.size(F.array_intersect("specialty_tags_full", text.strings(vocab.MAJOR))) > 0).cast("double")
    hospital = (F.lower(F.coalesce("facility_type", F.lit(""))) == "hospital").cast("int")
    rows = df.withColumn("s", text.normal_state(F.col("state"))).where(F.col("s").isin(*vocab.STATES))
    got = rows.groupBy(F.initcap("s").alias("state")).agg(F.count(F.lit(1)).alias("facility_count"), F.sum(hospital).alias("hospital_count"), F.avg("trust_score").alias("avg_trust_score"), F.avg(major).alias("major_specialty_share"), F.avg(hospital.cast("double")).alias("hospital_share"))
    got = got.withColumn("desert_score", (1 - F.col("major_specialty_share")) * 0.5 + (1 - F.col("avg_trust_score") / 100) * 0.5)
    return got.orderBy(F.desc("desert_score"), "state").limit(n)


def specialty_rows(df: DataFrame) -> DataFrame:
    """One row per facility and major specialty, with its state where that is a valid one."""
    s = text.normal_state(F.col("state"))
    return df.select(F.explode(F.array_intersect("specialty_tags_full", text.strings(vocab.MAJOR))).alias("specialty"), F.when(s.isin(*vocab.STATES), F.initcap(s)).alias("state"))


def specialty_state_counts(df: DataFrame) -> DataFrame:
    return specialty_rows(df).where("state is not null").groupBy("specialty", "state").agg(F.count(F.lit(1)).alias("facility_count"))


def specialty_summary(df: DataFrame, n: int = 5) -> DataFrame:
    counts = specialty_rows(df).groupBy("specialty", "state").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("specialty").orderBy(F.col("state").isNull(), F.desc("k"), "state")
    ranked = counts.withColumn("r", F.row_number().over(order))  # 36 states a specialty at most
    top = F.array_sort(F.collect_list(F.when(F.col("state").isNotNull() & (F.col("r") <= n), F.struct("r", "state", "k"))))
    return ranked.groupBy("specialty").agg(F.sum("k").alias("total_facilities"), F.count("state").alias("states_covered"), F.array_join(F.transform(top, lambda x: F.concat(x["state"], F.lit("="), x["k"].cast("string"))), ",").alias("top_states"))


def specialty_matrix(df: DataFrame, n: int = 20) -> DataFrame:
    cells = specialty_state_counts(df)
    best = cells.groupBy("state").agg(F.sum("facility_count").alias("k")).orderBy(F.desc("k"), "state").limit(n)
    return cells.join(F.broadcast(best), "state", "left_semi").select("specialty", "state", "facility_count")


def heatmap(df: DataFrame, n: int = 20) -> DataFrame:
    """Each specialty x top state, empty cells as 0, as a share of the specialty's largest cell."""
    cells = specialty_matrix(df, n)
    grid = cells.select("specialty").distinct().crossJoin(cells.select("state").distinct())  # 5 x n at most
    full = grid.join(cells, ["specialty", "state"], "left").fillna(0, ["facility_count"])
    top = F.max("facility_count").over(Window.partitionBy("specialty"))
    return full.select("specialty", "state", "facility_count", (F.col("facility_count") / F.when(top == 0, 1).otherwise(top)).alias("intensity"))


def flagged(df: DataFrame, n: int = 50) -> DataFrame:
    """The contradiction of the first `n` scored facilities that have one: these are found by their flag, and only they are cited."""
    # exploding the flag filters without a copy of all that makes it in the filter's condition
    hit = F.explode(F.when(F.col("_clash"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    first = df.withColumn("_hit", hit).orderBy("hospital_id").limit(n).drop("_hit")
    rows = scoring.breakdown(scoring.cite(first))
    hit = F.element_at(F.filter("trust_breakdown", lambda x: F.contains(F.lower(x["rule"]), F.lit("contradiction"))), 1)
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    rows = rows.select("hospital_id", "hospital_name", blank("state"), blank("district"), blank("pin_code"), "trust_score", hit.alias("hit"))
    return rows.select("hospital_id", "hospital_name", "state", "district", "pin_code", "trust_score", "hit.rule", "hit.evidence")


def filter_flagged(rows: DataFrame, needle: str) -> DataFrame:
    low = F.lit(needle.lower())
    return rows.where(F.contains(F.lower("hospital_name"), low) | F.contains(F.lower(F.coalesce("state", F.lit(""))), low))


def worst_state(deserts: DataFrame) -> DataFrame:
    by = F.struct("desert_score", "state")
    return deserts.agg(F.max_by("state", by).alias("state"), F.max("desert_score").alias("desert_score"))


def quality_report(df: DataFrame) -> DataFrame:
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return df.agg(F.count(F.lit(1)).alias("total"), filled("notes").alias("with_description"), F.count_if(~F.coalesce("equipment", F.lit("")).isin("", "[]")).alias("with_equipment"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("with_coords"), filled("pin_code").alias("with_zip"))


def state_counts(df: DataFrame, n: int = 20) -> DataFrame:
    return df.groupBy("state").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "state").limit(n)
