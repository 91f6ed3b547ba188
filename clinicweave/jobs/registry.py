"""Registered facility queries: each derives its rows from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import bm25, extraction, geo, queries, scoring, search, stats, vectors
from ..sources import buckets, tables
from . import fixture


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical facilities with their extraction records."""
    raw = tables.spread(_read(spark, sf_dir, "customer")).selectExpr(*fixture.raw_columns(True))  # a few narrow columns, of which much is made
    found = tables.drop_empty_rows(tables.resolve_columns(raw))
    return found.join(raw.select("hospital_id", "extraction_json", "verified_json"), "hospital_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(scoring.tag_facilities(facilities(spark, sf_dir)))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.enrich(facilities(spark, sf_dir))


def pins(spark: SparkSession) -> DataFrame:
    return tables.clean_pins(spark.sql(fixture.pins_sql()))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.facility_coords(enriched(spark, sf_dir), geo.centroids(pins(spark)))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extraction.rule_trust(extraction.parse(scored(spark, sf_dir).withColumn("text_length", F.length("notes"))))
    return extraction.confidence(rows)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def canonical_facilities(spark, sf_dir):
    return facilities(spark, sf_dir).select("hospital_id", "hospital_name", "state", "district", "pin_code", "specialties", "equipment", "procedure", "capability", "staff", "facility_type", "latitude", "longitude")


def facility_tags(spark, sf_dir):
    names = ["specialty_tags", "equipment_tags", "specialty_tags_full", "equipment_tags_full"]
    return scoring.tag_facilities(facilities(spark, sf_dir)).select("hospital_id", *(F.array_join(n, ", ").alias(n) for n in names))


def trust_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("hospital_id", "trust_score", scoring.tier(F.col("trust_score")).alias("tier"), F.col("_missing").alias("missing"), F.col("_staff").alias("has_staff"))


def trust_breakdown(spark, sf_dir):
    item = lambda x: F.concat(x["rule"], F.lit("|"), x["delta"].cast("string"), F.lit("|"), x["evidence"])
    return enriched(spark, sf_dir).select("hospital_id", F.array_join(F.transform("trust_breakdown", item), "\n").alias("breakdown"))


def search_text(spark, sf_dir):
    return facilities(spark, sf_dir).select("hospital_id", scoring.search_text().alias("search_text"), F.length(scoring.composite_text()).alias("composite_length"), text.normal_state(F.col("state")).alias("state_norm"))


def state_deserts(spark, sf_dir):
    return _rounded(stats.state_deserts(scored(spark, sf_dir)), "avg_trust_score", "major_specialty_share", "hospital_share", "desert_score")


def worst_state(spark, sf_dir):
    return _rounded(stats.worst_state(stats.state_deserts(scored(spark, sf_dir))), "desert_score")


def overview(spark, sf_dir):
    return _rounded(stats.overview(scored(spark, sf_dir)), "avg_trust")


def specialty_state_counts(spark, sf_dir):
    return stats.specialty_state_counts(scored(spark, sf_dir))


def specialty_summary(spark, sf_dir):
    return stats.specialty_summary(scored(spark, sf_dir))


def specialty_matrix(spark, sf_dir):
    return stats.specialty_matrix(scored(spark, sf_dir))


def heatmap(spark, sf_dir):
    return _rounded(stats.heatmap(scored(spark, sf_dir)), "intensity")


def flagged_contradictions(spark, sf_dir):
    return stats.flagged(scored(spark, sf_dir)).select("hospital_id", "hospital_name", "state", "pin_code", "trust_score", "evidence")


def flagged_search(spark, sf_dir):
    return stats.filter_flagged(stats.flagged(scored(spark, sf_dir)), "del").select("hospital_id", "hospital_name", "state", "trust_score")


def quality_report(spark, sf_dir):
    return stats.quality_report(facilities(spark, sf_dir))


def state_counts(spark, sf_dir):
    return stats.state_counts(facilities(spark, sf_dir))


def facility_coords(spark, sf_dir):
    return _rounded(located(spark, sf_dir).select("hospital_id", "lat", "lon"), "lat", "lon")


def radius_join(spark, sf_dir):
    """Facilities within 150 km of postal codes, and of every facility whose id 50 divides."""
    places = tables.stage(located(spark, sf_dir).select("hospital_id", "lat", "lon"), "places")
    asked = pins(spark).select(F.col("pin_code").alias("query_pin"), F.col("latitude").alias("q_lat"), F.col("longitude").alias("q_lon"))
    own = places.where("hospital_id % 50 = 0").select(F.concat(F.lit("at "), F.col("hospital_id").cast("string")), "lat", "lon")
    asked = asked.union(own).withColumn("radius_km", F.lit(150.0))
    return geo.radius_join(asked, places, digits=6).select("query_pin", "hospital_id", "distance_km")


def tokens(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


def sentences(spark, sf_dir):
    found = _read(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), text.shortest_with(F.col("s"), text.strings(["idiot", "the", "license"])).alias("quote"))


def bm25_topk(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("tokens"))
    return bm25.best(asked, docs, "doc_id", 10)[0].select("query", F.col("id").alias("doc_id"), "score", "rank")


def _similar(spark, sf_dir, k):
    vecs = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.vector_topk(vecs.where("id % 50 = 0").select(F.col("id").alias("query"), "vec"), vecs, k)


def vector_topk(spark, sf_dir):
    return _rounded(_similar(spark, sf_dir, 200), "score")


def minmax_rank(spark, sf_dir):
    """Both weightings over the 200 nearest of each query: even queries by relevance, odd ones by urgency; signals from labels and vectors."""
    vecs = _read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>")[0].alias("x"))
    one, two = vecs.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), vecs.select(F.col("vec_id").alias("hospital_id"), "label", "x")
    pairs = _similar(spark, sf_dir, 200).select(F.col("query").alias("query_id"), F.col("id").alias("hospital_id"), F.col("score").alias("semantic")).join(one, "query_id").join(two, "hospital_id")
    rows = pairs.withColumns({"keyword": (F.col("label") == F.col("q_label")).cast("double"), "location": 1 / (1 + F.abs(F.col("label") - F.col("q_label"))), "trust": 1 / (1 + F.abs("x"))})
    rows = search.minmax(rows, ["semantic", "keyword"]).withColumn("score", F.round(search.combined((F.col("query_id") / 50).cast("long") % 2 == 1), 9))
    return _rounded(search.top_k(rows, 10).select("query_id", "hospital_id", "score", "rank"), "score")


def l2_normalize(spark, sf_dir):
    u = _read(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return _rounded(u.select("vec_id", F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x).alias("norm"), F.col("u")[0].alias("first")), "norm", "first")


def extraction_trust(spark, sf_dir):
    rows = gold(spark, sf_dir)
    return _rounded(rows.select("hospital_id", F.col("parse_error").isNotNull().alias("failed"), F.array_join("flags.rule", ",").alias("flags"), "rule_trust", "completeness", "consistency", "overall", "ci_low", extraction.grade(F.col("rule_trust")).alias("grade")), "completeness", "consistency", "overall", "ci_low")


def verified_trust(spark, sf_dir):
    return extraction.verified_trust(facilities(spark, sf_dir)).select("hospital_id", "verified_score")


def extraction_status(spark, sf_dir):
    return extraction.status(gold(spark, sf_dir)).select("hospital_id", "icu_status", "dialysis_status", "emergency_status", "surgery_status", "icu_functional")


def _deserts(spark, sf_dir):
    return extraction.pin_deserts(extraction.status(gold(spark, sf_dir)))


def pin_deserts(spark, sf_dir):
    rows = _deserts(spark, sf_dir).withColumn("desert_categories", F.array_join("desert_categories", ",")).drop("centroid_lon")
    return _rounded(rows, "avg_trust_score", "centroid_lat")


def kept_deserts(spark, sf_dir):
    """The same from sums that are kept: a batch, one that is added, and one that is added and removed again; with both coordinates."""
    rows = tables.stage(extraction.status(gold(spark, sf_dir)).select("hospital_id", "pin_code", "state", "trust_score", *(f"has_{k}" for k in extraction.RISK), "latitude", "longitude"), "status")
    sums = tables.stage(extraction.desert_sums(rows.where("hospital_id % 3 = 0")), "sums")
    for n in (1, 2):
        sums = tables.stage(extraction.merge_sums(sums, extraction.desert_sums(rows.where(f"hospital_id % 3 = {n}"))), "sums")
    twice = rows.where("hospital_id % 5 = 0").withColumn("pin_code", F.concat("pin_code", F.lit("x")))
    sums = extraction.merge_sums(sums, extraction.desert_sums(twice), extraction.desert_sums(twice, sign=-1))
    found = extraction.deserts_of(sums).withColumn("desert_categories", F.array_join("desert_categories", ","))
    return _rounded(found, "avg_trust_score", "centroid_lat", "centroid_lon")


def state_risk_rollup(spark, sf_dir):
    return _rounded(extraction.state_risk(_deserts(spark, sf_dir)), "avg_desert_risk")


def desert_map(spark, sf_dir):
    return extraction.desert_map(_deserts(spark, sf_dir), kind="DIALYSIS_DESERT").select("pin_code", "state", "desert_risk_score")


def desert_summary(spark, sf_dir):
    return _rounded(extraction.desert_summary(extraction.desert_map(_deserts(spark, sf_dir))), "high_risk_percentage")


def needs_correction(spark, sf_dir):
    rows = gold(spark, sf_dir)
    texts = facilities(spark, sf_dir).select("hospital_id", F.length("notes").cast("long").alias("note_length"))
    return extraction.needs_correction(rows.select("hospital_id", "rule_trust"), texts, key="hospital_id")


def merge_updates(spark, sf_dir):
    rows = gold(spark, sf_dir).select("hospital_id", "rule_trust", F.lit(0).alias("correction_iterations"))
    new = rows.where("rule_trust < 0.65").select("hospital_id", F.least(F.lit(1.0), F.round(F.col("rule_trust") + 0.1, 3)).alias("rule_trust"), F.lit(1).alias("correction_iterations"))
    return extraction.merge_updates(rows, new, ["rule_trust", "correction_iterations"], "hospital_id")


def merge_buckets(spark, sf_dir):
    """The same through a table in buckets, of which updates rewrite those they touch; of two updates of a key the later counts."""
    rows = tables.stage(gold(spark, sf_dir).select("hospital_id", "rule_trust", F.lit(0).alias("correction_iterations")), "gold")
    first = rows.where("rule_trust < 0.65").select("hospital_id", F.lit(0.0).alias("rule_trust"), F.lit(9).alias("correction_iterations"), F.lit(1).alias("nr"))
    last = rows.where("rule_trust < 0.65").select("hospital_id", F.least(F.lit(1.0), F.round(F.col("rule_trust") + 0.1, 3)).alias("rule_trust"), F.lit(1).alias("correction_iterations"), F.lit(2).alias("nr"))
    path = tables.scratch(spark, "gold_buckets")
    buckets.write(rows, path, "hospital_id", 64)
    buckets.merge(spark, path, first.union(last), ["rule_trust", "correction_iterations"], latest_by="nr")
    return buckets.read(spark, path)


def export_geo(spark, sf_dir):
    return tables.geo_records(located(spark, sf_dir).select("hospital_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))).agg(F.count(F.lit(1)).alias("records"))


def _batch(spark, sf_dir):
    """The fixed queries and those of customers, parsed."""
    customer = _read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").selectExpr("c_custkey + 100 as query_id", f"{fixture.asked_columns(True)} as query")
    asked = spark.sql(fixture.queries_sql()).withColumn("query_id", F.col("query_id").cast("long")).union(customer)
    return tables.stage(queries.parse_queries(asked).select("query_id", "state", "pin", "radius_km", "specialties", "requirements", "sort", "raw_query"), "parsed")


def _index(spark, sf_dir):
    """What the search reads of each facility, and a way to get the citations of those it shows."""
    rows = scored(spark, sf_dir).withColumn("search_text", scoring.search_text())
    rows = geo.facility_coords(rows, geo.centroids(pins(spark))).select("hospital_id", "hospital_name", "state", "district", "pin_code", "lat", "lon", "trust_score", "specialty_tags", "specialty_tags_full", "equipment_tags_full", "search_text")
    return tables.stage(rows, "index"), lambda ids: scoring.enrich(facilities(spark, sf_dir).join(tables.fits(ids, 64)(ids), "hospital_id", "left_semi"))


def hybrid_search(spark, sf_dir):
    """The fixed queries and those of customers over all facilities; parsed, filtered, ranked and explained."""
    index, cited = _index(spark, sf_dir)  # several signals read it
    encoder = vectors.SvdEncoder.learn(index, "hospital_id", "search_text")

    def answer(asked):
        semantic = tables.stage(search.semantic_scores(asked, index, encoder), "semantic")  # scaling reads it twice
        return search.hybrid_search(asked, index, geo.centroids(pins(spark)), semantic=semantic, cited=cited)

    return search.once(_batch(spark, sf_dir), answer)


def hybrid_ranking(spark, sf_dir):
    """The same by keywords, trust and place alone, without the encoder's signal."""
    index, cited = _index(spark, sf_dir)
    found = search.once(_batch(spark, sf_dir), lambda asked: search.hybrid_search(asked, index, geo.centroids(pins(spark)), cited=cited))
    return _rounded(found.select("query_id", "rank", "hospital_id", "score", "keyword", "location", "total_candidates"), "score", "keyword", "location")


def tfidf_features(spark, sf_dir):
    return _rounded(vectors.tfidf(_read(spark, sf_dir, "documents"), "doc_id", "text", stop=vocab.ENGLISH), "weight")


def parsed_queries(spark, sf_dir):
    """A query text of each customer, parsed."""
    asked = _read(spark, sf_dir, "customer").selectExpr("c_custkey as query_id", f"{fixture.asked_columns(True)} as query")
    tags = lambda c: F.array_join(c, ",").alias(c)
    return queries.parse_queries(asked).select("query_id", "raw_query", "state", "pin", "radius_km", tags("specialties"), tags("requirements"), "sort")


def search_candidates(spark, sf_dir):
    """The candidates of each query of the batch, with their distance and location score."""
    asked = _batch(spark, sf_dir)
    q = geo.pin_coords(asked, geo.centroids(pins(spark)), "pin", "_at").select("query_id", "state", "radius_km", F.col("_at.lat").alias("q_lat"), F.col("_at.lon").alias("q_lon"))
    rows = tables.stage(located(spark, sf_dir).select("hospital_id", "state", "district", "lat", "lon"), "places")
    return search.filter_candidates(q, rows, 6)


def nonempty_facilities(spark, sf_dir):
    """Facilities of which some are blanked, without the rows that say nothing."""
    said = ("hospital_name", "specialties", "notes", "equipment", "procedure", "capability")
    blank = {c: F.when(F.col("hospital_id") % (2 + k) == 0, "").otherwise(F.col(c)) for k, c in enumerate(said[:1])}
    return tables.drop_empty_rows(facilities(spark, sf_dir).withColumns(blank)).select("hospital_id", "hospital_name")


def facility_ids(spark, sf_dir):
    """Dense ids in order of state and name."""
    rows = facilities(spark, sf_dir).select("state", "hospital_name", F.col("hospital_id").alias("old_id"))
    return tables.assign_ids(rows, ["state", "hospital_name", "old_id"])


def bronze(spark, sf_dir):
    return tables.ingest_bronze(facilities(spark, sf_dir)).select("hospital_id", "facility_id", F.col("_ingest_ts").isNotNull().alias("stamped"))


def geo_export(spark, sf_dir):
    """The records that an export holds, read back as text."""
    rows = located(spark, sf_dir).select("hospital_id", F.round("lat", 4).alias("latitude"), F.round("lon", 4).alias("longitude"))
    return tables.geo_records(rows)


def facility_records(spark, sf_dir):
    """Single records: of the customers of each tenth supplier key that is one."""
    asked = _read(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").alias("hospital_id"))
    return search.get_facility(located(spark, sf_dir), asked).select("hospital_id", "hospital_name", "trust_score", F.round("lat", 6).alias("lat"), F.array_join("specialty_tags_full", ",").alias("tags"))


def vector_rerank(spark, sf_dir):
    """Nearest vectors as facilities: refreshed from the scored table, filtered by trust and type, best 20."""
    found = _similar(spark, sf_dir, 200).select(F.col("query").alias("query_id"), F.col("id").alias("hospital_id"), F.col("score").alias("semantic"))
    gold_table = tables.stage(scored(spark, sf_dir).select("hospital_id", "trust_score", "state", "facility_type"), "scored")
    return _rounded(search.filter_then_rank(found, gold_table, 30, kind="hospital"), "semantic")


def trust_evidence(spark, sf_dir):
    """What the rules of extracted records cite."""
    flags = gold(spark, sf_dir).select("hospital_id", F.explode("flags").alias("f"))
    return flags.select("hospital_id", "f.rule", "f.severity", "f.evidence")


def verified_evidence(spark, sf_dir):
    """What the rules of verified records cite."""
    rows = extraction.verified_trust(facilities(spark, sf_dir)).select("hospital_id", F.explode("verified_breakdown").alias("b"))
    return rows.select("hospital_id", "b.rule", "b.delta", "b.evidence")


def gold_records(spark, sf_dir):
    """Gold assembled from extractions and facilities, with the embedding text."""
    rows = facilities(spark, sf_dir).withColumn("facility_id", F.sha2(F.col("hospital_name"), 256))
    silver = rows.select("facility_id", "extraction_json")
    base = rows.select("facility_id", "hospital_id", "hospital_name", "district", "state", "pin_code", "facility_type", F.length("notes").alias("text_length"))
    found = extraction.assemble_gold(silver, base)
    return found.select("hospital_id", "rule_trust", "embedding_text", "correction_iterations", "extraction_version")


def svd_embed(spark, sf_dir):
    """Every document in up to 384 dimensions of a truncated SVD; axes are unique up to sign only."""
    docs = _read(spark, sf_dir, "documents")
    return vectors.SvdEncoder.learn(docs, "doc_id", "text").encode(docs, "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        state_deserts, canonical_facilities, facility_tags, trust_scores, trust_breakdown, search_text, worst_state, overview, specialty_state_counts, specialty_summary, specialty_matrix, heatmap,
        flagged_contradictions, flagged_search, quality_report, state_counts, facility_coords, radius_join, tokens, sentences, bm25_topk, vector_topk, minmax_rank, l2_normalize, extraction_trust,
        verified_trust, extraction_status, pin_deserts, kept_deserts, state_risk_rollup, desert_map, desert_summary, needs_correction, merge_updates, merge_buckets, export_geo, hybrid_search, hybrid_ranking, tfidf_features, svd_embed,
        parsed_queries, search_candidates, nonempty_facilities, facility_ids, bronze, geo_export, facility_records, vector_rerank, trust_evidence, verified_evidence, gold_records,
    )
}
