import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinicweave.functions import text, vocab
from clinicweave.jobs import registry
from clinicweave.operators import bm25, extraction, geo, queries, scoring, search, stats, vectors
from clinicweave.sources import tables

SF = "/root/testdata/sf0.001"
BASE = {"specialties": "", "equipment": "", "procedure": "", "capability": "", "notes": "", "staff": "", "state": "Bihar", "district": "Patna", "pin_code": "800001", "facility_type": "Hospital", "hospital_name": "H"}


def facility(spark, **fields):
    row = BASE | fields
    return spark.createDataFrame([(1, *row.values())], ", ".join(["hospital_id long", *(f"{k} string" for k in row)]))


def test_full_record_scores_high(spark):
    r = scoring.enrich(facility(spark, specialties="icu", equipment="ventilator", staff="5 doctors", notes="ICU with 10 beds. 5 doctors on duty.")).first()
    assert r.trust_score >= 60
    assert sum(x.delta for x in r.trust_breakdown) == r.trust_score
    assert r.trust_breakdown[0].evidence == "ICU with 10 beds."


def test_contradiction_and_empty(spark):
    r = scoring.enrich(facility(spark, specialties="cardiology")).first()
    assert r.trust_score <= 10 and any("Contradiction" in x.rule for x in r.trust_breakdown)
    r = scoring.enrich(facility(spark, state="", pin_code="")).first()
    assert r.trust_score == 0 and r.ev_missing.startswith("Missing canonical fields: specialties")


def test_resolve_columns_first_alias_wins(spark):
    df = spark.createDataFrame([("n", '["a"]', "1.5", "y")], "Name string, facilities string, LAT string, phone_numbers string")
    r = tables.resolve_columns(df).first()
    assert (r.hospital_name, r.equipment, r.latitude, r.phone, r.state, r.longitude) == ("n", "a", 1.5, "y", "", None)


def test_ids_are_dense(spark):
    df = spark.createDataFrame([(x,) for x in "cabd"], "k string").repartition(3)
    assert [(r.k, r.hospital_id) for r in tables.assign_ids(df, ["k"]).collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "bihar"), (2, "goa")], "hospital_id int, state_norm string")
    tables.write_index(df, str(tmp_path / "index"))
    assert tables.read_index(spark, str(tmp_path / "index")).count() == 2


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("closest ICU in Bihar that has oxygen, urgent", ("Bihar", None, 30.0, ["icu"], ["oxygen"], "distance")),
        ("dialysis near 800001 within 50 km", (None, "800001", 50.0, ["dialysis"], [], "distance")),
        ("cardiology in UP", ("Uttar Pradesh", None, None, ["cardiology"], [], "relevance")),
        ("icu or trauma", ("Odisha", None, None, ["icu", "trauma"], [], "relevance")),
        ("o2 and vent", (None, None, None, [], ["oxygen", "ventilator"], "relevance")),
        ("", (None, None, None, [], [], "relevance")),
    ],
)
def test_parse_queries(spark, query, want):
    r = queries.parse_queries(spark.createDataFrame([(query,)], "query string")).first()
    assert (r.state, r.pin, r.radius_km, r.specialties, r.requirements, r.sort) == want


def test_radius_join_equals_brute_force(spark):
    pts = [(i, -60 + (i * 37 % 120) + i / 997, -180 + (i * 53 % 360) + i / 991) for i in range(400)]
    f = spark.createDataFrame(pts, "hospital_id int, lat double, lon double")
    q = spark.createDataFrame([(k, *pts[k * 7][1:], 600.0 + 40 * k) for k in range(30)], "query_id int, q_lat double, q_lon double, radius_km double")
    got = {(r.query_id, r.hospital_id) for r in geo.radius_join(q, f).collect()}

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    want = {(k, i) for k in range(30) for i, y, x in pts if km(*pts[k * 7][1:], y, x) <= 600.0 + 40 * k}
    assert got == want


def test_minmax(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0), (1, 4.0, 0.0), (2, 3.0, 3.0)], "query_id int, a double, b double")
    assert sorted(tuple(r) for r in search.minmax(df, ["a", "b"]).collect()) == [(1, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0)]


def test_encoder(spark, tmp_path):
    texts = ["icu beds and oxygen", "icu oxygen supply", "dental care clinic", "dental clinic braces", "eye care clinic", "icu beds ventilator"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    features = vectors.tfidf(docs, "id", "text", stop=["and"])
    encoder = vectors.SvdEncoder.fit(features, 3)
    vecs = {r.id: r.vec for r in encoder.transform(features).collect()}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-4 for v in vecs.values())
    dot = lambda a, b: sum(x * y for x, y in zip(vecs[a], vecs[b]))
    assert dot(0, 1) > dot(0, 3)
    encoder.save(str(tmp_path / "e.npz"))
    again = {r.id: r.vec for r in vectors.SvdEncoder.load(str(tmp_path / "e.npz")).transform(features).collect()}
    assert all(abs(x - y) < 1e-6 for k in vecs for x, y in zip(vecs[k], again[k]))
    with pytest.raises(RuntimeError):
        vectors.SvdEncoder([], None).transform(features)


def test_no_python_in_scoring_plan(spark):
    plan = scoring.enrich(facility(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_parse_extraction_keeps_failures_apart(spark):
    df = spark.createDataFrame([(1, '```json\n{"icu":{"present":"claimed"}}\n```'), (2, "nothing"), (3, None)], "i int, extraction_json string")
    got = {r.i: (r.x.icu.present if r.x else None, r.parse_error is not None) for r in extraction.parse(df).collect()}
    assert got == {1: ("claimed", False), 2: (None, True), 3: (None, True)}


def test_state_deserts_of_nothing(spark):
    assert stats.state_deserts(scoring.score(scoring.tag_facilities(facility(spark).where(F.lit(False))))).count() == 0


def _semantic_by_brute_force(asked, texts, k, dim):
    words = lambda t: [w for w in re.findall(r"[a-z0-9_]{2,}", (t or "").lower()) if w not in vocab.ENGLISH]
    terms = lambda t: Counter((w := words(t)) + [f"{a} {b}" for a, b in zip(w, w[1:])])
    rows = {i: terms(t) for i, t in texts.items()}
    df = Counter(t for r in rows.values() for t in r)
    at = {t: n for n, t in enumerate(sorted(t for t in df if df[t] >= 2))}

    def vec(counts):
        x = np.zeros(len(at))
        for t, tf in counts.items():
            if t in at:
                x[at[t]] = (1 + math.log(tf)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1)
        return x / (np.linalg.norm(x) or 1)

    ids = sorted(rows)
    a = np.array([vec(rows[i]) for i in ids])
    v = np.linalg.svd(a)[2][:dim].T
    unit = lambda y: y / (n if (n := np.linalg.norm(y)) >= 1e-9 else 1)
    e = [unit(x @ v) for x in a]
    out = {}
    for q, t in asked.items():
        s = [(-round(float(unit(vec(terms(t)) @ v) @ y), 9), i) for i, y in zip(ids, e)]
        out |= {(q, i): -x for x, i in sorted(s)[:k]}
    return out


def test_semantic_scores_equal_brute_force(spark, tmp_path):
    texts = {1: "ICU beds and oxygen supply", 2: "icu oxygen supply ward", 3: "dental care clinic", 4: "dental clinic braces care", 5: "eye care clinic", 6: "icu beds ventilator oxygen", 7: None, 8: "zzz", 9: "eye surgery ward"}
    asked = {0: "oxygen and ICU beds", 1: "dental clinic", 2: "", 3: "the unknown"}
    facilities = spark.createDataFrame(list(texts.items()), "hospital_id long, search_text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id int, raw_query string")
    encoder = vectors.SvdEncoder.learn(facilities, "hospital_id", "search_text", k=4)
    encoder.save(str(tmp_path / "e.npz"))
    got = {(r.query_id, r.hospital_id): r.semantic for r in search.semantic_scores(queries, facilities, vectors.SvdEncoder.load(str(tmp_path / "e.npz")), 5).collect()}
    want = _semantic_by_brute_force(asked, texts, 5, 4)
    assert len(got) == 20 and all(abs(got[p] - want[p]) < 1e-6 for p in got if p[0] < 2) and {p for p in got if p[0] < 2} == {p for p in want if p[0] < 2}
    assert all(x == 0 for p, x in got.items() if p[0] >= 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_registered_search_has_a_semantic_signal(spark):
    found = registry.hybrid_search(spark, SF).toPandas()
    assert set(found[found.semantic > 0].query_id) >= {0, 1, 3, 4, 5, 6, 7, 8}  # no text holds a word of query 2


def test_registered_embedding_covers_all_documents(spark, tmp_path):
    rows = [(k, f"alpha{k % 30} beta{k % 30} gamma{k % 7} the and") for k in range(60)] + [(100, None), (101, ""), (102, "unseen"), (103, "the and of")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.id: r.vec for r in registry.svd_embed(spark, str(tmp_path)).collect()}
    assert set(got) == {k for k, _ in rows} and len(got[0]) > 16
    assert all(abs(math.hypot(*got[k]) - 1) < 1e-6 for k in range(60))
    assert not any(x for k in (100, 101, 102, 103) for x in got[k])


def test_vector_topk_in_blocks_equals_brute_force(spark):
    x = np.random.default_rng(1).integers(-3, 4, (90, 4)).astype(float)
    vecs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    got = {}
    for r in vectors.vector_topk(vecs.where("id % 3 = 0").withColumnRenamed("id", "query"), vecs, 5, query_block=7, row_block=20).collect():
        got.setdefault(r.query, []).append((r.rank, r.id, r.score))
    s = x @ x.T
    want = {q: [(n + 1, int(i), float(s[q, i])) for n, i in enumerate(np.lexsort((np.arange(90), -s[q]))[:5])] for q in range(0, 90, 3)}
    assert {q: sorted(v) for q, v in got.items()} == want
    assert vectors.vector_topk(vecs.where("false").withColumnRenamed("id", "query"), vecs).count() == 0


def test_csv_and_bronze(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Hospital_Name,state,Notes\n"A ""x"" clinic",Goa,"two\nlines"\n,,\nB,,\n')
    rows = tables.drop_empty_rows(tables.resolve_columns(tables.read_facilities(spark, str(path))))
    assert sorted((r.hospital_name, r.notes) for r in rows.collect()) == [('A "x" clinic', "two\nlines"), ("B", "")]
    r = tables.ingest_bronze(rows).where("hospital_name = 'B'").first()
    assert r.facility_id == "df7e70e5021544f4834bbee64a9e3789febc4be81470df629cad6ddb03320a5c" and r._ingest_ts is not None


def test_bm25_index_is_kept(spark, tmp_path):
    texts = {1: ["a", "b", "a"], 2: ["b"], 3: [], 4: ["c", "a"]}
    docs = spark.createDataFrame(list(texts.items()), "id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a", "a", "zz"]), (2, []), (3, ["c", "b"])], "query_id long, tokens array<string>")
    assert bm25.read_index(spark, str(tmp_path / "none")) is None
    index = bm25.write_index(docs, "id", str(tmp_path / "index"))
    found = [{(r["query"], r["id"]): round(r["score"], 9) for r in x.collect()} for x in (bm25.scores(asked, docs, "id"), bm25.scores(asked, None, "id", index=index), bm25.scores(asked, None, "id", index=bm25.read_index(spark, str(tmp_path / "index"))))]
    df = Counter(t for ts in texts.values() for t in set(ts))
    raw = {t: math.log(4 - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    mean = sum(map(len, texts.values())) / 4
    want = {}
    for q, ts in ((1, ["a", "a", "zz"]), (3, ["c", "b"])):
        for i, words in texts.items():
            if set(ts) & set(words):
                want[q, i] = round(sum(idf[t] * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t in ts if t in words), 9)
    assert found[0] == found[1] == found[2] == want


def test_hybrid_search_brute_force(spark):
    """Scaling, weights, ranks, candidates and explanations, from the signals themselves."""
    rows = [
        (1, "One", "Bihar", "Patna", "800001", 25.6, 85.1, 80, ["icu"], ["icu"], ["oxygen"], "icu oxygen"), (2, "Two", "Bihar", "", "", 25.7, 85.2, 40, [], ["icu", "trauma"], [], "icu icu ward"),
        (3, "Three", "Goa", "Panaji", "", None, None, 55, ["dentistry"], ["dentistry"], [], "dental"), (4, "Four", "Bihar", "Gaya", "", 10.0, 70.0, 80, [], [], [], "nothing here"),
    ]
    kinds = "hospital_id long, hospital_name string, state string, district string, pin_code string, lat double, lon double, trust_score int, specialty_tags array<string>, specialty_tags_full array<string>, equipment_tags_full array<string>, search_text string"
    fac = spark.createDataFrame(rows, kinds).withColumn("trust_breakdown", F.expr("array(named_struct('rule', hospital_name, 'delta', 1))"))
    pins = geo.centroids(spark.createDataFrame([("800001", "Bihar", "Patna", 25.61, 85.14)], "pin_code string, state string, district string, latitude double, longitude double"))
    asked = queries.parse_queries(spark.createDataFrame([(0, "urgent icu with oxygen near 800001"), (1, "dental care"), (2, "icu in bihar")], "query_id int, query string"))
    semantic = {(0, 1): 0.5, (0, 2): 0.1, (1, 3): 0.9, (2, 1): 0.3, (2, 2): 0.3, (2, 4): 0.3}
    got = search.hybrid_search(asked, fac, pins, semantic=spark.createDataFrame([(*k, v) for k, v in semantic.items()], "query_id int, hospital_id long, semantic double")).collect()
    kw = {(r["query"], r["id"]): r["score"] for r in bm25.scores(asked.select("query_id", text.tokens(F.col("raw_query")).alias("tokens")), fac.select("hospital_id", text.tokens(F.col("search_text")).alias("tokens")), "hospital_id").collect()}
    near = {0: [1, 2], 1: [1, 2, 3, 4], 2: [1, 2, 4]}  # by radius; all, since nothing names a place; by state
    scale = lambda xs: [(0.0 if max(xs) == 0 else 1.0) if max(xs) - min(xs) < 1e-9 else (x - min(xs)) / (max(xs) - min(xs)) for x in xs]
    for q, ids in near.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(ids) + 1)) and all(r.total_candidates == len(ids) for r in mine)
        s, k = scale([semantic.get((q, i), 0.0) for i in ids]), scale([kw.get((q, i), 0.0) for i in ids])
        want = {}
        for i, a, b in zip(ids, s, k):
            r = next(r for r in mine if r.hospital_id == i)
            weights = (0.1, 0.0, 0.2, 0.7) if q == 0 else (0.5, 0.2, 0.2, 0.1)
            want[i] = sum(w * x for w, x in zip(weights, (a, b, rows[i - 1][7] / 100, r.location)))
            assert abs(r.score - want[i]) < 1e-9 and abs(r.semantic - a) < 1e-9 and abs(r.keyword - b) < 1e-9 and r.hospital_name == rows[i - 1][1] == r.trust_breakdown[0].rule
        assert [r.hospital_id for r in mine] == sorted(ids, key=lambda i: (-want[i], i))
    best = next(r for r in got if r.query_id == 0 and r.hospital_id == 1)
    assert best.matched == ["icu", "oxygen"] and best.latitude == 25.6 and 0 < best.location < 1
    assert best.explanation == f"Matches ICU, Oxygen. in Patna, Bihar, {best.distance_km:.1f} km away. trust 80/100 (strong). ranked for urgency / proximity."
    by_name = {r.hospital_id: r for r in got if r.query_id == 2}
    assert by_name[1].location == 1.0 and by_name[1].distance_km is None and by_name[2].explanation == "Matches ICU. in Bihar. trust 40/100 (low - data gaps)."
    assert by_name[4].explanation == "Semantic match on free-text notes. in Gaya, Bihar. trust 80/100 (strong)."


def test_gold_takes_one_text_of_an_id(spark):
    silver = spark.createDataFrame([("f", '{"icu":{"present":"claimed"},"specialties_extracted":["icu","eye"],"raw_text_used":"long text"}'), ("g", "no json")], "facility_id string, extraction_json string")
    base = spark.createDataFrame([("f", "B", "d", "s", "1", "clinic", 10), ("f", "A", "d", "s", None, "clinic", 20), ("g", "C", "", "", "", "", 1)], "facility_id string, hospital_name string, district string, state string, pin_code string, facility_type string, text_length int")
    (r,) = extraction.assemble_gold(silver, base).collect()
    assert r.hospital_name == "A" and r.embedding_text == f"Facility: A. Location: d, s, PIN None. Type: clinic. Specialties: icu, eye. ICU: claimed. Emergency: unknown. Trust Score: {r.rule_trust}. long text"
    assert {f.evidence for f in r.flags if f.rule == "MISSING_CRITICAL_FIELDS"} == {"Only 2/6 core fields extracted"}


def test_tokens_and_sentences_by_hand(spark):
    df = spark.createDataFrame([("Éle an ICU-bed, the Ünit\u000b12! Bien sûr? Oui | nön",)], "t string")
    r = df.select(text.tokens(F.col("t")).alias("a"), text.sentences(F.col("t")).alias("b")).first()
    assert r.a == [w for w in re.sub(r"[^a-z0-9\s]", " ", "éle an icu-bed, the ünit\u000b12! bien sûr? oui | nön").split() if w not in vocab.STOPWORDS]
    assert r.b == ["Éle an ICU-bed, the Ünit\u000b12!", "Bien sûr?"]
