"""BM25 with block bounds and ranking without all pairs, against comparing all."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinicweave.functions import text
from clinicweave.operators import bm25, geo, queries, search, topk
from clinicweave.sources import tables


def plain_bm25(asked, docs, k):
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    out = {}
    for q, words in asked.items():
        rows = []
        for i, d in docs.items():
            if set(words) & set(d):
                c = Counter(d)
                rows.append((-round(sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in words if t in c), 6), i))
        out[q] = [(r, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("stored", [False, True])
def test_block_bounds_lose_nothing(spark, tmp_path, stored):
    rng = np.random.default_rng(0)
    words = np.array([f"w{k}" for k in range(400)] + ["common"])
    share = 1 / np.arange(1, 402)
    docs = {i: [str(w) for w in rng.choice(words, rng.integers(0, 40), p=share / share.sum())] + ["common"] * (i % 3 > 0) for i in range(400)}
    docs |= {400 + i: docs[7] for i in range(20)}
    asked = {0: docs[7], 1: ["w0", "w0", "w390"], 2: [], 3: ["zz"], 4: ["common"], 5: docs[30][:6] + ["common"]}
    table = spark.createDataFrame(list(docs.items()), "id long, tokens array<string>")
    ask = spark.createDataFrame(list(asked.items()), "query_id long, tokens array<string>")
    index = bm25.write_index(table, "id", str(tmp_path / "index")) if stored else None
    found, told = bm25.best(ask, None if stored else table, "id", 5, index=index, block=8, first=2)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["score"]))
    assert {q: [(r, i, pytest.approx(s, abs=2e-6)) for r, i, s in v] for q, v in plain_bm25(asked, docs, 5).items()} == {q: sorted(v) for q, v in got.items()}
    kinds = {r.kind: r["count"] for r in told.groupBy("kind").count().collect()}
    assert kinds["skipped"] > 0 and kinds["first"] == 2 * 4


KINDS = "hospital_id long, hospital_name string, state string, district string, pin_code string, lat double, lon double, trust_score int, specialty_tags array<string>, specialty_tags_full array<string>, equipment_tags_full array<string>, search_text string"


def test_queries_without_a_hit_are_ranked_without_all_pairs(spark):
    """Equal to ranking every facility, with negative signals, ties, places that only some have, and a radius of nothing."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        lat, lon = (25.6 + float(rng.normal()) * 3, 85.1 + float(rng.normal()) * 3) if i % 4 else (None, None)
        rows.append((i, f"N{i}", ["Bihar", "Goa", "Sikkim place", ""][i % 4], ["Kerala", "sikkim", "", "Patna"][i % 7 % 4], "", lat, lon, int(rng.integers(0, 5)) * 20, [], [], [], ["icu oxygen", "dental", "nothing", "heart"][i % 11 % 4]))
    fac = spark.createDataFrame(rows, KINDS).withColumn("trust_breakdown", F.array().cast("array<struct<rule:string,delta:int>>"))
    pins = geo.centroids(spark.createDataFrame([("800001", "Bihar", "Patna", 25.61, 85.14), ("600001", "Tamil Nadu", "Chennai", -60.0, 0.0)], "pin_code string, state string, district string, latitude double, longitude double"))
    asked = ["icu care", "zz", "", "dental in kerala", "heart in sikkim", "urgent icu 600001 within 10 km", "oxygen 800001 within 0 km", "icu in ladakh near 800001 within 200 km", "dental near 800001 within 0 km in kerala"]
    q = queries.parse_queries(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"))
    semantic = [(i, int(f), float(s)) for i in range(len(asked)) for f, s in zip(rng.choice(300, 15, replace=False), rng.normal(size=15) * 0.3)]
    signal = spark.createDataFrame(semantic, "query_id int, hospital_id long, semantic double")
    k = 6
    got = search.hybrid_search(q, fac, pins, k, semantic=signal, deep=15).collect()

    places = geo.pin_coords(q, pins, "pin", "_at").withColumns({"q_lat": F.col("_at.lat"), "q_lon": F.col("_at.lon")})
    hits = {}
    for r in search.candidates_found(places, fac).collect():
        hits.setdefault(r.query_id, set()).add(r.hospital_id)
    kw = {(r["query"], r["id"]): r["score"] for r in bm25.scores(q.select("query_id", text.tokens(F.col("raw_query")).alias("tokens")), fac.select("hospital_id", text.tokens(F.col("search_text")).alias("tokens")), "hospital_id").collect()}
    near = {(r.query_id, r.hospital_id): r.s for r in places.withColumnRenamed("state", "q_state").drop("specialties").crossJoin(fac).select("query_id", "hospital_id", geo.location_score()["score"].alias("s")).collect()}
    sem, urgent = {(a, b): s for a, b, s in semantic}, {r.query_id: r.sort == "distance" for r in q.collect()}
    scale = lambda xs: [(0.0 if max(xs) == 0 else 1.0) if max(xs) - min(xs) < 1e-9 else (x - min(xs)) / (max(xs) - min(xs)) for x in xs]
    assert len(hits) < len(asked) - 4
    for i in range(len(asked)):
        ids = sorted(hits.get(i, range(300)))
        a, b = scale([sem.get((i, f), 0.0) for f in ids]), scale([kw.get((i, f), 0.0) for f in ids])
        w = (0.1, 0.0, 0.2, 0.7) if urgent[i] else (0.5, 0.2, 0.2, 0.1)
        want = sorted((-round(w[0] * x + w[1] * y + w[2] * rows[f][7] / 100 + w[3] * near[i, f], 9), f) for f, x, y in zip(ids, a, b))[:k]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [(r.hospital_id, pytest.approx(r.score, abs=1e-8)) for r in mine] == [(f, -s) for s, f in want], asked[i]
        assert all(r.total_candidates == len(ids) for r in mine)


def test_contenders_are_few(spark):
    fac = spark.range(5000).selectExpr("id as hospital_id", "'' as state", "'' as district", "cast(null as double) lat", "cast(null as double) lon", "cast(id % 50 as int) trust_score")
    rest = spark.createDataFrame([(1, None, None, None, None, "relevance")], "query_id int, state string, q_lat double, q_lon double, radius_km double, sort string")
    none = spark.createDataFrame([], "query_id int, hospital_id long, keyword double")
    assert search.contenders(rest, fac, none, none, 10, 200).count() == 210


def test_ids_of_many_partitions(spark):
    df = spark.createDataFrame([(x % 7, x) for x in range(100)], "part int, at int").repartition(9)
    got = tables.assign_ids(df, ["part", "at"], "k")
    assert got.columns == ["part", "at", "k"] and "Python" not in got._jdf.queryExecution().toString()
    assert [(r.part, r.at) for r in got.orderBy("k").collect()] == sorted((x % 7, x) for x in range(100)) and [r.k for r in got.orderBy("k").collect()] == list(range(100))
    assert tables.assign_ids(df.where("false"), ["part"]).count() == 0
    with_gaps = spark.range(0, 40, 1, 8).where("id < 5 or id > 30").selectExpr("id as v")
    assert [r.i for r in tables.assign_ids(with_gaps, ["v"], "i").orderBy("v").collect()] == list(range(14))


def test_candidate_pairs_are_not_stored(spark, monkeypatch):
    """All pairs of repeated queries, with places, radii and states, equal brute force; staged tables stay as short as the input."""
    places = [(25.6, 85.1), (25.7, 85.3), (13.0, 80.2), (None, None)]
    fac = spark.createDataFrame([(i, ["Bihar", "Goa", ""][i % 3], ["Sikkim", ""][i % 2], *places[i % 4]) for i in range(60)], "hospital_id long, state string, district string, lat double, lon double")
    kinds = [("Bihar", None, None, None), ("Bihar", 25.61, 85.14, 30.0), (None, 25.61, 85.14, 10.0), ("Sikkim", None, None, None), (None, 25.61, 85.14, 0.0), (None, 60.0, 0.0, 5.0), ("Goa", 25.61, 85.14, None)]
    q = spark.createDataFrame([(i, *kinds[i % 7]) for i in range(70)], "query_id long, state string, q_lat double, q_lon double, radius_km double")
    rows, kept = [], tables.stage

    def stage(df, label):
        out = kept(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(tables, "stage", stage)
    got = search.filter_candidates(q, fac, 6)
    assert max(rows) <= 70
    found = {(r.query_id, r.hospital_id): (r.distance_km, r.location) for r in got.collect()}
    want = {}
    for r in q.withColumnRenamed("state", "q_state").crossJoin(fac).withColumn("at", geo.location_score()).withColumns({"want": text.normal_state(F.col("q_state")), "have": text.normal_state(F.col("state"))}).collect():
        here = r["at"].km is not None and r["at"].km <= r.radius_km and r.want in (None, r.have) if r.q_lat is not None and (r.radius_km or 0) > 0 else r.want is not None and r.want == r.have
        want.setdefault(r.query_id, []).append((r.hospital_id, here, r["at"]))
    want = {(i, h): at for i, pairs in want.items() for h, here, at in pairs if here or not any(p[1] for p in pairs)}
    assert got.count() == len(found) and found.keys() == want.keys()
    assert all(found[k] == (pytest.approx(at.km, abs=1e-6) if at.km is not None else None, pytest.approx(at.score, abs=1e-6)) for k, at in want.items())


def test_repeated_queries_in_bounded_runs(spark):
    """Equal queries are answered once for all who ask, and runs over few pairs give what one run gives."""
    fac = spark.createDataFrame([(i, f"N{i}", ["Bihar", "Goa"][i % 2], "", "", 25.6, 85.1 + i / 100, i % 5 * 20, [], [], [], ["icu oxygen", "dental", "heart"][i % 3]) for i in range(40)], KINDS).withColumn("trust_breakdown", F.array().cast("array<struct<rule:string,delta:int>>"))
    pins = geo.centroids(spark.createDataFrame([("800001", "Bihar", "Patna", 25.61, 85.14)], "pin_code string, state string, district string, latitude double, longitude double"))
    asked = ["icu in bihar", "dental", "urgent heart 800001 within 10 km"]
    q = queries.parse_queries(spark.createDataFrame([(i, asked[i % 3]) for i in range(12)], "query_id int, query string"))
    met = []

    def answer(some):
        met.append(some.count())
        return search.hybrid_search(some, fac, pins, 4, at_once=40)

    shown = lambda df: sorted((r.query_id, r["rank"], r.hospital_id, round(r.score, 9), r.total_candidates, r.explanation) for r in df.collect())
    assert shown(search.once(q, answer)) == shown(search.hybrid_search(q, fac, pins, 4)) and met == [3]


def test_scan_equals_search(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (600, 8)).astype(float)  # many ties
    vecs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], "id long, vec array<double>").repartition(5)
    asked = vecs.where("id % 40 = 0").withColumnRenamed("id", "query")
    shown = lambda df: sorted((r["query"], r["rank"], r["id"], r.score) for r in df.collect())
    assert shown(topk.scan(asked, vecs, 9)) == shown(topk.search(asked, vecs, 9, 10, 50)[0])
    assert topk.scan(asked.where("false"), vecs, 9).count() == 0
