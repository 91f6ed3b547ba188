"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinicweave.llm import ann, bpe, langid, line_dedup, media, ngram_join, packing, quality, toxicity, warc
from clinicweave.llm.lexicon import FEATURES, Lexicon, plain

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  \t\n", "one", "Two words", "a b c d e f g h i j k l", "a b c d e f g h i j k l", "long " * 5000, "é漢字😀 <|endoftext|> It's"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, 0.5, "x") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, score double, __doc string").withColumns({c: F.lit(1) for c in ("x", "p", "fit", "row", "n", "h", "a.b")}).cache()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_media_round_trip(spark, docs):
    got = media.probe(media.to_media(docs)).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert r.duration == len(raw) / 8000 and r.codec == "raw "
        assert sum(x.length for x in r.keyframes) <= len(raw)
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(b"\0\0\0\x09moov\1"))], "doc_id long, media binary")
    assert [r.codec for r in media.probe(bad).collect()] == [None, None, None]
    assert media.probe(media.to_media(docs.where("false"))).count() == 0


def test_media_walks_nested_boxes():
    data = media.to_iso(bytes(range(256)) * 400)
    paths = [p for p, _, _ in media.boxes(memoryview(data))]
    assert "/moov/trak/mdia/minf/stbl/stss" in paths and "/mdat" in paths
    found = media.tables(memoryview(data))[0]
    assert media.payload(memoryview(data), found) == bytes(range(256)) * 400
    assert found["ticks"] == found["duration"] == 102400


def test_bpe_equals_library(docs, tokenizer):
    for r in bpe.round_trip(docs, PATH).collect():
        ids = tokenizer.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert r.n_tokens == len(ids)
    assert bpe.round_trip(docs.where("false"), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abAB é'sſΣσİßñ.,!<|>12\t\n\x1c\x85　漢😀endoftx", max_size=40))
def test_bpe_fuzz(text):
    from tokenizers import Tokenizer

    t = _ONCE["lib"] = _ONCE.get("lib") or Tokenizer.from_file(PATH)
    own = _ONCE["own"] = _ONCE.get("own") or bpe.Bpe(PATH)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


_ONCE: dict = {}


def test_bpe_keeps_the_words_of_a_run(tokenizer, monkeypatch):
    """A full cache forgets only words that the run at hand lacks, and none of the run is encoded twice."""
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)]
    runs = [[" ".join(words[:40])], [" ".join(words[20:60]), words[25] + ", É" + words[26]], [" ".join(words[50:90])], [" ".join(words)]]
    own, learnt = bpe.Bpe(PATH, keep=50), []
    plain = own._learn
    monkeypatch.setattr(own, "_learn", lambda chunks: (learnt.append(set(chunks)), plain(chunks))[1])
    for run in runs:
        own.learn(run)
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(run)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in run]
    assert [len(x) for x in learnt[:3]] == [40, 22, 30] and learnt[1] == {*words[40:60], words[25] + ",", "É" + words[26]}
    assert [x for x in learnt[3:] if x] == [set(words[:50])]


def test_bpe_work_of_a_run(tokenizer, monkeypatch):
    """Plain texts are split once, not in Python, and their short words never meet the index of pairs; all ids are the library's (finding F1)."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("etaoinshrdlucmfgéñbaa", k=rng.randint(1, 16))) for _ in range(5000)} | {"a" * k for k in range(1, 70)} | {"é" * 24, "é" * 25, "漢字"})
    ids = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    own, split, linked = bpe.Bpe(PATH), [], []
    plain, index = own._parts, getattr(own, "_linked", own.merge)
    monkeypatch.setattr(own, "_parts", lambda text: (split.append(text), plain(text))[1])
    monkeypatch.setattr(own, "_linked", lambda some: (linked.extend(some), index(some))[1], raising=False)
    pushed, push = [], bpe.heapq.heappush
    monkeypatch.setattr(bpe.heapq, "heappush", lambda heap, x: (pushed.append(x), push(heap, x))[1])
    short = [w for w in words if len(w.encode()) <= 48]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(short)] == [x for w, x in zip(words, ids) if len(w.encode()) <= 48]
    assert (split, linked, pushed) == ([], [], [])
    assert [np.frombuffer(x, "<u4").tolist() for x in own.merge([w.encode() for w in words])] == ids
    assert sorted(linked) == sorted(w.encode() for w in words if len(w.encode()) > 48) and own.merge([]) == []
    assert [np.frombuffer(x, "<u4").tolist() for x in index([w.encode() for w in words])] == ids


def test_bpe_runs_of_arrays(tokenizer):
    """Nulls, blanks, odd separators and added tokens keep their places among plain texts, in every array of a run."""
    texts = ["Plain, words. And MORE!", None, "", " \t ", "a\x1cb c\x1f", "x<|endoftext|>y <|startoftext|>", "don't 12 a,, é.", "<|end", "É! ﬁ1. ΣΑΣ, ΣΑΣ", " led by\u2003blanks ", "w" * 60, "İ. ½, 'tis' it's;"]
    for keep in (500_000, 3):
        own = bpe.Bpe(PATH, keep=keep)
        arrays = [pa.array(texts), pa.array([], pa.string()), pa.array(texts[::-1], pa.large_string()).cast(pa.string()), pa.array([None], pa.string()), pa.array(["zz", *texts]).slice(1)]
        got = [x for _, some in own.encoded(arrays, rows=5) for x in some]
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in [*texts, *texts[::-1], None, *texts]]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert own.encode([]) == []


def test_packing(docs):
    rows = packing.pack(docs, PATH, window=64).collect()
    by, at = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        at.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64
    assert set(at) == set(range(len(TEXTS))) and at[0] == [(0, 1, 1)]
    assert sum(n for _, n, _ in at[7]) == at[7][0][2]
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_best_fit_equals_plain_search():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        used, want = [], []
        for s in sorted(sizes, reverse=True):
            fits = [w for w in range(len(used)) if used[w] + s <= 40]
            w = max(fits, key=lambda w: used[w]) if fits else len(used)
            used += [0] * (w == len(used))
            used[w] += s
        got = packing.best_fit(sizes, 40)
        full = Counter()
        for (w, _), s in zip(got, sizes):
            full[w] += s
        assert sorted(full.values()) == sorted(used) and all(v <= 40 for v in full.values())
        assert want == []


def _kept_lines(rows):
    """What is left of (id, text) rows: the rule of line_dedup, over all pairs of lines."""
    order = lambda i, t: (i is not None, i or 0, t)
    first: dict[str, tuple] = {}
    for i, t in sorted(rows, key=lambda r: order(r[0], r[1] or "")):
        for k, line in enumerate((t or "").split("\n")):
            first.setdefault(line.strip(" \t\r"), (order(i, t or ""), k))
    out = []
    for i, t in rows:
        kept = []
        for k, line in enumerate((t or "").split("\n")):
            x = line.strip(" \t\r")
            here = (order(i, t or ""), k)
            earlier = first[x] < here or len(x) >= 16 and any(f < first[x] and line_dedup.within_one(x, y) for y, f in first.items() if y != x and len(y) >= 16)
            if not x or not earlier:
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(n)).strip().ljust(n - 4, "z") for n in [24, 20, 33, 19, 47, 16] * 2]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            if rng.random() < 0.6:
                p = rng.randrange(len(line))
                kind = rng.randrange(3)
                line[p : p + (kind != 1)] = [] if kind == 0 else ["q"]
            lines.append("".join(line))
        texts.append("\n".join(lines))
    rows = [*enumerate(texts), (100, None), (101, ""), (102, "short\nshort\n\n\nshor"), (103, "x" * 30_000 + "\n" + "x" * 29_999 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_lines", "doc", "th", "gone", "gone_doc", "a.b")})
    found = line_dedup.dedup_lines(docs)
    assert found.columns == docs.columns and sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == _kept_lines(rows)
    counts = line_dedup.dedup_lines(docs, counts=True).where("doc_id = 100").first()
    assert (counts.n_lines, counts.n_removed) == (0, 0)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_line_dedup_repeated_and_missing_ids(spark):
    x, near = "a line that comes again", "a line that comes agein"
    rows = [(5, f"{x}\nb\nc\nunique to the first row"), (5, f"d\ne\nf\n{x}"), (None, near), (7, near), (7, near), (None, f"{near}\nalone"), (None, None)]
    by_hash = {t: h for t, h in spark.createDataFrame([(t,) for _, t in rows if t], "t string").select("t", F.xxhash64("t")).distinct().collect()}
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    first = min((near, f"{near}\nalone"), key=by_hash.get)
    want = [(5, "b\nc\nunique to the first row"), (5, "d\ne\nf"), (7, ""), (7, ""), (None, near if first == near else ""), (None, "alone" if first == near else f"{near}\nalone"), (None, None)]
    assert got == sorted(want, key=repr)


@given(st.text(alphabet="abé", max_size=7), st.text(alphabet="abé", max_size=7))
def test_within_one_equals_levenshtein(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    assert line_dedup.within_one(a, b) == (d[-1] <= 1)


def _components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                home[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_brute_force(spark, docs):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows, base = [], []
    for k in range(160):
        if base and rng.random() < 0.75:
            t = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
        else:
            t = [rng.choice(words) for _ in range(rng.choice([8, 12, 40, 90]))]
            base.append(t)
        rows.append((k, " ".join(t)))
    rows += [(900 + k, t) for k, t in enumerate(TEXTS)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block=700).collect()}
    assert got == _components(rows)
    again = ngram_join.jaccard_components(docs).collect()
    assert len(again) == len(TEXTS) + 1 and {r.component_id for r in again if r.doc_id in (5, 6)} == {5}
    assert ngram_join.jaccard_components(docs.where("false")).count() == 0


@given(st.lists(st.lists(st.integers(0, 25), unique=True).map(sorted), max_size=8), st.integers(1, 6))
def test_divide_skip(lists, need):
    counts = Counter(x for y in lists for x in y)
    assert ngram_join.divide_skip(lists, need) == sorted((k, v) for k, v in counts.items() if v >= need)


def test_jaccard_common_passage_long_texts_and_ids(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage, long = [word() for _ in range(50)], [word() for _ in range(20_000)]
    rows = [(k, " ".join([*(word() for _ in range(rng.randint(5, 60))), *passage, *(word() for _ in range(5))])) for k in range(80)]
    rows += [(200, " ".join(long)), (201, " ".join(long[:500] + [word() for _ in range(200)] + long[700:])), (202, " ".join(long[:15_000] + [word() for _ in range(5_000)]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block=3000).collect()}
    assert got == _components(rows) and got[201][1] == 200 and got[202][1] == 202
    twice = [(1, rows[0][1]), (1, rows[1][1]), (2, rows[0][1]), (2, rows[0][1]), (None, rows[1][1]), (None, rows[2][1]), (3, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.jaccard_components(spark.createDataFrame(twice, "doc_id long, text string")).collect())
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (2, 1), (3, 3)]


def test_links_come_by_each_way(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(100_000)}" for _ in range(120)]
    rows = []
    for k in range(300):  # a chain: each text is like its neighbours only
        base = [*base[3:], *(f"w{rng.randrange(100_000)}" for _ in range(3))]
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, block=2000).collect()}
    assert got == {k: v for k, (_, v) in _components(rows).items()} and set(got.values()) == {0}


def test_warc(spark):
    big = "<p>é" + "x" * 2000
    pages = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""), (None, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert (got[2].record_type, got[2].html) == ("response", big) and (got[1].record_type, got[1].refers_to) == ("revisit", 2) and got[None].refers_to == 2
    assert all(got[k].record_type == "response" and got[k].refers_to is None for k in (3, 4, 5, 6))
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert warc.read_archives(warc.write_archives(df.where("false"))).count() == 0


def test_warc_dictionary_frame():
    rng = random.Random(0)
    recs = [("<html><body>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.random()) for _ in range(200))).encode() for _ in range(200)]
    data = warc.archive(recs)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.records(data)) == recs


@pytest.mark.parametrize("count", [1, 2, 15, 40])
def test_warc_dictionary_of_few_records(count):
    recs = [warc.record(k, "http://a/", f"<html><body>page {k} {'x' * k}</body></html>".encode(), "00" * 20, None) for k in range(count)] + [b""] * (count == 2)
    data = warc.archive(recs)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and struct.unpack_from("<I", data, 4)[0] > 0 and list(warc.records(data)) == recs


def test_warc_many_payloads_are_joined_in_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"u{k}", "y" * 1500 + str(k % 3)) for k in range(60)] + [(None, "u", "y" * 1500 + "0")], "page_id long, url string, html string")
    want = sorted(map(repr, warc.read_archives(warc.write_archives(pages)).drop("html").collect()))
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, warc.read_archives(warc.write_archives(pages)).drop("html").collect())) == want


def test_ann_recall_where_few_are_ranked_exactly(spark):
    """20,000 rows in one block, 400 of them ranked exactly; neither cores nor the order of rows matter."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 20_000)] + 0.5 * rng.normal(size=(20_000, 24))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    found = ann.search(df.repartition(5), every=200, rerank=400, block=32_768).collect()
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 200):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 100
    again = ann.search(df.orderBy(F.desc("vec_id")).coalesce(1), every=200, rerank=400, block=32_768).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 10)).astype(np.float32)
    x[100:160] = 9 * x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 10), (1040, [float("nan")] * 10), (1060, [1.0, None] + [0.0] * 8), (1080, [1.0, 2.0]), (1100, [float("inf")] * 10)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = {}
    for r in ann.search(df, rerank=100, block=128, group=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20].tolist()
        hits += len(set(want) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
    assert hits >= 0.9 * 20 * len(got)
    assert [v for _, v, _ in sorted(got[100])] == list(range(101, 121))  # ties go to smaller ids
    few = ann.search(df.where("vec_id < 5")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.search(df.where("false")).count() == 0


def test_language(spark, docs):
    rng = random.Random(2)
    parts = {"en": ["the ", "and ", "ing ", "tion "], "fr": ["le ", "eaux ", "ment ", "que "], "de": ["der ", "und ", "ung ", "lich "]}
    rows = [(k, "".join(rng.choice(parts[lang]) for _ in range(60)), lang) for k, lang in enumerate(list(parts) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(df.where("doc_id < 90"))
    got = {r.doc_id: r for r in langid.identify(df.where("doc_id >= 90"), models).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows if k >= 90)
    odd = {r.doc_id: r for r in langid.identify(docs, models).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[3].lang_pred in parts
    none = langid.train(df.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    for n, k in enumerate(models.keys):  # each context's probabilities stay below one
        assert len(k) == len(models.logp[n]) and (np.exp(models.logp[n]) <= 1).all()


def _labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(240):
        toxic, bad = k % 4 == 0, k % 3 == 0
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(30)]
        if toxic:
            words[3] = words[9] = "idiot"
        rows.append((k, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((k, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_training_stays_finite():
    # one word holds most of a text of many different words, and its copies disagree on the label
    texts = [f"{'spam ' * 4000}{' '.join(f'w{i}' for i in range(1500))}", f"{'spam ' * 3000}{' '.join(f'v{i}' for i in range(1500))}", "ab"] * 20
    labels = np.array([0, 1, 1] * 20)
    labels[::5] = 1 - labels[::5]
    docs = []
    for t in texts:
        found, counts = np.unique(quality.buckets(t.encode()), return_counts=True)
        docs.append((found, (counts / counts.sum()).astype(np.float32)))
    model = quality.Classifier().fit(docs, labels)
    assert np.isfinite(model.weights).all() and 0 <= model.score(texts[0]) < model.score(texts[2]) <= 1


def test_quality(spark, docs):
    texts, labels = _labelled(spark)
    model = quality.train(texts, labels.where("doc_id < 180"))
    got = {r.doc_id: r.score for r in quality.score(texts, model).collect()}
    assert all((got[k] >= 0.5) == (k % 3 != 0) for k in range(180, 240))
    kept = quality.with_score(docs, model)
    assert set(kept.columns) == set(docs.columns) and kept.where("score between 0 and 1").count() == len(TEXTS) + 1
    assert quality.train(texts, labels.where("false")).score("x") == 0.5
    assert quality.train(texts, labels.where("quality = 1")).score("x") == 1.0


def test_toxicity(spark, docs):
    texts, labels = _labelled(spark)
    model = toxicity.train(texts, labels.where("doc_id < 180"), trees=5)
    got = {r.doc_id: r.score for r in toxicity.score(texts, model).collect()}
    assert all((got[k] >= 0.7) == (k % 4 == 0) for k in range(180, 240))
    kept = toxicity.with_score(docs, model)
    assert set(kept.columns) == set(docs.columns) and kept.where("score between 0 and 1").count() == len(TEXTS) + 1
    assert toxicity.score(docs, toxicity.train(texts, labels.where("false"))).where("score = 0").count() == len(TEXTS) + 1


def test_obfuscated_words():
    assert plain("id1ot") == "idiot" and plain("idiiiiot") == "idiiot"


@pytest.mark.parametrize("n", [0, 1, 64, 65, 4096, 4097, 40000])
def test_iso_sizes(n):
    payload = media.padded(b"a" * n)
    data = memoryview(media.to_iso(payload))
    assert media.payload(data, media.tables(data)[0]) == payload and len(payload) % 64 == 0 and len(payload) > 0




def test_line_dedup_near_copy_of_a_row_without_id(spark):
    rows = [(None, "the quick brown fox jumps"), (1, "the quick brown fox jumpz"), (2, "another line that is kept")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: "the quick brown fox jumps", 1: "", 2: "another line that is kept"}


def test_warc_checks_payloads():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    f = warc.parse(good)
    assert (f["size"], f["sha1"]) == (7, hashlib.sha1(b"payload").hexdigest())
    for bad in (good.replace(b"\r\n\r\npayload", b"\r\n\r\npaylOad"), warc.record(1, "u", b"payload", hashlib.sha1(b"other").hexdigest(), None)):
        with pytest.raises(ValueError):
            warc.parse(bad)


def _plain_kneser_ney(rows, order, discount, text):
    """Bits a character of `text` under each language, from dictionaries of strings."""
    out = {}
    texts = {lang: [" " + "".join(chr(x) for x in langid.clean(t)) for t, x in rows if x == lang] for _, lang in rows}
    every = {n: {t[i : i + n] for some in texts.values() for t in some for i in range(len(t) - n + 1)} for n in range(1, order + 1)}
    for lang, some in texts.items():
        own = {n: Counter(t[i : i + n] for t in some for i in range(len(t) - n + 1)) for n in range(1, order + 1)}
        before = {n: Counter(g[1:] for g in own[n + 1]) for n in range(1, order)}
        seen = {n: {g: (c if n == order else before[n].get(g, 1)) for g, c in own[n].items()} for n in own}
        total = {n: Counter() for n in own}
        kinds = {n: Counter() for n in own}
        for n in own:
            for g, c in seen[n].items():
                total[n][g[:-1]] += c
                kinds[n][g[:-1]] += 1
        left = lambda ctx: discount * kinds[len(ctx) + 1][ctx] / total[len(ctx) + 1][ctx] if ctx in kinds[len(ctx) + 1] else 1.0  # noqa: E731, B023

        def p(g):
            n = len(g)
            if g in own[n]:  # noqa: B023
                return max(seen[n][g] - discount, 0) / total[n][g[:-1]] + left(g[:-1]) * (p(g[1:]) if n > 1 else 1 / 1000)  # noqa: B023
            return left(g[:-1]) * p(g[1:]) if n > 1 else 1e-6  # noqa: B023

        c = " " + "".join(chr(x) for x in langid.clean(text))
        out[lang] = -sum(np.log2(p(c[max(0, i - order + 1) : i + 1])) for i in range(1, len(c))) / max(1, len(c) - 1)
    assert every
    return out


def test_language_equals_plain_kneser_ney(spark):
    rng = random.Random(21)
    parts = {"en": ["the ", "and ", "ing ", "tion "], "fr": ["le ", "eaux ", "ment ", "que "], "de": ["der ", "und ", "ung ", "lich "]}
    rows = [("".join(rng.choice(parts[lang]) for _ in range(rng.randint(0, 30))), lang) for lang in list(parts) * 12] + [("a", "en"), ("é", "fr"), ("", "de")]
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    models = langid.train(df, held_per_lang=0)
    asked = ["de", "un", "la", "el", "es", "a", "i", "que", "in", "the und eaux", "zzz", "Ünd, 12 the!", "x" * 50, "tion ment " * 30]
    alone = [models.entropies([t])[0] for t in asked]
    for t, h in zip(asked, alone):
        want = _plain_kneser_ney(rows, 4, 0.75, t)
        assert np.allclose(h, [want[x] for x in models.langs], atol=1e-5), t
    assert np.array_equal(np.array(alone), models.entropies(asked)) and np.array_equal(np.array(alone)[::-1], models.entropies(asked[::-1]))
    again = langid.train(df.repartition(7).orderBy(F.desc("doc_id")), held_per_lang=0)
    assert all(np.array_equal(a, b) for a, b in zip([*models.keys, *models.logp, *models.back], [*again.keys, *again.logp, *again.back]))


def test_language_long_texts_are_cut_at_no_cost(monkeypatch):
    c = "the quick brown fox, then another one " * 40
    whole = sorted((k, g, n) for k, part in langid.counted([c, "a", "", c], 4) for g, _, _, n in zip(*part) if k == 4)
    monkeypatch.setattr(langid.pieces, "__defaults__", (50,))
    cut = Counter()
    for k, part in langid.counted([c, "a", "", c], 4):
        for g, _, _, n in zip(*part):
            cut[k, g] += n
    assert sorted((k, g, n) for (k, g), n in cut.items() if k == 4) == whole


def test_language_short_and_odd_texts(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("a", "en"), ("b", "fr"), ("", "en"), ("!", "fr"), (None, "fr"), ("c", None)])]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert models.langs == ["en", "fr"] and models.predict(["a", "b", "?"])[0] == ["en", "fr", "und"]
    assert langid.train(spark.createDataFrame([(1, "?!", "en")], "doc_id long, text string, lang string")).langs in ([], ["en"])
    with pytest.raises(ValueError, match="lower the order"):
        langid.train(spark.createDataFrame([(k, "ab", "en") for k in range(20)], "doc_id long, text string, lang string"), most_bytes=10)


def _track(kind, sizes, keys, chunks, at, codec=b"raw ", wide=False):
    """A trak box: samples of `sizes`, in chunks of the given numbers of samples that begin at `at`."""
    per = np.array([[k + 1, c, 1] for k, c in enumerate(chunks)])
    offsets = media._full(b"co64", len(at).to_bytes(4, "big"), np.array(at, ">u8").tobytes()) if wide else media._table(b"stco", np.array(at))
    stbl = media._box(
        b"stbl", media._full(b"stsd", b"\0\0\0\1", media._box(codec, bytes(28))), media._table(b"stts", np.array([[len(sizes), 1]])), media._table(b"stsc", per),
        media._full(b"stsz", b"\0\0\0\0", len(sizes).to_bytes(4, "big"), np.array(sizes, ">u4").tobytes()), offsets, *([media._table(b"stss", np.array(keys))] if keys else []),
    )
    mdhd = media._full(b"mdhd", bytes(8), (0 if kind == b"none" else 10).to_bytes(4, "big"), len(sizes).to_bytes(4, "big"), bytes(4))
    return media._box(b"trak", media._box(b"mdia", mdhd, media._full(b"hdlr", bytes(4), kind, bytes(12)), media._box(b"minf", stbl)))


def test_media_tracks_are_kept_apart(spark):
    body = bytes(range(200))
    head = media._box(b"ftyp", b"isom")
    mdat = b"\0\0\0\1mdat" + (16 + len(body)).to_bytes(8, "big") + body  # a size of 64 bits
    at = len(head) + 16
    sound = _track(b"soun", [20, 20], [], [2], [at + 100])
    pictures = _track(b"vide", [10, 20, 30, 40], [1, 3, 4], [1, 2, 1], [at, at + 10, at + 60], b"avc1", wide=True)
    file = head + mdat + media._box(b"moov", sound, pictures)
    r = media.probe(spark.createDataFrame([(1, bytearray(file))], "doc_id long, media binary")).first()
    assert r.codec == "avc1" and r.duration == 0.4 and [(x.offset - at, x.length) for x in r.keyframes] == [(0, 10), (30, 30), (60, 40)]
    assert r.payload_sha256 == hashlib.sha256(body[:100]).hexdigest()
    assert [(t.kind, t.codec, len(t.keyframes)) for t in r.other_tracks] == [("soun", "raw ", 2)]
    good = _track(b"none", [1], [], [1], [at])
    bad = [
        good.replace(b"stsz\0\0\0\0\0\0\0\0\0\0\0\1", b"stsz\0\0\0\0\0\0\0\1\x7f\0\0\0"), _track(b"soun", [1], [7], [1], [at]), _track(b"soun", [1], [], [9], [at]),
        _track(b"soun", [999], [], [1], [at]), _track(b"soun", [1, 1], [], [1], [at]), good.replace(b"stsd", b"free"),
    ]
    rows = [(k, bytearray(head + mdat + media._box(b"moov", t))) for k, t in enumerate([good, *bad, b""])]
    got = {r.doc_id: r for r in media.probe(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[0].codec == "raw " and got[0].duration is None  # no time scale
    assert all(got[k].codec is None and got[k].media_bytes > 0 for k in range(1, len(rows)))


def test_media_in_fragments_and_compact_sizes(spark):
    """Samples of fragments follow those of the header: defaults, own values, offsets and flags from each place they may stand in."""
    box, full = media._box, media._full
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    flagged = lambda kind, flags, *body: box(kind, u32(flags), *body)
    body = bytes(range(120))
    ftyp = box(b"ftyp", b"isom")
    stbl = box(b"stbl", full(b"stsd", u32(1), box(b"avc1", bytes(8))), full(b"stts", u32(0)), full(b"stsc", u32(0)), full(b"stsz", u32(0, 0)), full(b"stco", u32(0)))
    trak = box(b"trak", full(b"tkhd", u32(0, 0, 9, 0, 0)), box(b"mdia", full(b"mdhd", u32(0, 0, 100, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12)), box(b"minf", stbl)))
    moov = box(b"moov", trak, box(b"mvex", full(b"trex", u32(9, 1, 10, 5, 0x10000))))

    def fragment(offset):
        one = box(b"traf", flagged(b"tfhd", 0x20000, u32(9)), flagged(b"trun", 0x1 | 0x4, u32(3), struct.pack(">i", offset), u32(0)), flagged(b"trun", 0x100 | 0x200 | 0x400, u32(2), u32(20, 7, 0x10000, 30, 9, 0)))
        other = box(b"traf", flagged(b"tfhd", 0x20000, u32(4)), flagged(b"trun", 0x1, u32(1), struct.pack(">i", 0)))
        two = box(b"traf", flagged(b"tfhd", 0x20000 | 0x8 | 0x10 | 0x20, u32(9, 40, 11, 0)), flagged(b"trun", 0x1 | 0x800, u32(2), struct.pack(">i", offset + 50), u32(0, 0)))
        return box(b"moof", full(b"mfhd", u32(1)), one, other, two)

    moof = fragment(len(fragment(0)) + 8)
    file = ftyp + moov + moof + box(b"mdat", body)
    at = len(ftyp + moov + moof) + 8
    r = media.probe(spark.createDataFrame([(1, bytearray(file)), (2, bytearray(ftyp + moov + moof + box(b"mdat", body[:40])))], "doc_id long, media binary"))
    good, bad = sorted(r.collect(), key=lambda r: r.doc_id)
    assert good.codec == "avc1" and good.duration == (3 * 10 + 20 + 30 + 2 * 40) / 100
    assert [(x.offset - at, x.length) for x in good.keyframes] == [(0, 5), (22, 9), (50, 11), (61, 11)]
    assert good.payload_sha256 == hashlib.sha256(body[:31] + body[50:72]).hexdigest() and bad.codec is None
    for bits, table in ((4, bytes([0x23, 0x40])), (8, bytes([2, 3, 4])), (16, struct.pack(">3H", 2, 3, 4))):
        assert media._compact(memoryview(u32(0, bits, 3) + table), 0).tolist() == [2, 3, 4]
    plain = _track(b"soun", [2, 3, 4], [], [3], [len(ftyp) + 8])
    i = plain.index(b"stsz") - 4
    size = struct.unpack_from(">I", plain, i)[0]
    compact = full(b"stz2", u32(8, 3), bytes([2, 3, 4])) + box(b"free", bytes(size - 12 - 8 - 3 - 8))
    swapped = plain[:i] + compact + plain[i + size :]
    r = media.probe(spark.createDataFrame([(1, bytearray(ftyp + box(b"mdat", body) + box(b"moov", swapped)))], "doc_id long, media binary")).first()
    assert r.payload_sha256 == hashlib.sha256(body[:9]).hexdigest()


def test_scores_of_doubles_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100 + k, rng.normal(size=3).tolist()) for k in range(5)] + [(20, x[3].tolist())]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(v for _, v, _ in got[100]) == [101, 102, 103, 104] and len(got[20]) == 10  # two rows have the id 20
    s = sorted(((float(np.cumsum(x[0] * y)[-1]), -i) for i, y in [*enumerate(x), (20, x[3])] if i != 0), reverse=True)[:5]
    assert [(v, f) for _, v, f in sorted(got[0])] == [(-i, f) for f, i in s]


def test_warc_small_pages_do_not_meet(spark):
    pages = spark.createDataFrame([(k, "u", "") for k in range(50)] + [(100 + k, "u", "y" * 1500) for k in range(3)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert len(got) == 53 and {k: v for k, v in got.items() if v is not None} == {100: 102, 101: 102}


def test_samples_take_one_row_of_an_id(spark):
    texts = spark.createDataFrame([(k % 30, f"text {k % 3} " * 5) for k in range(3000)] + [(7, "long " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = quality.bounded_sample(texts, labels, "quality", 10, 2000).collect()
    assert len(got) == len({r.id for r in got}) <= 10 and sum(len(r.text) for r in got) <= 2000
    assert len(quality.bounded_sample(texts, labels, "quality", 10, 100).collect()) <= 3


def test_quality_step_is_the_gradient():
    rng = np.random.default_rng(3)
    docs = [(np.sort(rng.choice(quality.BUCKETS, 5, replace=False)), np.full(5, 0.2, np.float32)) for _ in range(2)]
    labels = np.array([0, 1])
    before = quality.Classifier().fit(docs, labels, epochs=1, rate=1e-9)
    after = quality.Classifier().fit(docs, labels, epochs=300, rate=1.0)
    loss = lambda m: sum(np.log1p(np.exp(-(2 * y - 1) * (float((m.weights[at] * part).sum()) + m.bias))) for (at, part), y in zip(docs, labels))
    assert abs(loss(before) - 2 * np.log(2)) < 1e-3 and loss(after) < 0.1
    at = quality.buckets("one two".encode())
    after.weights[:] = 0
    after.weights[at[0]] = 8.0
    mean = 8.0 * float((at == at[0]).sum()) / len(at)
    assert abs(after.score("one two") - 1 / (1 + np.exp(-(mean + after.bias)))) < 1e-6


def test_features_by_hand():
    lex = Lexicon({"idiot": 2.0, "idio*": 1.0, "fool*": 0.5})
    f = dict(zip(FEATURES, lex.features("YOU are an Idiot! Foolish id1ot, well then what is it that we say here now you")))
    assert abs(f["density"] - 1 / 17) < 1e-6 and abs(f["mass"] - 2.5 / 17) < 1e-6 and f["peak"] == 2.0
    assert f["second_near"] == 1.0 and abs(f["second"] - 2 / 17) < 1e-6 and abs(f["obfuscated"] - 1 / 17) < 1e-6 and abs(f["hidden_hits"] - np.log(2)) < 1e-6
    small = Lexicon({"idiot": 2.0}, keep=2)
    assert small.features("a b c d e f") and small.features("idiot you") == Lexicon({"idiot": 2.0}).features("idiot you")
    assert lex.features(None) == lex.features(" \n") == [0.0] * len(FEATURES)


def test_toxicity_output_is_isotonic(spark):
    texts, labels = _labelled(spark)
    model = toxicity.train(texts, labels, trees=5)
    x, y = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1
    both = toxicity.score(texts.union(texts).repartition(5), model).groupBy("doc_id").agg(F.countDistinct("score").alias("k"), F.count("score").alias("n"))
    assert both.where("k <> 1 or n <> 2").count() == 0

