"""The pipeline's stages over the smallest tables, each against its own input."""

import os
import re
import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from clinicweave.llm import common
from clinicweave.llm.common import write_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("900001L doc_id", "cast(null as string) text", "lang", "source", "n_chars").union(docs.limit(1).selectExpr("900002L", "''", "lang", "source", "n_chars"))
    out = {"input": docs.union(extra)}
    at = out["input"]
    for name, stage in corpus_pipeline.STAGES:
        at = out[name] = write_table(stage(spark, at, SF), name)
    return {k: v.toPandas() for k, v in out.items()}


def test_columns_stay(stages):
    for name in ("quality", "toxicity", "lines", "documents"):
        assert list(stages[name].columns) == list(stages["input"].columns)


def test_filters_keep_unlabelled_order_of_rows(stages):
    known = stages["input"].merge(__import__("pandas").read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    good = set(known[(known.quality == 1) & (known.toxic == 0)].doc_id)
    kept = set(stages["toxicity"].doc_id)
    assert len(good & kept) >= 0.95 * len(good)
    bad = set(known[known.quality == 0].doc_id)
    assert len(bad & set(stages["quality"].doc_id)) <= 0.1 * len(bad)


def test_null_and_empty_texts_stay(stages):
    assert {900001, 900002} <= set(stages["documents"].doc_id)


def test_lines_occur_once(stages):
    assert len(stages["lines"]) == len(stages["toxicity"])
    seen = set()
    for text in stages["lines"].text.dropna():
        for line in text.split("\n"):
            x = line.strip(" \t\r")
            assert not x or x not in seen
            seen.add(x)


def test_one_document_of_each_group(stages):
    before, after = stages["lines"], set(stages["documents"].doc_id)
    sets = {}
    for i, t in zip(before.doc_id, before.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                home[max(x, y)] = min(x, y)
    assert after == {i for i in ids if root(i) == i}


def test_packing_covers_every_id(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"].sort_values(["doc_id", "start"])
    texts = dict(zip(stages["documents"].doc_id, stages["documents"].text))
    assert set(pieces.doc_id) == set(texts)
    for doc, rows in pieces.groupby("doc_id"):
        ids = [*t.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        at = 0
        for r in rows.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(raw[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids)
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def test_near_copies_by_the_rule_of_the_stage(spark):
    words = [f"w{k}" for k in range(300)]
    scattered = ["x" if k in (20, 70, 120, 170, 220, 270) else w for k, w in enumerate(words)]
    longer = [f"v{k}" for k in range(300)]
    far = ["y" if k % 10 == 5 else w for k, w in enumerate(f"u{k}" for k in range(300))]
    rows = [words, scattered, longer, longer + [f"t{k}" for k in range(45)], [f"u{k}" for k in range(300)], far]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, SF).collect()} == {0, 2, 4, 5}


def test_repeated_ids_missing_ids_and_clashing_names(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a), (None, b), (None, " ".join(f"c{k}" for k in range(40))), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as th", "2 as gone", "3 as score", "4 as x", "5 as `a.b`")
    kept = corpus_pipeline.dedup_documents(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), rows[4], rows[5], rows[6], rows[7]], key=repr)
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_toxic):
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns and left.where("coalesce(text, '') = ''").count() == 3
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_one_of_equal_rows_stays(spark):
    words = lambda x, n=40: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, words("a")), (1, words("a")), (2, words("a")), (2, words("a")), (3, words("b")), (3, words("c")), (3, words("c")), (None, words("d")), (None, words("d")), (4, "one"), (4, "one"), (5, None), (5, None), (6, "")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string").selectExpr("*", "1 as mark", "2 as mark_id", "3 as `a.b`")
    kept = corpus_pipeline.dedup_documents(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(1, words("a")), (3, words("b")), (3, words("c")), (None, words("d")), (4, "one")] + [(5, None)] * 4 + [(6, "")] * 2
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_near_lines_go_in_the_pipeline(spark):
    line = "an example of a line that is long enough"
    docs = spark.createDataFrame([(1, f"{line}\nfirst"), (2, f"second\n{line[:-1]}"), (3, f"{line[:5]}#{line[6:]}\n\nthird"), (4, f"x{line}y")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, SF).collect()}
    assert got == {1: f"{line}\nfirst", 2: "second", 3: "\nthird", 4: f"x{line}y"}


def test_the_driver_settles_before_each_stage(spark, monkeypatch):
    """What finished work left in the driver is given back, and each stage begins with that."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    common.settle(spark)
    least = used()
    spark.range(400_000).selectExpr("sha2(string(id), 512) s").toArrow()
    common.settle(spark)
    assert used() < least + 20_000_000
    seen = []
    monkeypatch.setattr(corpus_pipeline, "settle", lambda s: seen.append(s))
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[2:]:
        stage(spark, docs, "")
    assert len(seen) == 3
