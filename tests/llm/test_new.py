"""SimHash groups, collocations and exact clustering against plain code on small tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from clinicweave.llm import clusters, phrases, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    prints = [plain_print(t) for _, t in rows]
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                home[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def test_simhash_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice([f"wörd{k}" for k in range(200)], 60)) for _ in range(12)]
    near = [" ".join(w if k != at else "Änders" for k, w in enumerate(t.split())) for t in base for at in (3, 30)]
    odd = [None, "", " \t\n", "one", "One", "two words", "TWO\x0bwords", "a b c", "a\tb\r\nc", "x" * 100_000, "İ ı ß x"]
    rows = [(k, t) for k, t in enumerate(base + near + odd + base[:3])]
    rows += [(3, base[7]), (None, base[1]), (None, "alone without an id"), (5, base[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as fingerprint", "2 as component_id", "3 as tile")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_groups(rows)
    assert simhash.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 8, 16])
def test_tiles_lose_no_link(spark, n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 150).astype(np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    prints = np.unique(np.concatenate([base, flip(base), flip(flip(base)), np.array([0, 1, 3, 2**64 - 1, 2**64 - 2], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None]) <= 2, 1))
    signed = prints.view(np.int64).tolist()

    def joined(pairs):
        home = {x: x for x in signed}

        def root(x):
            while home[x] != x:
                x = home[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            home[max(a, b)] = min(a, b)
        return [root(x) for x in signed]

    found = [(r.a, r.b) for r in simhash.links(df, len(prints), 2, part=40, n=n).collect()]
    assert all((a ^ b).bit_count() <= 2 or ((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
    assert joined(found) == joined((signed[a], signed[b]) for a, b in zip(i, j))


def test_dense_groups_send_few_links():
    x = np.unique(np.concatenate([np.uint64(1) << np.arange(64, dtype=np.uint64), np.zeros(1, np.uint64)]))
    assert len(simhash.close(x, None, 2)) == len(x) - 1
    assert len(simhash.close(x[:30], x[30:], 2)) == len(x) - 1


@pytest.mark.parametrize("length", [1, 2, 3, 4, 1000, 70_000])
def test_long_texts_are_counted_in_parts(length):
    text = " ".join(f"w{k % 977}" for k in range(length))
    assert simhash.fingerprint(text, at_once=997) == simhash.fingerprint(text)
    if length <= 1000:
        assert simhash.fingerprint(text) == plain_print(text)


def plain_phrases(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    out = []
    for lang in n:
        cand = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        rows_ = []
        for p, a in cand.items():
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            covered = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not covered:
                rows_.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (5, 7), (30, 2000)])
def test_phrases_brute_force(spark, least, top):
    rng = np.random.default_rng(2)
    words = ["the", "The", "of", "ä", "Ä", "straße", "new", "york", "a b", "x\x00y", "𝔘", "z"]
    rows = []
    for lang in ("de", "en", None, "", "und"):
        for _ in range(12):
            text = " ".join(rng.choice(words, 80))
            rows.append((lang, re.sub(" ", lambda m: rng.choice([" ", "  ", "\t", ". ", "!", "\n", "\r", "\x0b"], p=[0.8, 0.05, 0.05, 0.02, 0.02, 0.02, 0.02, 0.02]), text) + " new york new york new york new york new york"))
    rows += [("de", None), ("de", ""), (None, "?"), ("fr", "allein"), *[("it", "uno due tre quattro cinque")] * 40]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as phrase", "2 as size", "3 as n", "4 as rank")
    got = phrases.collocations(docs, least=least, top=top, spread=3)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, top)
    assert phrases.collocations(docs.where("false")).count() == 0


def test_sketch_only_overestimates(spark):
    rows = [("en", " ".join(f"w{k}" for k in range(500))), ("en", "a b c " * 40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    bits = phrases.sketch(docs, 30, 1 << 10)
    for _, words, seeds, _, _ in phrases._runs(docs.toArrow().to_batches()):
        for h, inside in phrases.grams(words, seeds):
            u, n = np.unique(h[inside], return_counts=True)
            assert phrases._reach(bits, u[n >= 30], 1 << 10).all()


def test_counts_of_tasks_and_flushes_agree(spark):
    rows = [("en", "a b c d. " * 5 + f"x{k} y") for k in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == plain_phrases(rows, 30, 2000)


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centres)), key=lambda c: (gap(v, centres[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        centres = [[sum(x) // len(m) for x in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == c]) else old for c, old in enumerate(centres)]
    own = [near(v) for _, v in kept]
    d = [gap(v, centres[o]) for (_, v), o in zip(kept, own)]
    each = Counter()
    for o, x in zip(own, d):
        each[o] += x
    return sorted(((i, o, x, each[o], sum(d), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, own, d)), key=repr)


@pytest.mark.parametrize(("k", "rounds", "count"), [(3, 10, 200), (8, 2, 60), (5, 4, 3), (8, 0, 30)])
def test_clusters_brute_force(spark, k, rounds, count):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.normal(size=4) + 3 * (i % 3)).tolist()) for i in range(count)]
    rows += [(1000, [1.0, 2.0]), (1001, None), (1002, [1.0, None, 0.0, 0.0]), (1003, [math.nan, 0.0, 0.0, 0.0]), (1004, [math.inf, 0.0, 0.0, 0.0]), (None, [0.5, 0.5, -0.5, 0.1])]
    rows += [rows[0]] * 5 + [(0, [-7.0, 1.0, 1.0, -1e-9])] + [(2000 + i, [0.25, -0.25, 0.0, 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as block", "2 as cluster", "3 as x").repartition(3)
    got = clusters.cluster(df, k=k, rounds=rounds, dim=4, bucket_rows=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, k, rounds)
    assert clusters.cluster(df.where("false"), dim=4).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=30), st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=1, max_size=5), st.lists(st.tuples(*[st.integers(-3, 3)] * 3), min_size=5, max_size=5), st.lists(st.booleans(), min_size=5, max_size=5))
def test_changed_centres_decide_alone(points, before, after, flags):
    x, old = np.array(points, np.int64), np.array(before, np.int64)
    new = np.where(np.array(flags)[: len(old), None], np.array(after, np.int64)[: len(old)], old)
    own, best = clusters.reassign(x, np.full(len(x), -1), np.zeros(len(x), np.int64), old, np.ones(len(old), bool))
    got = clusters.reassign(x, own, best, new, (new != old).any(axis=1))
    want = clusters.distances(x, new)
    assert (got[0] == want.argmin(axis=1)).all() and (got[1] == want.min(axis=1)).all()
    total = {c: x[got[0] == c].sum(axis=0) - x[own == c].sum(axis=0) for c in range(len(new))}
    moves = {m["c"]: m for m in clusters.transfers(x, own, got[0], len(new))}
    assert all((np.array(moves[c]["sums"]) == t).all() if c in moves else not t.any() for c, t in total.items())


def test_clusters_refuse_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="do not fit in 64 bits"):
        clusters.cluster(df, dim=2)
