"""Toxicity and quality scores, and the rejection of languages, against plain versions of the whole way."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.ml.linalg import Vectors

from clinicweave.llm import langid, quality, toxicity
from clinicweave.llm.lexicon import LOOKALIKES, SECOND

M = 2**64 - 1


def plain_buckets(raw, count):
    k, c = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    b = [32 if x == 32 or 9 <= x <= 13 else x for x in b" " + raw + b" "]
    x, shift, out = [(v + 1) * c & M for v in b], 64 - count.bit_length() + 1, []
    for size in (3, 4):
        for i in range(len(b) - size + 1):
            if 32 not in b[i + 1 : i + size - 1]:
                h = 0
                for v in x[i : i + size]:
                    h = (h ^ v) * k & M
                    h ^= h >> 32
                out.append((h * k & M) >> shift)
    words, s = [], None
    for i, v in enumerate(b):
        if v != 32 and s is None:
            s = i
        elif v == 32 and s is not None:
            part = x[s:i]
            plain, placed = sum(p ^ (p >> 17) for p in part) & M, sum(p * (2 * j + 1) for j, p in enumerate(part)) & M
            words.append(((plain ^ (placed * k & M)) * k & M) >> shift)
            s = None
    return out + words + [count - 1 for a, b_ in zip(words, words[1:]) if a == b_]


def plain_quality(texts, labels, seed=0, epochs=8, rate=2.0):
    """Vectors in a dictionary, one number after the other."""
    rng = np.random.default_rng(seed)
    start = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM))
    vec, out, bias = {}, [[0.0] * quality.DIM for _ in range(2)], [0.0, 0.0]
    get = lambda b: vec.setdefault(b, start[b].tolist())
    share = sum(labels) / len(labels)
    docs = [Counter(plain_buckets(t.encode(), quality.BUCKETS)) for t in texts]
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for n in rng.permutation(len(docs)):
            done += 1
            total = sum(docs[n].values())
            if not total:
                continue
            part = {b: c / total for b, c in docs[n].items()}
            hidden = [sum(p * get(b)[d] for b, p in part.items()) for d in range(quality.DIM)]
            z = [sum(o * h for o, h in zip(row, hidden)) + s for row, s in zip(out, bias)]
            e = [math.exp(v - max(z)) for v in z]
            p = [v / sum(e) for v in e]
            p[labels[n]] -= 1
            lift = {b: v * len(part) ** 0.5 for b, v in part.items()}
            bend = sum(h * h for h in hidden) + sum(part[b] * lift[b] for b in part) * sum(v * v for row in out for v in row)
            cost = (0.5 / share if labels[n] == 1 else 0.5 / (1 - share)) ** 0.5
            pace = rate * (1 - done / (steps + 1)) * cost
            p = [v * pace / max(1.0, pace * bend) for v in p]
            step = [p[0] * out[0][d] + p[1] * out[1][d] for d in range(quality.DIM)]
            out = [[o - g * h for o, h in zip(row, hidden)] for row, g in zip(out, p)]
            bias = [s - 0.05 * g for s, g in zip(bias, p)]
            for b, v in lift.items():
                vec[b] = [w - v * g for w, g in zip(get(b), step)]

    def score(text):
        found = plain_buckets((text or "").encode(), quality.BUCKETS)
        if not found:
            return share
        mean = [sum(get(b)[d] for b in found) / len(found) for d in range(quality.DIM)]
        return 1 / (1 + math.exp(-sum((a - b) * m for a, b, m in zip(out[1], out[0], mean)) - bias[1] + bias[0]))

    return score


def test_quality_equals_a_plain_version(spark):
    rng = np.random.default_rng(0)
    good, bad = ["häuser", "and", "gardens", "quietly", "grow", "été"], ["zzq", "buy", "$$$", "xxxl"]
    texts = [" ".join(rng.choice(good if k % 2 else bad, 12)) for k in range(30)]
    rows, labels = list(enumerate(texts)), [k % 2 for k in range(30)]
    docs = spark.createDataFrame([*rows, (100, None), (101, ""), (102, "grow\tgrow  quietly")], "doc_id long, text string")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, known)).collect()}
    # the order of training rows is that of their ids
    score = plain_quality(texts, labels)
    for doc, text in [*rows, (100, None), (101, ""), (102, "grow\tgrow  quietly")]:
        assert abs(got[doc] - score(text)) < 2e-3, (doc, got[doc], score(text))
    assert all((got[k] >= 0.5) == (k % 2 == 1) for k in range(30))


def plain_features(text, weights, strong=1.5):
    edge = lambda c: re.sub(r"^[\W_]+|[\W_]+$", "", c).lower()
    keys = lambda w: [w] + [w[:k] + "*" for k in (4, 5) if len(w) >= k] if len(w) >= 3 else []
    weight = lambda w: max((weights.get(k, 0.0) for k in keys(w)), default=0.0)
    chunks = (text or "").split()
    n = len(chunks)
    if not n:
        return [0.0] * 12
    words = [edge(c) for c in chunks]
    w = [x if x >= 0.5 else 0.0 for x in map(weight, words)]
    odd = [not c.isalpha() and not x.isalpha() and bool(re.search(r"[^\W\d_][\d@$!|*#.\-_]+[^\W\d_]", c)) for c, x in zip(chunks, words)]
    bare = [re.sub(r"(.)\1{2,}", r"\1\1", re.sub(r"[^\w]|_", "", c.lower().translate(LOOKALIKES))) for c in chunks]
    hidden = sum(o and weight(b) >= strong for o, b in zip(odd, bare))
    hits, you = [i for i, x in enumerate(w) if x >= strong], [i for i, x in enumerate(words) if x in SECOND]
    near = sum(any(abs(i - j) <= 6 for j in you) for i in hits) / len(hits) if hits and you else 0.0
    raw = (text or "").encode()
    letters = sum(65 <= b < 91 or 97 <= b < 123 or 195 <= b < 224 for b in raw)
    return [
        math.log1p(n), max(w), sum(w) / n, len(hits) / n, math.log1p(len(hits)), near, len(you) / n, sum(65 <= b < 91 for b in raw) / max(1, letters),
        sum(33 <= b < 127 and not chr(b).isalnum() for b in raw) / len(raw), raw.count(b"!") / len(raw), sum(odd) / n, math.log1p(hidden),
    ]


def test_toxicity_equals_a_plain_version(spark):
    """The lexicon by counting, features by loops, trees one by one, calibration by interpolation."""
    rng = np.random.default_rng(1)
    calm, rude = ["the", "house", "is", "große", "you", "Garden"], ["idiot", "stupid", "id1ot", "You", "LOSER!", "fool"]
    texts = [" ".join([*rng.choice(calm, 10), *(rng.choice(rude, 3) if k % 4 == 0 else [])]) for k in range(160)]
    rows = [*enumerate(texts), (500, None), (501, " \n"), (502, "a stup1d-idiot, YOU!! fool")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(160)], "doc_id long, toxic int"), trees=4)

    seen, toxic = Counter(), Counter()
    for k, t in enumerate(texts):
        found = {key for c in t.split() if len(w := re.sub(r"^[\W_]+|[\W_]+$", "", c).lower()) >= 3 for key in [w, *(w[:n] + "*" for n in (4, 5) if len(w) >= n)]}
        seen.update(found)
        if k % 4 == 0:
            toxic.update(found)
    odds = {w: math.log((toxic[w] + 0.5) / 41) - math.log((c - toxic[w] + 0.5) / 121) for w, c in seen.items() if c >= 3}
    odds = {w: x for w, x in odds.items() if x > 0}
    assert model.lexicon.weights.keys() == odds.keys() and all(abs(model.lexicon.weights[w] - x) < 1e-9 for w, x in odds.items())

    at, to = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for doc, text in rows:
        x = Vectors.dense([float(np.float32(v)) if i in (1,) else v for i, v in enumerate(plain_features(text, odds))])
        margin = sum(w * tree.predict(x) for w, tree in zip(model.trees.treeWeights, model.trees.trees))
        p = 1 / (1 + math.exp(-2 * margin))
        assert abs(got[doc] - min(1.0, max(0.0, float(np.interp(p, at, to))))) < 1e-6, doc


def test_rejection_by_hand(spark):
    """Margin and bound are the stated percentiles over right rows of the calibration, and decide what is accepted."""
    rng = np.random.default_rng(2)
    words = {"aa": ["haus", "garten", "straße", "blume"], "bb": ["house", "garden", "street", "flower"], "cc": ["maison", "jardin", "rue", "fleur"]}
    rows = [(k, " ".join(rng.choice(words[lang], 8)), lang) for k in range(300) for lang in [sorted(words)[k % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(docs)
    names, scores, sure = models.predict([t for _, t, _ in rows] + ["q9w8 zzzz kkkk", "house jardin haus", ""])
    h = np.sort(models.entropies([t for _, t, _ in rows] + ["q9w8 zzzz kkkk", "house jardin haus"]), axis=1)
    assert names[-1] == langid.UNKNOWN and not sure[-1] and not sure[-3]
    assert sure[:-1] == ((h[:, 1] - h[:, 0] >= models.margin) & (h[:, 0] <= models.worst)).tolist()
    right = [n == lang for n, (_, _, lang) in zip(names, rows)]
    assert np.mean(right) > 0.99 and np.mean(np.array(sure[:300])[right]) > 0.95
    held = spark.createDataFrame([(lang, t) for _, t, lang in rows], "lang string, text string")
    langid.calibrate(models, held)
    gap, best = (h[:300, 1] - h[:300, 0])[right], h[:300, 0][right]
    assert abs(models.margin - np.percentile(gap, 0.5)) < 1e-6 and abs(models.worst - 1.25 * np.percentile(best, 99.5)) < 1e-6


def test_rare_ngrams_go_where_models_would_be_too_large(spark):
    rng = np.random.default_rng(3)
    words = {"aa": ["haus", "garten", "straße", "blume"], "bb": ["house", "garden", "street", "flower"]}
    rows = [(k, " ".join(rng.choice(words[lang], 8)) + " " + "".join(rng.choice(list("abcdefgh"), 5)), lang) for k in range(200) for lang in [sorted(words)[k % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = langid.train(docs)
    size = sum(len(k) for k in whole.keys) * (8 + 8 * 2)
    few = langid.train(docs, most_bytes=int(0.8 * size))
    assert sum(len(k) for k in few.keys) * 24 <= 0.8 * size and [len(k) for k in few.keys[:3]] == [len(k) for k in whole.keys[:3]]
    names = few.predict([t for _, t, _ in rows])[0]
    assert np.mean([n == lang for n, (_, _, lang) in zip(names, rows)]) > 0.98
    try:
        langid.train(docs, most_bytes=100)
        raise AssertionError("a bound that nothing fits in")
    except ValueError as e:
        assert "lower the order" in str(e)


def test_language_does_not_depend_on_the_size_of_models(spark):
    """Models too large for one part answer bit for bit as undivided ones; n-grams that occur once are kept."""
    rng = np.random.default_rng(4)
    words = {"aa": ["haus", "garten", "straße", "blume"], "bb": ["house", "garden", "street", "flower"]}
    rows = [(k, " ".join(rng.choice(words[lang], 8)) + " " + "".join(rng.choice([chr(c) for c in range(0x4E00, 0x4E60)], 5)), lang) for k in range(200) for lang in [sorted(words)[k % 2]]]
    docs = spark.createDataFrame([*rows, (7, "haus", None), (7, None, "aa"), (None, "12", None), (None, "", "bb"), (8, "straße 丂 house " * 300, None)], "doc_id long, text string, lang string")
    whole = langid.train(docs)
    size = sum(len(k) for k in whole.keys) * (8 + 8 * 2)
    apart = langid.train(docs, part_bytes=size // 5)
    assert whole.parts == 1 and apart.parts > 1
    built = [apart.build(k) for k in range(apart.parts)]
    assert sum(len(m.keys[3]) for m in built) == len(whole.keys[3]) > max(len(m.keys[3]) for m in built)
    texts = [t for _, t, _ in rows] + ["", None, "?", "x", "丂丂 haus"]
    assert np.array_equal(apart.entropies(texts), whole.entropies(texts), equal_nan=True)
    assert (apart.margin, apart.worst) == (whole.margin, whole.worst) and whole.margin > 0
    got = [sorted(map(tuple, langid.identify(docs, m).collect()), key=repr) for m in (apart, whole)]
    assert got[0] == got[1] and len(got[0]) == 205
