"""The toxicity lexicon and the dense features of a text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

# Second-person words of English, German, French, Spanish, Italian and Portuguese.
SECOND = frozenset("you your yours yourself ya u du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros voi você vocês seu sua".split())
# Characters that stand for letters in obfuscated spellings.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

_MIXED = re.compile(r"[^\W\d_][\d@$!|*#.\-_]+[^\W\d_]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SIGNS = np.zeros(256, bool)
_SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
FEATURES = ["size", "peak", "mass", "density", "hits", "second_near", "second", "capitals", "signs", "exclaims", "obfuscated", "hidden_hits"]
CLEAR = 0.5  # log odds from which a word says something about a text
NEAR = 6  # words between a lexicon word and a second-person one


def word(chunk: str) -> str:
    return _EDGES.sub("", chunk).lower()


def plain(chunk: str) -> str:
    """An obfuscated spelling in plain letters, runs of one letter cut to two."""
    w = re.sub(r"[^\w]|_", "", chunk.lower().translate(LOOKALIKES))
    return re.sub(r"(.)\1{2,}", r"\1\1", w)


def entries(w: str) -> list[str]:
    """The lexicon's keys of a word: itself and its stems."""
    return [w, *(w[:k] + "*" for k in (4, 5) if len(w) >= k)] if len(w) >= 3 else []


def terms(batches):
    """Distinct keys of each labelled text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            keys, labels, folds = [], [], []
            for text, label, fold in zip(*(c.slice(at, 100).to_pylist() for c in batch.columns)):
                found = {k for w in {word(c) for c in set((text or "").split())} for k in entries(w)}
                keys += found
                labels += [label] * len(found)
                folds += [fold] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(labels, pa.int32()), pa.array(folds, pa.int32())], names=["term", "label", "fold"])


class Lexicon:
    """Log odds of the words and stems that toxic rows use more often than others."""

    def __init__(self, weights: dict[str, float], strong: float = 1.5, keep: int = 100_000):
        self.weights, self.strong, self.keep = weights, strong, keep
        self._clear()

    @classmethod
    def counted(cls, names: list[str], toxic: np.ndarray, rows: np.ndarray, all_toxic: int, all_rows: int, least: int = 3, strong: float = 1.5) -> Lexicon:
        """From the toxic and all rows that hold each name, and those there are; `least` rows make an entry."""
        odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((rows - toxic + 0.5) / (all_rows - all_toxic + 1))
        some = np.flatnonzero((rows >= least) & (odds > 0))
        return cls(dict(zip([names[i] for i in some.tolist()], odds[some].tolist())), strong)

    def _clear(self) -> None:
        """Forget chunks seen so far; each has a place in a table of (weight, weight in plain letters, second person, odd)."""
        self.places: dict[str, int] = {}
        self.table, self.used = np.empty((1024, 4), np.float32), 0

    def __getstate__(self):
        return {"weights": self.weights, "strong": self.strong, "keep": self.keep}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    def weight(self, w: str) -> float:
        """The largest log odds among a word's keys; 0 without any."""
        return max((self.weights.get(k, 0.0) for k in entries(w)), default=0.0)

    def _know(self, chunk: str) -> int:
        at = self.places.get(chunk)
        if at is None:
            at = self.places[chunk] = self.used
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            if chunk.isalpha():
                w = chunk.lower()
                self.table[at] = self.weight(w), 0.0, w in SECOND, False
            else:
                w = word(chunk)
                odd = not w.isalpha() and bool(_MIXED.search(chunk))
                self.table[at] = self.weight(w), self.weight(plain(chunk)) if odd else 0.0, w in SECOND, odd
            self.used += 1
        return at

    def features(self, text: str | None) -> list[float]:
        """Features of a text, in the order of FEATURES; zeros for null, empty and blank ones."""
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        chunks = text.split()
        n = len(chunks)
        if not n:
            return [0.0] * len(FEATURES)
        if self.used > self.keep:
            self._clear()
        ids = list(map(self.places.get, chunks))
        if None in ids:
            ids = [self._know(c) if i is None else i for i, c in zip(ids, chunks)]
        t = self.table[ids]
        w, second, odd = np.where(t[:, 0] >= CLEAR, t[:, 0], 0), t[:, 2] > 0, t[:, 3] > 0
        hidden = (t[:, 1] >= self.strong).sum()
        hit = w >= self.strong
        near = 0.0
        if hit.any() and second.any():
            at, you = np.flatnonzero(hit), np.flatnonzero(second)
            right = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(at - you[np.maximum(right - 1, 0)]))
            near = float((gap <= NEAR).mean())
        counts = np.bincount(raw, minlength=256)
        letters = counts[65:91].sum() + counts[97:123].sum() + counts[195:224].sum()
        size = len(raw)
        return [
            float(np.log1p(n)), float(w.max()), float(w.sum() / n), float(hit.sum() / n), float(np.log1p(hit.sum())), near, float(second.sum() / n),
            float(counts[65:91].sum() / max(1, letters)), float(counts[_SIGNS].sum() / size), float(counts[33] / size), float(odd.sum() / n), float(np.log1p(hidden)),
        ]


def featured(shared, at_text: int, at_fold: int | None):
    """Columns of batches and one more: the features, by the broadcast lexicon of each row's fold, or the only one."""

    def run(batches):
        lex = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                part = whole.slice(at, 200)
                texts = part.column(at_text).to_pylist()
                folds = part.column(at_fold).to_pylist() if at_fold is not None else [0] * len(texts)
                yield [*part.columns, pa.array([lex[k].features(t) for t, k in zip(texts, folds)], pa.list_(pa.float64()))]

    return run
