"""Byte-pair encoding and decoding of whole columns with a public tokenizer file.

Each task splits its texts at white space and encodes every distinct chunk once. New chunks are
encoded together. Words of one length are the columns of an array, and each step applies to every
column its own best merge. Long words share one index that maps each pair of symbols to all its
positions, the ranks that are active are applied in ascending order, and each merge updates only the
lists of the pairs beside it. Nothing is trained and the file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = re.compile("[\x1c-\x1f]")  # split() takes these for white space, the tokenizer does not
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[^{_SPACE}]+")
_ENDS = frozenset(".,;:!?")  # one of these behind letters is a piece of its own
_SHORT, _NONE = 48, 1 << 30  # bytes of a word that is encoded in columns, below 64; the key of a pair that never merges


def _byte_chars() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Bpe:
    """A BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str, keep: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = t
        self.as_bytes = [t.encode() for t in self.tokens]
        suffix = model["end_of_word_suffix"] or ""
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int64)
        self.size = len(self.tokens)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.pairs = pairs
        self.rank = {a * self.size + b: r for r, (a, b, _) in enumerate(pairs)}
        self.code = np.array(sorted(self.rank), np.int64)
        self.code_rank = np.array([self.rank[x] for x in self.code.tolist()], np.int64)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.odd = "[\x1c-\x1f]" + "".join("|" + re.escape(t) for t in self.added)
        self.into = np.array([c for _, _, c in pairs], np.int32)
        self.slots = 1 << (4 * len(pairs)).bit_length()  # a hash table of pairs: open addressing, at most a quarter full
        self.slot_code, self.slot_rank = np.full(self.slots, -1, np.int64), np.full(self.slots, _NONE >> 6, np.int32)
        left, at = np.arange(len(self.code)), self._slot(self.code)
        while len(left):
            free = left[self.slot_code[at[left]] < 0]
            self.slot_code[at[free]] = self.code[free]  # of those that want one slot, the last gets it
            left = left[self.slot_code[at[left]] != self.code[left]]
            at[left] = (at[left] + 1) & (self.slots - 1)
        self.slot_rank[at] = self.code_rank
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}
        self.keep = keep

    def _ranks(self, codes: np.ndarray) -> np.ndarray:
        """Rank of each pair code, or -1."""
        at = np.searchsorted(self.code, codes)
        at[at == len(self.code)] = 0
        return np.where(self.code[at] == codes, self.code_rank[at], -1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * 0x1E3779B97F4A7C15 >> 32) & (self.slots - 1)

    def _keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64 times the rank of each pair of symbols, or `_NONE`."""
        codes = a.astype(np.int64) * self.size + b
        at = self._slot(codes)
        found = self.slot_code[at]
        left = np.flatnonzero((found != codes) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (self.slots - 1)
            found = self.slot_code[at[left]]
            left = left[(found != codes[left]) & (found >= 0)]
        return np.where(self.slot_code[at] == codes, self.slot_rank[at] << 6, _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word; those of one length are encoded together."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[order], np.arange(1, _SHORT + 2)).tolist()
        for size, i, j in zip(range(1, _SHORT + 1), cuts, cuts[1:]):
            for at in range(i, j, 16384):  # what the caches of a core hold
                self._columns(words, order[at : min(j, at + 16384)], size, out)
        long = order[cuts[-1] :].tolist()
        if long:
            for k, ids in zip(long, self._linked([words[k] for k in long])):
                out[k] = ids
        return out

    def _columns(self, words: list[bytes], which: np.ndarray, size: int, out: list[bytes]) -> None:
        """Put into `out` the ids of the words `which`, all of `size` bytes: each is a column of symbols.

        A key is 64 times a pair's rank plus its row, so the smallest of a column is its next merge, the
        leftmost of equal ones. Each step makes every column shorter by one; finished ones leave.
        """
        raw = np.frombuffer(b"".join([words[k] for k in which.tolist()]), np.uint8).reshape(-1, size).T
        sym = self.inner[raw].astype(np.int32)
        sym[-1] = self.final[raw[-1]]
        key = self._keys(sym[:-1].ravel(), sym[1:].ravel()).reshape(sym[1:].shape) + np.arange(size - 1, dtype=np.int32)[:, None]
        while len(which):
            best = key.min(axis=0) if len(key) else np.full(len(which), _NONE, np.int32)
            more = best < _NONE >> 1
            if not more.all():
                flat, step = np.ascontiguousarray(sym[:, ~more].T, "<u4").tobytes(), 4 * len(sym)
                for k, at in zip(which[~more].tolist(), range(0, len(flat), step)):
                    out[k] = flat[at : at + step]
                which, best, sym, key = which[more], best[more], sym[:, more], key[:, more]
                if not len(which):
                    return
            row, new, column = (best & 63).astype(np.int64), self.into[best >> 6], np.arange(len(which))
            rows = np.arange(len(sym) - 1, dtype=np.int32)[:, None]
            sym = np.where(rows < row, sym[:-1], sym[1:])
            sym[row, column] = new
            key = np.where(rows[:-1] < row, key[:-1], key[1:] - 1)
            for beside, place in ((np.flatnonzero(row > 0), -1), (np.flatnonzero(row < len(key)), 0)):
                at = row[beside] + place
                key[at, beside] = self._keys(sym[at, beside], sym[at + 1, beside]) + at

    def _linked(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word, all words at once: one list of symbols, linked both ways.

        Lists of a few positions are applied one by one, long ones as arrays over the same memory.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, size, few = len(raw), self.size, 24
        ends = np.cumsum(sizes)
        last = np.zeros(n, bool)
        last[ends - 1] = True
        start = np.append(True, last[:-1])
        none = -(size**3)  # the symbol of position n, which stands for "none"
        sym = array("q", np.append(np.where(last, self.final[raw], self.inner[raw]), none).tobytes())
        nxt = array("q", np.append(np.where(last, n, np.arange(1, n + 1)), n).tobytes())
        prv = array("q", np.append(np.where(start, n, np.arange(-1, n - 1)), n).tobytes())
        sym_, nxt_, prv_ = (np.frombuffer(x, np.int64) for x in (sym, nxt, prv))
        one: dict[int, list[int]] = {}  # positions of each active pair, by rank
        many: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        rank_of = self.rank.get

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            cuts = np.append(np.flatnonzero(rank[1:] != rank[:-1]) + 1, len(at)).tolist()
            i = 0
            for j, r in zip(cuts, rank[np.array(cuts) - 1].tolist()):
                if r not in one:
                    one[r] = []
                    heapq.heappush(heap, r)
                if j - i < few:
                    one[r] += at[i:j].tolist()
                else:
                    many.setdefault(r, []).append(at[i:j])
                i = j

        inside = np.flatnonzero(~last)
        rank = self._ranks(sym_[inside] * size + sym_[inside + 1])
        if (rank >= 0).any():
            add(inside[rank >= 0], rank[rank >= 0])
        while heap:
            r = heapq.heappop(heap)
            a, b, c = self.pairs[r]
            places, long = one.pop(r), many.pop(r, None)
            if long is None or a == b:
                if long:
                    places += np.concatenate(long).tolist()
                if a == b:  # runs of one symbol merge from the left
                    places.sort()
                for p in places:
                    q = nxt[p]
                    if sym[p] != a or sym[q] != b:
                        continue
                    after, before = nxt[q], prv[p]
                    sym[p], sym[q] = c, -1
                    nxt[p] = after
                    if after != n:
                        prv[after] = p
                    for at, k in ((p, rank_of(c * size + sym[after])), (before, rank_of(sym[before] * size + c))):
                        if k is not None:
                            if k in one:
                                one[k].append(at)
                            else:
                                one[k] = [at]
                                heapq.heappush(heap, k)
                continue
            at = np.concatenate([*long, np.array(places, np.int64)])
            at = at[(sym_[at] == a) & (sym_[nxt_[at]] == b)]
            gone = nxt_[at]
            after = nxt_[gone]
            sym_[at], sym_[gone], nxt_[at] = c, -1, after
            prv_[after] = at
            prv_[n] = n
            starts = np.concatenate([prv_[at], at])
            rank = self._ranks(sym_[starts] * size + sym_[nxt_[starts]])
            if (rank >= 0).any():
                add(starts[rank >= 0], rank[rank >= 0])
        ids = sym_[:n]
        live = ids >= 0
        cuts = np.append(0, np.cumsum(np.add.reduceat(live, ends - sizes, dtype=np.int64))).tolist() if n else [0]
        flat = ids[live].astype("<u4").tobytes()
        return [flat[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:])]

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that the cache does not hold, all together."""
        pieces, counts = [], []
        for chunk in chunks:
            if chunk.isascii():
                clean = chunk.lower()
            else:
                clean = unicodedata.normalize("NFC", chunk)
                clean = clean.lower() if "Σ" not in clean else "".join(c.lower() for c in clean)
            if clean.isalpha():
                counts.append(1)
                pieces.append(clean)
            elif clean[-1:] in _ENDS and clean[:-1].isalpha():
                counts.append(2)
                pieces += clean[:-1], clean[-1]
            else:
                found = self.words.findall(clean)
                counts.append(len(found))
                pieces += found
        known = self.cache.get
        distinct = {k: known(k) if k.isalpha() else None for k in dict.fromkeys(pieces)}  # letters alone are their only piece
        keys = [k for k, ids in distinct.items() if ids is None]
        if keys:
            for k, ids in zip(keys, self.merge([k.encode("utf-8", "replace") for k in keys])):
                distinct[k] = ids
        at = 0
        for chunk, k in zip(chunks, counts):
            if k == 1:
                self.cache[chunk] = distinct[pieces[at]]
            elif k == 2:
                self.cache[chunk] = distinct[pieces[at]] + distinct[pieces[at + 1]]
            else:
                self.cache[chunk] = b"".join([distinct[p] for p in pieces[at : at + k]])
            at += k
        for chunk in self.added.keys() & set(chunks):
            self.cache[chunk] = self.added[chunk].to_bytes(4, "little")

    def _take(self, chunks: list[str]) -> None:
        """Learn new ones of `chunks`. Beyond about `keep` in all, those that `chunks` lack are forgotten."""
        missing = [w for w in chunks if w not in self.cache]
        if missing and len(self.cache) + len(missing) > self.keep:
            self.cache = {w: self.cache[w] for w in chunks if w in self.cache}
        if missing:
            self._learn(missing)

    def _pool(self, texts: list[pa.Array]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Where each array's texts end among all chunks; those chunks by number; ids of all distinct chunks and where each one's end."""
        lists = [self._split(t) for t in texts]
        counts = [x.value_lengths().to_numpy() for x in lists]
        coded = pa.chunked_array([x.flatten() for x in lists]).dictionary_encode()
        chunks = coded.chunk(0).dictionary.to_numpy(zero_copy_only=False).tolist() if len(coded) else []
        numbers = np.concatenate([np.zeros(0, np.int32), *(x.indices.to_numpy() for x in coded.chunks)])
        del lists, coded  # before more memory is taken
        pa.default_memory_pool().release_unused()
        pool, ends = [], [np.zeros(1, np.int64)]
        for at in range(0, len(chunks), 2 * self.keep):
            part = chunks[at : at + 2 * self.keep]
            self._take(part)
            found = [self.cache[w] for w in part]
            pool.append(b"".join(found))
            ends.append(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        until = np.cumsum([0, *map(np.sum, counts)]).tolist()
        cuts = [base + np.append(0, np.cumsum(n, dtype=np.int64)) for base, n in zip(until, counts)]
        return cuts, numbers, np.frombuffer(b"".join(pool), "<u4"), np.cumsum(np.concatenate(ends))

    def learn(self, texts: list[str | None]) -> None:
        """Encode all new chunks of `texts` together."""
        self._pool([pa.array(texts, pa.string())])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        return [ids for _, some in self.encoded([pa.array(texts, pa.string())]) for ids in some]

    def encoded(self, texts: list[pa.Array], rows: int = 200):
        """(array's number and first row, ids of each text) for up to `rows` texts at a time; new chunks of all arrays are encoded together."""
        cuts, numbers, pool, ends = self._pool(texts)
        for k, found in enumerate(cuts):
            for row in range(0, len(found) - 1, rows):
                some = found[row : row + rows + 1]
                chunk = numbers[some[0] : some[-1]]
                size = ends[chunk + 1] - ends[chunk]
                until = np.append(0, np.cumsum(size))
                ids = pool[np.repeat(ends[chunk] - until[:-1], size) + np.arange(until[-1])].tobytes()
                at = (4 * until[some - some[0]]).tolist()
                yield (k, row), [ids[i:j] for i, j in zip(at, at[1:])]

    def _split(self, texts: pa.Array) -> pa.Array:
        """Chunks of each text; an empty one at its ends has no ids."""
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), False)
        texts = pc.fill_null(texts, "")
        if not pc.any(odd).as_py():
            return pc.utf8_split_whitespace(texts)
        plain = pc.utf8_split_whitespace(texts.filter(pc.invert(odd)))
        parts = pa.array([self._parts(t) for t in texts.filter(odd).to_pylist()], plain.type)
        place = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([plain, parts]).take(pa.array(place))

    def _parts(self, text: str) -> list[str]:
        """Chunks, and the added tokens between them."""
        if not self.split_added:
            return self._chunks(text)
        return [c for part in self.split_added.split(text) for c in ([part] if part in self.added else self._chunks(part))]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return _CHUNK.findall(text) if _ODD.search(text) else text.split()

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens, joined by spaces: the file names no decoder."""
        tokens = self.as_bytes
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """The vocabulary and its cache, kept by a worker from task to task."""
    return Bpe(path)


def gathered(batches, chars: int = 12_000_000):
    """Arrow batches of (id, text), put together until they hold about `chars` bytes of text.

    The larger the run, the fewer times a word is encoded; one batch at least is taken whole.
    """
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(batches, bpe: Bpe):
    """(ids of the rows, encoded texts) for small runs of rows, after their words are learnt."""
    for held in gathered(batches):
        for (k, row), ids in bpe.encoded([batch.column(1) for batch in held]):
            yield held[k].column(0).slice(row, len(ids)), ids


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null and empty texts give empty arrays."""

    def run(batches):
        for names, texts in encoded(batches, loaded(path)):
            yield pa.RecordBatch.from_arrays([names, pa.array([np.frombuffer(x, "<i4") for x in texts], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, decoded from its ids.

    Null texts count as empty: no tokens, and the hashes of nothing. Ids may repeat or be null; each
    row gives one row. Memory is bounded by a run of texts, at least one whole text.
    """

    def run(batches):
        bpe = loaded(path)
        for names, ids in encoded(batches, bpe):
            digests = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]]
            yield pa.RecordBatch.from_arrays([names, pa.array([len(x) // 4 for x in ids], pa.int64()), *map(lambda x: pa.array(x, pa.string()), digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
