"""Lexical and vector scores of a block of queries against batches of nodes, all queries at once.

A term counts where it stands anywhere in a field, so no equality join finds it.  One pass of an automaton over a node
finds all strings of all queries in it; what each string is worth to which query is a sparse product.  Column
expressions would search each node once for each term of each query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import reduce

import numpy as np

from ..functions import constants as K

#: Blended scores are compared rounded to four places; nearer ones may turn out equal.
_NEAR = 1.01e-4
#: Nodes times queries that are in numbers at once: 8 MB an array, of which a step holds about ten.
_CELLS = 1 << 20
#: Characters of lower-cased terms, and how many of a text are looked up at once.
_ALPHABET, _WINDOW = "abcdefghijklmnopqrstuvwxyz0123456789_.$/-", 1 << 16


def as_vectors(given: list) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) if v is not None else np.zeros(0) for v in given]


def cosines(vectors: list, asked: list[np.ndarray]) -> np.ndarray:
    """(vectors, asked): over the dimensions that both have; 0 where a norm is 0 or a vector is missing."""
    out = np.zeros((len(vectors), len(asked)))
    of_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        of_size.setdefault(0 if v is None else len(v), []).append(i)
    asked_sizes: dict[int, list[int]] = {}
    for j, v in enumerate(asked):
        asked_sizes.setdefault(len(v), []).append(j)
    for a, some in of_size.items():
        for b, own in asked_sizes.items():
            n = min(a, b)
            if n:
                x = np.array([vectors[i][:n] for i in some], np.float64)
                y = np.array([asked[j][:n] for j in own])
                norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
                out[np.ix_(some, own)] = np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms > 0)
    return out


def finder(strings: dict[int, str]):
    """text -> numbers of the strings that stand in it."""
    if not strings:
        return lambda text: []
    try:
        import ahocorasick
    except ImportError:
        return lambda text: [k for k, x in strings.items() if x in text]
    automaton = ahocorasick.Automaton()
    for k, x in strings.items():
        automaton.add_word(x, k)
    automaton.make_automaton()
    return lambda text: {k for _, k in automaton.iter(text)}


class Terms:
    """text -> numbers of the terms that stand in it.

    Terms of two to four characters stand in nearly every text many times, and an automaton tells each time.  They are looked
    up in tables by their characters instead, each a digit to the base of the alphabet and a rest; the longer go by an automaton.
    """

    def __init__(self, strings: dict[int, str]):
        short = {k: x for k, x in strings.items() if 2 <= len(x) <= 4 and not x.strip(_ALPHABET)}
        self.longer = finder({k: x for k, x in strings.items() if k not in short})
        self.numbers = np.fromiter(short, np.int64, len(short))
        self.digits = bytes(_ALPHABET.find(chr(c)) + 1 if c < 128 else 0 for c in range(256))
        base = len(_ALPHABET) + 1
        self.tables = {n: np.zeros(base**n, np.int32) for n in sorted({len(x) for x in short.values()})}
        for nth, x in enumerate(short.values()):
            self.tables[len(x)][reduce(lambda place, c: place * base + _ALPHABET.index(c) + 1, x, 0)] = nth + 1

    def __call__(self, text: str) -> list[int]:
        return [*self.longer(text), *self._short(text)]

    def _short(self, text: str) -> list[int]:
        if not self.tables:
            return []
        found, base = np.zeros(len(self.numbers) + 1, bool), len(_ALPHABET) + 1
        for a in range(0, len(text), _WINDOW):
            digit = np.frombuffer(text[a : a + _WINDOW + 3].encode("ascii", "replace").translate(self.digits), np.uint8).astype(np.int32)
            place = digit
            for n in range(2, max(self.tables) + 1):
                place = place[:-1] * base + digit[n - 1 :]
                if n in self.tables:
                    found[self.tables[n][place]] = True
        return self.numbers[found[1:]].tolist()


class Block:
    """Queries (low, words, root, asks, query_embedding) in numbers; pickles without its automaton."""

    def __init__(self, rows: list):
        self.n = len(rows)
        numbers: dict[str, int] = {}
        entries = []
        for j, r in enumerate(rows):
            entries += [(numbers.setdefault(w, len(numbers)), j, c, 0) for w, c in Counter(r.words or []).items()]
            if r.low:
                entries.append((numbers.setdefault(r.low, len(numbers)), j, 0, 1))
        table = np.array(sorted(entries), np.int64).reshape(-1, 4)
        self.strings = list(numbers)
        self.first = np.searchsorted(table[:, 0], np.arange(len(numbers) + 1))
        self.query, self.times, self.whole = table[:, 1], table[:, 2], table[:, 3]
        self.empty = np.array([r.low == "" for r in rows], bool)
        self.roots = [r.root for r in rows]
        self.asks = np.array([bool(r.asks) for r in rows], bool)
        self.vectors = as_vectors([getattr(r, "query_embedding", None) for r in rows])
        self.best = np.zeros(self.n, np.int64)
        self._find = self._terms = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_find": None, "_terms": None}

    def scores(self, titles: list[str], paths: list[str], texts: Iterable[str], kinds: np.ndarray) -> np.ndarray:
        """(nodes, queries); texts hold titles and paths too, and are taken one at a time."""
        if self._find is None:
            self._find = finder(dict(enumerate(self.strings)))
            terms = np.unique(np.repeat(np.arange(len(self.strings)), np.diff(self.first))[self.times > 0])
            self._terms = Terms({k: self.strings[k] for k in terms.tolist()})
        out = np.repeat(kinds.astype(np.int64)[:, None], self.n, axis=1) + 32 * self.empty
        count, low = np.diff(self.first).tolist(), 0
        found, sizes, entries = [], [], 0
        for i, (t, p, h) in enumerate(zip(titles, paths, texts, strict=True)):
            for hit in (self._terms(h), self._find(t), self._find(p)):
                found.extend(hit)
                sizes.append(len(hit))
                entries += sum(map(count.__getitem__, hit))
            if entries >= _CELLS >> 2:
                self._add(out[low : i + 1], found, sizes)
                found, sizes, entries, low = [], [], 0, i + 1
        self._add(out[low:], found, sizes)
        return out

    def _add(self, out: np.ndarray, found: list[int], sizes: list[int]) -> None:
        """Adds to out (nodes, queries) what strings are worth; sizes: how many of them stand in each node's text, title and path."""
        which = np.repeat(np.arange(len(sizes)), sizes)
        found = np.array(found, np.int64)
        n = self.first[found + 1] - self.first[found]
        at = np.repeat(self.first[found] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        which = np.repeat(which, n)
        worth = np.array([2, 10, 6])[which % 3] * self.times[at] + np.array([0, 20, 12])[which % 3] * self.whole[at]
        out += np.bincount(which // 3 * self.n + self.query[at], weights=worth, minlength=out.size).astype(np.int64).reshape(out.shape)

    def cosines(self, vectors: list) -> np.ndarray:
        """(nodes, queries)."""
        return cosines(vectors, self.vectors)

    def inside(self, roots: list) -> np.ndarray:
        """(nodes, queries): whether a node's root is the query's, or that asks all."""
        own: dict = {}
        for r in set(roots):
            own[r] = np.array([q is None or (r is not None and q == r) for q in self.roots], bool)
        return np.array([own[r] for r in roots]).reshape(len(roots), self.n)


def judged(block: Block, batch, semantic: bool):
    """Pieces of a batch: first row, scores, cosines, and which nodes are admitted to which queries."""
    step = max(1, _CELLS // max(1, block.n))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        column = lambda c: part.column(c).to_pylist()  # noqa: B023, E731
        texts = (x.as_py() or "" for x in part.column("h"))
        score = block.scores(*([x or "" for x in column(c)] for c in ("t", "p")), texts, np.array(column("kind"), np.int64))
        cosine = block.cosines(column("embedding")) if semantic else np.zeros(score.shape)
        yield a, part, score, cosine, block.inside(column("index_root")) & ((score > 0) | (cosine >= K.SEMANTIC_FLOOR))


def best_scores(block: Block, batches, semantic: bool) -> np.ndarray:
    """The best admitted score of each query; -1 for none."""
    out = np.full(block.n, -1, np.int64)
    for batch in batches:
        for _, _, score, _, ok in judged(block, batch, semantic):
            if len(score):
                out = np.maximum(out, np.where(ok, score, -1).max(axis=0))
    return out


class Top:
    """Of ever more nodes those that may be among the `limit` best of a query, given all its scores' best."""

    def __init__(self, block: Block, limit: int, alpha: float, semantic: bool):
        self.block, self.limit, self.alpha, self.semantic = block, limit, alpha, semantic
        self.floor = np.full(block.n, -np.inf)

    def of(self, batch):
        """(row, query, score, cosine, rank, blended) arrays of a batch; rows are numbers in the batch."""
        keys = zip(*(batch.column(c).to_pylist() for c in ("zoom_threshold", "title", "id")), strict=True)
        nulls_first = [tuple((x is not None, x if x is not None else 0) for x in k) for k in keys]
        place = np.empty(batch.num_rows, np.int64)
        place[sorted(range(batch.num_rows), key=nulls_first.__getitem__)] = np.arange(batch.num_rows)
        block = self.block
        for a, part, score, cosine, ok in judged(block, batch, self.semantic):
            up = np.array(part.column("path_rank").to_pylist(), np.float64)
            rank = np.where(block.asks, 0.0, up[:, None])
            lexical = np.divide(score, block.best, out=np.zeros(score.shape), where=block.best > 0)
            blended = np.maximum(0.0, lexical + self.alpha * np.maximum(cosine, 0.0) + rank)
            ok &= blended >= self.floor
            out = []
            for j in np.flatnonzero(ok.any(axis=0)).tolist():
                some = np.flatnonzero(ok[:, j])
                value = blended[some, j]
                if len(some) > self.limit:
                    kth = np.partition(value, len(value) - self.limit)[-self.limit]
                    self.floor[j] = max(self.floor[j], kth - _NEAR)
                    near = value >= kth - _NEAR
                    some, value = some[near], value[near]
                    order = np.lexsort((place[a + some], -value))  # of equal ones the first by place
                    some, value = some[order], value[order]
                    run = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                    nth = np.arange(len(value)) - np.repeat(run, np.diff(np.append(run, len(value))))
                    some = some[nth < self.limit]
                out.append(np.stack([some, np.full(len(some), j)]))
            if out:
                i, j = np.concatenate(out, axis=1)
                yield a + i, j, score[i, j], cosine[i, j], rank[i, j], blended[i, j]


#: Products of matrices and sums in order differ by less.
_ROUNDING = 1e-9


class Vectors:
    """A block of queries by vector, each with its own id."""

    def __init__(self, ids: list, vectors: list):
        self.n, self.vectors = len(ids), as_vectors(vectors)
        self.own: dict = {}
        for j, x in enumerate(ids):
            self.own.setdefault(x, []).append(j)


class Nearest:
    """Of ever more vectors those that may be among the k of greatest cosine to a query; all that tie with the last are."""

    def __init__(self, block: Vectors, k: int):
        self.block, self.best = block, np.full((k, block.n), -np.inf)

    def of(self, batch):
        """(row, query) arrays of a batch, 8192 pairs at most in each; rows are numbers in the batch."""
        step = max(1, min(4096, _CELLS // max(1, self.block.n)))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            cosine = np.nan_to_num(cosines(part.column("embedding").to_pylist(), self.block.vectors), nan=0.0)
            for i, x in enumerate(part.column("id").to_pylist()):
                if x in self.block.own:
                    cosine[i, self.block.own[x]] = -np.inf
            k = len(self.best)
            every = np.concatenate([self.best, cosine])
            self.best = np.partition(every, len(every) - k, axis=0)[len(every) - k :]
            i, j = np.nonzero((cosine >= self.best.min(axis=0) - _ROUNDING) & (cosine > -np.inf))
            for c in range(0, len(i), 8192):
                yield a + i[c : c + 8192], j[c : c + 8192]


class Kept:
    """The k vectors of greatest cosine to each of n queries, of vectors that come in the order of their ids."""

    def __init__(self, n: int, k: int):
        self.cosine, self.ids = np.full((k, n), -np.inf), np.empty((k, n), object)

    def add(self, ids: list, cosine: np.ndarray, own: dict) -> None:
        """cosine: (ids, queries); own: id -> queries that leave it out."""
        for i, x in enumerate(ids):
            if x in own:
                cosine[i, own[x]] = -np.inf
        k, n = self.cosine.shape
        every = np.concatenate([self.cosine, cosine])
        names = np.empty(len(ids), object)
        names[:] = ids
        at = np.argsort(-every, axis=0, kind="stable")[:k]  # of equal ones those that came first
        new = at >= k
        self.ids = np.where(new, names[np.where(new, at - k, 0)], np.take_along_axis(self.ids, np.where(new, 0, at), 0))
        self.cosine = np.take_along_axis(every, at, 0)

    def rows(self) -> tuple[np.ndarray, list, np.ndarray]:
        """Query numbers, ids and cosines of what was kept."""
        i, j = np.nonzero(self.cosine > -np.inf)
        return j, self.ids[i, j].tolist(), self.cosine[i, j]
