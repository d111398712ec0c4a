"""Operator 12, runs of repeated words by the linear tandem-repeat method of Gusfield and Stoye, and texts without the repeats.

A run that is long enough makes a string of words recur in its document (see `stretches`), so only stretches of words that such
strings cover are searched; documents without one cost a hash of each word. In a stretch, a suffix tree is built, the blocks of its
Lempel-Ziv factorization give squares that cover the leftmost ones, and walks along suffix links from their places in the tree find
every other square. The places of squares with a primitive root are the leaves below; neighbours merge into runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fenmark.llm.common import BASE, each_batch, flat, mix

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
COLLAPSED = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, collapsed binary"


class Names:
    """Names of the substrings of 2**k symbols at every place: equal where the substrings are equal. Common extensions go down them."""

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        self.levels = [np.append(s + 1, 0)]
        span = 1
        while span < self.n:
            last = self.levels[-1]
            after = np.zeros(self.n + 1, np.int64)
            after[: self.n + 1 - span] = last[span:]
            kinds, made = np.unique(last[: self.n] * (self.n + 2) + after[: self.n], return_inverse=True)
            self.levels.append(np.append(made + 1, 0))
            if len(kinds) == self.n:
                break
            span *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols are the same from i and j on (i != j)."""
        d = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name = self.levels[k]
            d += (name[np.minimum(i + d, self.n)] == name[np.minimum(j + d, self.n)]).astype(np.int64) << k
        return d

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols are the same from i and j back, both included."""
        d = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - d - (1 << k) + 1, j - d - (1 << k) + 1
            d += ((a >= 0) & (b >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
        return d


class SuffixTree:
    """Suffix tree of s, a list of symbols from 1 on, with 0 put at its end; built online, with suffix links."""

    def __init__(self, s: list[int]):
        self.s = s = [*s, 0]
        n, self.width = len(s), max(s) + 1
        width, kids, start, end, link, leaf = self.width, {}, [0], [0], [0], []
        node = edge = length = rest = 0
        for i, c in enumerate(s):
            rest += 1
            last = 0
            while rest:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = kids.get(key)
                if below is None:
                    kids[key] = len(start)
                    at = node
                else:
                    size = min(end[below], i + 1) - start[below]
                    if length >= size:
                        edge, length, node = edge + size, length - size, below
                        continue
                    if s[start[below] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    at = kids[key] = len(start)
                    start.append(start[below])
                    end.append(start[below] + length)
                    link.append(0)
                    start[below] += length
                    kids[at * width + s[start[below]]] = below
                    kids[at * width + c] = len(start)
                leaf.append(len(start))
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = at
                last = at
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.kids, self.link, self.leaf = kids, link, leaf
        self._measure(start, end)

    def _measure(self, start: list[int], end: list[int]) -> None:
        """Parent, depth in symbols, first suffix and the range of leaves (in `order`) of every node."""
        count = len(start)
        keys = np.fromiter(self.kids.keys(), np.int64, len(self.kids)) // self.width
        below = np.fromiter(self.kids.values(), np.int64, len(self.kids))
        parent = np.zeros(count, np.int64)
        parent[below] = keys
        by = below[np.argsort(keys, kind="stable")].tolist()
        edge = np.searchsorted(np.sort(keys), np.arange(count + 1)).tolist()
        self.parent = parent = parent.tolist()
        self.depth, self.low, self.high, suffix = [0] * count, [0] * count, [0] * count, [-1] * count
        for j, v in enumerate(self.leaf):
            suffix[v] = j
        self.first = suffix
        self.order, stack, inner = [], [0], []
        while stack:
            v = stack.pop()
            self.depth[v] = self.depth[parent[v]] + end[v] - start[v]
            self.low[v] = len(self.order)
            if suffix[v] >= 0:
                self.order.append(suffix[v])
            else:
                inner.append(v)
                stack += by[edge[v] : edge[v + 1]]
        for v in self.leaf:
            self.high[v] = self.low[v] + 1
        for v in reversed(inner):
            under = by[edge[v] : edge[v + 1]]
            self.first[v] = min(self.first[u] for u in under)
            self.high[v] = max(self.high[u] for u in under)

    def blocks(self) -> list[int]:
        """Where the blocks of the Lempel-Ziv factorization begin, and the end: a block is the longest that also begins earlier."""
        s, kids, width, first, depth = self.s, self.kids, self.width, self.first, self.depth
        edges, h, n = [0], 0, len(s) - 1
        while h < n:
            node = 0
            while True:
                below = kids[node * width + s[h + depth[node]]]
                if first[below] >= h:
                    break
                node = below
            h += max(1, depth[node])
            edges.append(h)
        return edges


def _covering(edges: np.ndarray, names: Names) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of squares that cover the leftmost squares: those with their middle in a block, found from the block's
    end, and those that cross its beginning, found from there."""
    n = names.n
    h, h1 = edges[:-1], edges[1:]
    h2 = np.append(edges[2:], n)
    size = h1 - h
    k = np.arange(1, size.sum() + 1) - np.repeat(np.cumsum(size) - size, size)
    b = np.repeat(h1, size)
    q = b - k
    k1, k2 = names.forward(b, q), names.backward(b - 1, q - 1)
    ok = (k1 + k2 >= k) & (k1 > 0)
    first = (np.maximum(q - k2, q - k + 1)[ok], k[ok])
    size = h2 - h
    k = np.arange(1, size.sum() + 1) - np.repeat(np.cumsum(size) - size, size)
    b, after = np.repeat(h, size), np.repeat(h1, size)
    q = b + k
    k1, k2 = names.forward(b, q), names.backward(b - 1, q - 1)
    start = np.maximum(b - k2, b - k + 1)
    ok = (k1 + k2 >= k) & (k1 > 0) & (k2 > 0) & (start + k <= after)
    return np.concatenate([first[0], start[ok]]), np.concatenate([first[1], k[ok]])


def _vocabulary(tree: SuffixTree, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every square of the string once: the node at or below its end in the tree, and its half length."""
    s, kids, width, first, depth, parent, link = tree.s, tree.kids, tree.width, tree.first, tree.depth, tree.parent, tree.link
    marked: set[tuple[int, int]] = set()
    order = np.lexsort((-half, start))
    node, at = 0, -1
    for i, k in zip(start[order].tolist(), half[order].tolist(), strict=True):
        if i != at:
            node, at = tree.leaf[i], i
        # up from the leaf, as long as this suffix is the first below
        while depth[parent[node]] >= 2 * k and first[parent[node]] == i:
            node = parent[node]
        if depth[parent[node]] < 2 * k:
            marked.add((node, k))
    for v, k in list(marked):
        while True:
            i, up = first[v], parent[v]
            u = link[up]
            while depth[u] < 2 * k - 1:
                u = kids[u * width + s[i + 1 + depth[u]]]
            if depth[u] == 2 * k - 1:
                v = kids.get(u * width + s[i], -1)
            else:
                v = u if s[first[u] + 2 * k - 1] == s[i] else -1
            if v < 0 or (v, k) in marked:
                break
            marked.add((v, k))
    both = np.array(list(marked), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _smallest_factors(most: int) -> np.ndarray:
    least = np.zeros(most + 1, np.int64)
    for p in range(2, most + 1):
        if p * p > most:
            break
        if not least[p]:
            some = least[p * p :: p]
            some[some == 0] = p
    return np.where(least == 0, np.arange(most + 1), least)


def all_runs(s: np.ndarray) -> np.ndarray:
    """start, length, period of every run (length at least twice the smallest period, in neither direction longer) of a string of
    numbers, as rows sorted by start, then period."""
    none = np.zeros((0, 3), np.int64)
    if len(s) < 2:
        return none
    s = np.unique(s, return_inverse=True)[1]
    names, tree = Names(s), SuffixTree((s + 1).tolist())
    start, half = _covering(np.array(tree.blocks(), np.int64), names)
    node, half = _vocabulary(tree, start, half)
    if not len(half):
        return none
    # squares whose root is a power repeat inside another period's run
    at = np.array(tree.first, np.int64)[node]
    whole, left, factors = np.ones(len(half), bool), half.copy(), _smallest_factors(int(half.max()))
    while (left > 1).any():
        p = factors[left]
        todo = np.flatnonzero(left > 1)
        shift = half[todo] // p[todo]
        whole[todo] &= names.forward(at[todo], at[todo] + shift) < 2 * half[todo] - shift
        left[todo] //= p[todo]
    node, half = node[whole], half[whole]
    low, high = np.array(tree.low, np.int64)[node], np.array(tree.high, np.int64)[node]
    size = high - low
    period = np.repeat(half, size)
    place = np.array(tree.order, np.int64)[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)]
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.r_[True, (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])]
    last = np.r_[np.flatnonzero(new)[1:], len(place)] - 1
    found = np.stack([place[new], place[last] - place[new] + 2 * period[new], period[new]], axis=1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Beginning and end of the stretches that strings of `size` words cover which stand more than once in the stretch.

    A run of length l >= `least` and l >= `times` * period has l - period >= size = least - least / times words in common with itself
    one period on; such strings at both ends cover it, as a period is no longer than half of it. So each run lies in one stretch.
    """
    found, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        m = b - a - size + 1
        if m < 2:
            continue
        h = mix(ids[a:b].astype(np.uint64) + np.uint64(1))
        acc, step = np.zeros(m, np.uint64), np.uint64(BASE)
        for j in range(size):
            acc = acc * step + h[j : j + m]
        order = np.argsort(acc, kind="stable")
        same = acc[order][1:] == acc[order][:-1]
        again = np.zeros(m, bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        edges = np.zeros(b - a + 1, np.int64)
        edges[np.flatnonzero(again)] += 1
        edges[np.flatnonzero(again) + size] -= 1
        inside = np.diff(np.r_[0, (np.cumsum(edges)[:-1] > 0).astype(np.int64), 0])
        parts = list(zip((np.flatnonzero(inside > 0) + a).tolist(), (np.flatnonzero(inside < 0) + a).tolist(), strict=True))
        if parts == [(a, b)]:
            found.append((a, b))
        else:
            todo += parts
    return sorted(found)


def find_runs(ids: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows of all_runs() of length >= max(least, times * period), times >= 2."""
    parts = []
    for a, b in stretches(ids, least - least // times):
        runs = all_runs(ids[a:b])
        runs = runs[runs[:, 1] >= np.maximum(least, times * runs[:, 2])]
        runs[:, 0] += a
        parts.append(runs)
    return np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def collapse(documents: DataFrame, least: int = 24, times: int = 3, reorder: Callable[[int, int], np.ndarray | None] | None = None) -> DataFrame:
    """COLLAPSED for each row of documents (doc_id long, text): n_words, the runs by start, then period, the run of greatest exact
    length / period (ties: smallest start, then period; null if there is none), and the words that stay, joined by one space.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, numbered from 0. A run is a stretch of words whose smallest period is `period`,
    with a length of at least least and times * period (times >= 2), which no neighbouring word extends. Of each run all words after
    its first `period` go. reorder(doc_id, n) may give the numbers of the words that are to stand at places 0 to n - 1 (None: as is).

    Null, empty and blank texts have no words and no runs. Repeated rows give repeated results, a null doc_id stays and is not
    reordered; an empty table gives none. Other columns are ignored. There is no shuffle. A worker needs some 200 bytes for each word
    of its longest text, and 500 more for each word in stretches that recur.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = flat(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        step = 256
        for at in range(0, batch.num_rows, step):
            end = min(at + step, batch.num_rows)
            counts, runs, best, kept = [], [], [], []
            for i in range(at, end):
                words = data[offs[i] : offs[i + 1]].tobytes().split()
                order = reorder(ids[i], len(words)) if reorder and words and ids[i] is not None else None
                if order is not None:
                    words = [words[j] for j in order.tolist()]
                n, found = len(words), np.zeros((0, 3), np.int64)
                if n >= least:
                    found = find_runs(np.fromiter(map(_Ids().__getitem__, words), np.int64, n), least, times)
                rows = found.tolist()
                counts.append(n)
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in rows])
                best.append(min(runs[-1], key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"])) if rows else None)
                if rows:
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, found[:, 0] + found[:, 2], 1)
                    np.add.at(edges, found[:, 0] + found[:, 1], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edges)[:n] == 0).tolist()]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at:end], pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    return documents.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(each_batch(run), COLLAPSED)
