import random
import re

import pytest

from fenmark.llm import minhash
from fenmark.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, cls string, component string"


def brute(rows):
    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def families(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, d = [], 0
    for size in (1, 2, 3, 5, 40):
        base = [word() for _ in range(120)]
        for c in range(size):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4, 6]) if c else 0):
                w[r.randrange(len(w))] = word()
            rows.append((d, " ".join(w).title() if c % 2 else "\n".join(w)))
            d += 1
    # a chain: ends differ, neighbours are alike
    w = [word() for _ in range(200)]
    for c in range(8):
        rows.append((d, " ".join(w[c * 10 :] + [word() for _ in range(c * 3)])))
        d += 1
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE  two"), (905, "one two three four five")]


@pytest.mark.parametrize("partners", [8, 1])
def test_against_brute_force(spark, monkeypatch, partners):
    monkeypatch.setattr(minhash, "PARTNERS", partners)
    rows = families()
    got = near_duplicates(spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)
    assert len(got) == len(rows)


def border_families(seed, n=50):
    """Families of documents whose similarities lie closely around 0.75: each replaces some words of a base or of another one."""
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    for _ in range(n):
        docs = [[word() for _ in range(r.randrange(120, 200))]]
        for _ in range(r.randrange(4, 20)):
            w = list(r.choice(docs))
            for at in r.sample(range(len(w)), round(len(w) * r.uniform(0.02, 0.04))):
                w[at] = word()
            docs.append(w)
        rows += [" ".join(w) for w in docs]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_families_at_the_border(spark):
    rows = border_families(5)
    got = near_duplicates(spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def outgrown(seed):
    """A component B of five copies of b, and twelve copies of c that are linked in the tiles only, for documents half like c are the
    hubs of their buckets; then they outnumber B. One pair links the two, b and c: of the words they share all copies lack some."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(400)]
    b, c = shared + [word() for _ in range(65)], shared + [word() for _ in range(65)]

    def changed(w, at, n):
        return w[:at] + [word() for _ in range(n)] + w[at + n :]

    docs = {500: b, 501: c}
    docs |= {400 + k: changed(b, 60 * (k + 1), 1) for k in range(4)}
    docs |= {502 + k: changed(c, 30 * (k + 1), 1) for k in range(11)}
    for d in [*range(200), *range(900, 1100)]:
        docs[d] = c
        for at in r.sample(range(0, 460, 15), 9):
            docs[d] = changed(docs[d], at, 14)
    return [(d, " ".join(w)) for d, w in docs.items()]


def test_largest_component_changes_between_the_passes(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PARTNERS", 1)
    rows = outgrown(20)
    want = brute(rows)
    got = near_duplicates(spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA)).collect()
    assert want[500][1] == want[501][1]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_empty_null_and_repeated(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f", None, None)] * 3 + [(None, "a b c d e f", None, None), (None, None, None, None), (None, "z y", None, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 1, 2, 1)] * 3 + [(True, 0, 0, 0), (True, 0, 1, 0), (True, 0, 2, 1)]
