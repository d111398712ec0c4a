"""Fitted models against their definitions, computed the plain way."""

import math
import random

import numpy as np
import pytest
import zstandard

from fenmark.llm import langid, quality, toxicity


def em_by_rows(rows, rounds):
    """Expectation-maximisation over single documents, as op1 does it over counts of patterns."""
    n = len(rows[0])
    good = [(1 + r.count("1")) / (2 + r.count("1") + r.count("0")) for r in rows]
    for _ in range(rounds):
        prior = min(max(sum(good) / len(rows), 0.01), 0.99)
        acc = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(n)]
        for i in range(n):
            for cls in (0, 1):
                for vote in (0, 1):
                    acc[i][cls][vote] = sum((g if cls else 1 - g) for r, g in zip(rows, good, strict=True) if r[i] == str(vote)) + (8 if vote == cls else 2)
                total = sum(acc[i][cls])
                acc[i][cls] = [x / total for x in acc[i][cls]]
        good = []
        for r in rows:
            p = [1 - prior, prior]
            for i, c in enumerate(r):
                if c != "-":
                    p = [p[0] * acc[i][0][int(c)], p[1] * acc[i][1][int(c)]]
            good.append(p[1] / sum(p))
    return dict(zip(rows, good, strict=True))


def test_quality_posteriors_equal_em_over_documents():
    r = random.Random(3)
    rows = ["".join(r.choice("110-" if r.random() < 0.6 else "001-") for _ in range(5)) for _ in range(150)]
    counts = {p: rows.count(p) for p in rows}
    for rounds in (1, 7):
        got, want = quality.expectation_maximisation(counts, rounds)[0], em_by_rows(rows, rounds)
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)
    assert quality.expectation_maximisation({}) [0] == {}


def test_quality_sparse_values_equal_counts():
    import pyarrow as pa

    from fenmark.llm.common import flat

    texts = ["The the cat!\n1 2", "", "x" * 50, None, "A|B, c-d"]
    data, offs = flat(pa.array(texts))
    row, bucket, value = quality._shares(data, offs)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        words = raw.lower().split()
        held = sorted(v for a, b, v in zip(row, bucket, value, strict=True) if a == i and b < 1 << quality.BITS)
        assert held == pytest.approx(sorted(math.sqrt(words.count(w) / len(words)) for w in set(words)))
        kinds = [sum(65 <= x <= 90 for x in raw), sum(33 <= x <= 47 or x == 124 for x in raw), sum(48 <= x <= 57 for x in raw), raw.count(b"\n")]
        more = [v for a, b, v in zip(row, bucket, value, strict=True) if a == i and b >= 1 << quality.BITS]
        assert more == pytest.approx([k / max(1, len(raw)) for k in kinds] + [min(len(words), 200) / 200, len(set(words)) / max(1, len(words))])


def test_toxicity_minimises_its_loss():
    r = np.random.default_rng(5)
    x, y = (r.random((40, 6)) < 0.4).astype(np.float32), (r.random(40) < 0.4).astype(int)
    change = (r.integers(-1, 2, (9, 6))).astype(np.float32)

    def loss(w, penalty):
        z = x @ w[:6] + w[6]
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        fit = (weight * (np.logaddexp(0, z) - y * z)).sum()
        return fit + toxicity.L2 * (w[:6] ** 2).sum() + penalty * ((change @ w[:6]) ** 2).mean()

    w, b = toxicity._descend(x, y, change)
    at = np.r_[w, b]
    slope = [(loss(at + d, toxicity.PENALTY) - loss(at - d, toxicity.PENALTY)) / 2e-5 for d in np.eye(7) * 1e-5]
    assert np.abs(slope).max() < 2e-3
    free, c = toxicity._descend(x, y, change[:0])
    assert loss(at, toxicity.PENALTY) < loss(np.r_[free, c], toxicity.PENALTY) and ((change @ w) ** 2).mean() < ((change @ free) ** 2).mean()


def test_toxicity_swaps_are_rings():
    for term in toxicity.SWAP:
        seen, t = [], term
        while t not in seen:
            seen.append(t)
            t = toxicity.SWAP[t]
        assert t == term and len(seen) > 1
    assert toxicity.swapped("Women and some Christians met") == "men and some jews met"


def test_language_is_the_smallest_of_plain_sizes(spark):
    r = random.Random(2)
    words = {x: ["".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(300)] for x, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "ijklmnop"))}
    text = lambda x, n: " ".join(r.choices(words[x], k=n))
    rows = [(i, text(x, r.choice([5, 60, 900, 6000])), x) for i in range(60) for x in ["aa", "bb", "cc"][i % 3 : i % 3 + 1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 45"))
    got = {x.doc_id: x for x in langid.predict(df, model).collect()}
    for i, t, _ in rows:
        sizes = {}
        for lang, words_of in model.items():
            c = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(words_of, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = t.lower().encode()
            sizes[lang] = sum(len(c.compress(raw[j : j + langid.BLOCK])) for j in range(0, len(raw), langid.BLOCK))
        first, second = sorted(sizes.values())[:2]
        assert sizes[got[i].lang_pred] == first and got[i].score == pytest.approx(1 - first / second)
        assert got[i].rejected == (got[i].score < langid.MARGIN)


def test_samples_of_a_text_reach_its_end():
    long = "".join(chr(97 + i // 1000) for i in range(10_000))
    got = langid._spread(long)
    assert got[0] == "a" and got[-1] == "j" and len(got) == langid.PIECES * langid.PIECE_CHARS + langid.PIECES - 1
    assert langid._spread("short") == "short" and langid._spread("x" * 1000) == "x" * 1000
