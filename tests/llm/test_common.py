import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fenmark.llm import common
from fenmark.llm.common import Scratch, flat, words


def plain(text):
    return [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)]


@pytest.mark.parametrize("block", [7, 64, 1 << 18])
def test_words_do_not_depend_on_blocks(monkeypatch, block):
    r = random.Random(1)
    texts = ["".join(r.choice("aB  \n\té") for _ in range(r.randrange(60))) for _ in range(40)] + [None, "", "x" * 200, "y" * 20, " ", "Ab ab aB"]
    data, offs = flat(pa.array(texts))
    want = words(data, offs)
    monkeypatch.setattr(common, "BLOCK", block)
    common.powers.cache_clear()
    got = words(data, offs)
    monkeypatch.undo()
    common.powers.cache_clear()
    assert all((a == b).all() for a, b in zip(got, want, strict=True))
    spans = [(i, a, b) for i, t in enumerate(texts) for a, b in plain((t or "").encode())]
    assert [(i, int(a - offs[i]), int(b - offs[i])) for i, a, b in zip(got[1], got[2], got[3], strict=True)] == spans
    named = {}
    for h, (i, a, b) in zip(got[0].tolist(), spans, strict=True):
        named.setdefault(re.sub(b"[A-Z]", lambda m: m[0].lower(), (texts[i] or "").encode()[a:b]), set()).add(h)
    assert all(len(v) == 1 for v in named.values()) and len({*map(min, named.values())}) == len(named)


def test_a_table_is_small_by_its_rows_too(spark, monkeypatch):
    with Scratch(spark) as s:
        one, text = s.table(spark.range(1000).selectExpr("0L AS a")), s.table(spark.range(1000).selectExpr("repeat('x', 100) AS t", "array(1, 2) AS b"))
        assert s.is_small(one) and s.is_small(text)
        monkeypatch.setattr(common, "SMALL_ROWS", 100_000)
        assert s.is_small(one) and not s.is_small(text)
        assert s.is_small(s.table(spark.range(0).selectExpr("'x' AS t")))


def test_hash_of_a_word_is_its_polynomial():
    data, offs = flat(pa.array(["abc"]))
    value = sum(int(common.BYTE_CODES[x]) * pow(common.BASE, j, 1 << 64) for j, x in enumerate(b"abc")) % (1 << 64)
    assert words(data, offs)[0][0] == common.mix(np.array([(value + 3) % (1 << 64)], np.uint64))[0]
