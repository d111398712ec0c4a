import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fenmark.llm import lines, minhash, periodic, resample, tokenfile, topk, warc
from fenmark.llm.queries import _repeating
from fenmark.session import shared_folder

EXTRA = ", h string, n_words string, at string, file string"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema + EXTRA)


# --- importance resampling


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def resampled(rows, target, n, buckets, least, percent, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    mine = [features(t) for _, t in rows]
    s, t = collections.Counter(b for f in mine for b in f), collections.Counter(b for x in target for b in features(x))
    many, much = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (many + buckets) / ((s[b] + 1) * (much + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), f in zip(rows, mine, strict=True):
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words(text)), len(f), weight, score, None])
    able = sorted((o for o in out if o[4] is not None and o[1] >= least), key=lambda o: (-o[4], *o[:4]))
    for k, o in enumerate(able[: percent * len(able) // 100]):
        o[5] = k + 1
    return sorted(map(repr, out))


@pytest.mark.parametrize(("n", "piece", "held"), [(1, 1 << 20, 1 << 26), (3, 40, 1 << 26), (2, 64, 300)])
def test_resampling_equals_brute_force(spark, monkeypatch, n, piece, held):
    monkeypatch.setattr(resample, "PIECE", piece)
    monkeypatch.setattr(resample, "DICTIONARY_BYTES", held)
    r = random.Random(n)
    vocabulary = ["alpha", "Beta", "été", "ÉTÉ", "x1", "7", "naïve", "日本", "o'neil", "a_b", "x-y", "\x7fz"]
    text = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60)))
    rows = [(i, text()) for i in range(80)] + [(900, None), (901, ""), (902, "?!\n"), (None, text()), (3, text()), (3, rows_text := text()), (3, rows_text)]
    target = [text() for _ in range(9)] + [None, ""]
    got = resample.resample(frame(spark, rows).repartition(3), spark.createDataFrame([(t,) for t in target], "passage string"), n=n, buckets=97, least_words=20, percent=30, seed="s", target_text="passage").collect()
    assert sorted(repr(list(x)) for x in got) == resampled(rows, target, n, 97, 20, 30, "s")


def test_a_dictionary_that_begins_anew_knows_no_old_word(monkeypatch):
    """In this process: workers do not see what a test sets, so theirs never got full."""
    monkeypatch.setattr(resample, "PIECE", 64)
    monkeypatch.setattr(resample, "DICTIONARY_BYTES", 2000)
    texts = [" ".join(f"w{i * 7 + j}" for j in range(30)) for i in range(50)]
    known, got, sizes = resample.Dictionary(97), [], []
    for at, _, ids, row in resample._blocks(pa.array(texts), known):
        got += [(at + r, b) for found, of in known.features(ids, row, 2) for b, r in zip(found.tolist(), of.tolist(), strict=True)]
        sizes.append(len(known))
        assert len(known) == len(known.words) == len(known.hashed)
    want = [(i, zlib.crc32(" ".join(w).encode()) % 97) for i, t in enumerate(texts) for n in (1, 2) for w in zip(*[t.split()[k:] for k in range(n)], strict=False)]
    assert sorted(got) == sorted(want) and max(sizes) < 50


def test_resampling_edge_tables(spark):
    none = frame(spark, [])
    assert resample.resample(none, none).count() == 0
    got = resample.resample(frame(spark, [(1, "a " * 30)]), none, percent=100).collect()
    assert [x["rank"] for x in got] == [1]


# --- runs of repeated words


def all_runs(s):
    out, n = [], len(s)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j + p - i >= 2 * p and not any(all(s[x] == s[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, j + p - i, p))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(text, least, times):
    w = (text or "").encode().split()
    runs = [r for r in all_runs(w) if r[1] >= max(least, times * r[2])]
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return len(w), runs, best, b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_equal_brute_force_on_small_strings():
    r = random.Random(7)
    for _ in range(1500):
        s = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randrange(0, 40))]
        if r.random() < 0.5:
            s = s[:5] + s[:4] * r.randrange(1, 9) + s[-6:]
        assert list(map(tuple, periodic.all_runs(np.array(s, np.int64)).tolist())) == all_runs(s), s
    fibonacci = [0], [0, 1]
    for _ in range(9):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert list(map(tuple, periodic.all_runs(np.array(fibonacci[1])).tolist())) == all_runs(fibonacci[1])


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (10, 4)])
def test_collapse_equals_brute_force(spark, least, times):
    r = random.Random(least)
    word = lambda: r.choice(["a", "b", "A", "é", "\x1cq", "z "])
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(0, 6)):
            unit = [word() for _ in range(r.randrange(1, 9))]
            parts += (unit * 9)[: r.randrange(1, 9 * len(unit) + 1)] if r.random() < 0.6 else [f"w{r.randrange(1000)}" for _ in range(r.randrange(1, 30))]
        rows.append((i, r.choice([" ", "\n", " \t\x0b"]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n"), (None, "x " * 50), (5, "y " * 40), (5, "y " * 40)]
    got = periodic.collapse(frame(spark, rows).repartition(3), least, times).collect()
    mine = sorted(repr((x.doc_id, x.n_words, [tuple(q) for q in x.runs], tuple(x.best) if x.best else None, bytes(x.collapsed))) for x in got)
    assert mine == sorted(repr((i, *collapsed(t, least, times))) for i, t in rows)
    assert periodic.collapse(frame(spark, [])).count() == 0


def test_a_long_text_of_one_word_and_planted_tails(spark):
    got = periodic.collapse(frame(spark, [(1, "w " * 50_000), (2, " ".join(f"u{i % 700}" for i in range(40_000)))])).collect()
    assert {(x.doc_id, tuple(x.best), bytes(x.collapsed).count(b" ") + 1) for x in got} == {(1, (0, 50_000, 1), 1), (2, (0, 40_000, 700), 700)}
    for i in range(300):
        order = _repeating(i, 50)
        h = zlib.crc32(str(i).encode())
        if h % 10:
            assert order is None
        else:
            g, a = h // 10, h // 10 % 50
            assert order.tolist() == [j if j < a else a + (j - a) % (1 + (50 - a) // (3 + g % 8)) for j in range(50)]


# --- files of token ids


def test_blocks_hold_any_ids():
    r = np.random.default_rng(1)
    for n in (1, 7, 100, tokenfile.BLOCK_IDS):
        for most in (1, 2, 300, 50_000, 1 << 32):
            ids = r.integers(0, most, (3, n)).astype(np.uint32)
            ids[1, r.integers(0, n)] = (1 << 32) - 1  # an exception
            made = tokenfile.pack(ids)
            content = memoryview(b"".join(made))
            starts = np.cumsum([0, *map(len, made[:-1])]).tolist()
            assert all((a == b).all() for a, b in zip(tokenfile.unpack(content, starts), ids, strict=True))


def test_pieces_are_the_librarys_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    pieces, r = tokenfile.Pieces(path), random.Random(5)
    letters = "ab'sdrelmv T  \n\n\t\r.,!?%0159éÉ×÷ñß \u2028\u3000\x85\u180e\x1c\x1f’“—😀中文١२ı²ªºĸŉ\u0301<|>"
    for _ in range(4000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(0, 20))) + r.choice(["", " we'll", "<|endoftext|>", "  x \n"])
        assert pieces.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_token_files_round_trip(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, r = Tokenizer.from_file(path), random.Random(6)
    text = lambda n: " ".join(r.choice(["the", "Übung", "x", "1999", "\n", "zzyzx", "日本"]) for _ in range(n))
    rows = [(r.randrange(10**9), text(r.randrange(0, 80))) for _ in range(120)] + [(-5, None), (7, ""), (10**12, text(9000)), (8, "a b"), (8, "a b"), (None, "lost"), (None, None)]
    monkeypatch.setattr(tokenfile, "FILE_TEXT", 6000)
    folder = shared_folder(spark, "ids")
    got = tokenfile.round_trip(spark, frame(spark, rows).repartition(4), path, folder).collect()
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    want = collections.Counter((i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows)
    assert collections.Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    at = 0
    for x in sorted(got, key=lambda x: x.start):
        assert x.start == at
        at += x.n_tokens
    order = [x.doc_id for x in sorted(got, key=lambda x: x.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    # parts of a file, and damage
    content = max((bytes(x.content) for x in spark.read.format("binaryFile").load(folder).collect()), key=len)
    file, starts, doc_id, null, ends = tokenfile.read_index(memoryview(content))
    whole = np.concatenate(tokenfile.unpack(memoryview(content), starts.tolist()))
    assert len(starts) > 1 and (tokenfile.ids_between(memoryview(content), 4000, 4200) == whole[4000:4200]).all() and len(tokenfile.ids_between(memoryview(content), 5, 5)) == 0
    with pytest.raises(ValueError, match="whole"):
        tokenfile.read_index(memoryview(content[:-3]))
    assert tokenfile.round_trip(spark, frame(spark, []), path, shared_folder(spark, "ids")).count() == 0


# --- cases of the earlier operators


def test_extreme_components_are_an_error_and_large_ones_exact(spark):
    rows = [(1, [-8388608.5]), (2, [1.0]), (3, [3.0])]
    v = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.quantised("e").alias("v"))
    got = {(x.query_id, x.vec_id): x.score for x in topk.top_k(v, v, 5).collect()}
    assert got[1, 2] == math.floor(-8388608.5 * 256) * 256 and got[2, 3] == 768 * 256
    bad = spark.createDataFrame([(1, [-1e300, 1.0])], "vec_id long, e array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        bad.select(topk.quantised("e").alias("v")).collect()


def test_long_lines_differ_by_one_character(spark):
    r = random.Random(8)
    line = "".join(r.choice("abcdefé ") for _ in range(20_000)).strip()
    others = [line[:7000] + "Z" + line[7001:], line[:12_000] + line[12_001:], line + "q", "w" + line, line[1:], line[:-1]]
    rows = [(0, line)] + [(i + 1, x) for i, x in enumerate(others)] + [(50, line[:100] + "??" + line[102:]), (51, "u" * 3000), (52, "u" * 3001), (53, "v" * 64), (54, "v" * 63), (55, "v" * 66)]
    got = {x.doc_id: x.n_dropped for x in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {0: 0, **{i + 1: 1 for i in range(6)}, 50: 0, 51: 0, 52: 1, 53: 0, 54: 1, 55: 0}


def test_names_of_sets_have_128_bits():
    a, b = minhash._class(np.array([1, 2], np.uint64)), minhash._class(np.array([1, 3], np.uint64))
    assert len(a) == 16 and a[:8] != b[:8] and a[8:] != b[8:]


def test_folders_of_object_stores(monkeypatch):
    class Stub:  # the real one asks the store for its region
        class FileSystem:
            from_uri = staticmethod(lambda uri: ("fs", uri))

    monkeypatch.setattr(warc, "pafs", Stub)
    assert [warc.store(u)[1] for u in ("s3a://b/x", "s3n://b/x", "s3://b/x", "file:///s3a://x")] == ["s3://b/x", "s3://b/x", "s3://b/x", "file:///s3a://x"]
