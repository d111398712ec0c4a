import hashlib
import random
import re

import public_tokenizers
import pytest
import tiktoken

from fenmark.llm import bpe, decontaminate, langid, lines, quality, suffix, topk, toxicity, warc
from fenmark.session import shared_folder

EXTRA = ", h string, cls string, component string"


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema + EXTRA)


def repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                mark[s : s + length] = b"\x01" * length
            seen.add(w)
        runs = re.findall(b"\x01+", bytes(mark))
        out[d] = (len(b), sum(mark), len(runs), bytes(x for x, m in zip(b, mark, strict=True) if not m))
    return out


def test_suffix_removal_equals_brute_force(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abé") for _ in range(3))
    pool = [" ".join(word() for _ in range(r.choice([10, 40, 60]))) for _ in range(6)]
    rows = [(i, "".join(r.choice(pool) if r.random() < 0.5 else word() * r.randrange(1, 9) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(100, "x" * 350), (101, "x" * 99), (102, None), (103, ""), (104, rows[0][1]), (105, "ab" * 200), (106, "y" * 100 + "x" * 100)]
    r.shuffle(rows)
    for hot in (4096, 12, 2):
        monkeypatch.setattr(suffix, "HOT_SEGMENTS", hot)
        got = suffix.remove_repeats(frame(spark, rows, "doc_id long, text string").repartition(3)).collect()
        assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got} == repeats(rows) and len(got) == len(rows)


def test_suffix_edge_tables(spark):
    assert suffix.remove_repeats(frame(spark, [], "doc_id long, text string")).count() == 0
    got = suffix.remove_repeats(frame(spark, [(None, "z" * 300), (1, "q w" * 100)] + [(1, "q w" * 100)], "doc_id long, text string")).collect()
    assert len(got) == 3 and {x.n_removed for x in got if x.doc_id is None} == {0}


def test_suffix_rows_that_repeat_a_doc_id_stay(spark, monkeypatch):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    own, passage, start = text(700), text(150), text(400)
    rows = [(1, own), (2, passage), (3, text(150) + passage + text(150)), (5, start[:250] + text(90))]
    again = [(7, start + text(120)), (7, start + text(200))]  # other texts under one doc_id, alike at one place
    for hot in (4096, 1):
        monkeypatch.setattr(suffix, "HOT_SEGMENTS", hot)
        for parts in (1, 3):
            got = suffix.remove_repeats(frame(spark, (rows + again[:1]) * 3, "doc_id long, text string").repartition(parts)).collect()
            assert {(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got} == {(d, *v) for d, v in repeats(rows + again[:1]).items()} and len(got) == 15
    got = suffix.remove_repeats(frame(spark, again, "doc_id long, text string")).collect()
    assert [x.n_removed for x in got] == [0, 0]


def test_deep_shallow_orders_suffixes():
    import numpy as np

    r = random.Random(1)
    strings = [bytes(r.choices(b"ab", k=r.randrange(0, 120))) for _ in range(300)] + [b"a" * n for n in range(60, 90)] * 2
    group = np.array([i % 4 for i in range(len(strings))])
    order, prefix = suffix.deep_shallow(strings, group)
    assert [(group[i], strings[i]) for i in order] == sorted((group[i], strings[i]) for i in range(len(strings)))
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert prefix[k] == (suffix.common(a, b) if group[order[k - 1]] == group[order[k]] else 0)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcdé ") for _ in range(r.randrange(15, 60))) for _ in range(25)]
    base += ["".join(r.choice("abcdefghijklmné") for _ in range(n)) for n in (*range(1, 31), 1, 2, 2, 3, 3, 4, 5, 6)]

    def edited(s):
        i = r.randrange(len(s))
        return r.choice([s, s.upper(), s[:i] + "z" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "yy" + s[i:], s[:i] + "q" + s[i:], "  " + s])

    rows = [(i, "\n".join(edited(r.choice(base)) for _ in range(r.randrange(1, 8)))) for i in range(80)] + [(200, None), (201, ""), (202, "\n \n"), (None, base[0])]
    got = lines.dedup_lines(frame(spark, rows, "doc_id long, text string")).collect()
    places = [((d, n), x, x.strip(" ").lower()) for d, t in rows if d is not None and t is not None for n, x in enumerate(t.split("\n"))]
    places.sort(key=lambda p: p[0])
    gone = {p for k, (p, _, t) in enumerate(places) if t and any(u and near(t, u) for _, _, u in places[:k])}
    for x in got:
        if x.doc_id is None:
            assert x.text == base[0]
        elif x.text is None:
            assert x.doc_id == 200 and x.n_lines == 0
        else:
            kept = [y for (d, n), y, _ in places if d == x.doc_id and (d, n) not in gone]
            assert x.text == "\n".join(kept) and x.n_dropped == x.n_lines - len(kept)
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"h", "cls"}


def test_line_dedup_edge_tables(spark):
    rows = [(1, "Share this\n\nsome line", 7), (2, " share this \n\nshare thin", 8), (2, " share this \n\nshare thin", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = [(x.doc_id, x.text, x.n_lines, x.n_dropped) for x in lines.dedup_lines(df).collect()]
    assert sorted(got) == [(1, rows[0][1], 3, 0), (2, "", 3, 2), (2, "", 3, 2)]
    assert lines.dedup_lines(df.where("false")).count() == 0


def test_decontamination_catches_other_numbers(spark):
    item = "Tom has 12 apples and buys 12 more at 3 euros each while Anna walks 5 km to the shop today"
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "one two", "x")], "item_id long, text string, doc_id string")
    rows = [
        (1, "Foo bar baz. " + item + " and so on"),
        (2, item.replace("12", "40").replace("3", "9").replace("5", "77").replace("Anna", "Maria")),
        (3, item.replace("12 apples", "40 apples")),  # the two 12s became 40 and 12
        (4, "nothing of the kind is written in this text at all"),
        (5, None),
        (6, ""),
        (7, "One  two"),
    ]
    got = decontaminate.contaminated(frame(spark, rows, "doc_id long, text string"), bench).collect()
    assert sorted((x.doc_id, x.item_id, x.n_changed > 0) for x in got) == [(1, 1, False), (2, 1, True), (7, 3, False)]
    assert decontaminate.contaminated(frame(spark, [], "doc_id long, text string"), bench).count() == 0


def test_decontamination_reads_slots_where_windows_matched(spark):
    item = "they say Tom has 12 apples and then buys quite a lot of green pears from the man at the corner before walking back home where Tom counts 12 again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    head = item[: item.index(" before")] + " before walking back home"
    rows = [
        (1, item.replace("quite a lot", "quite a very lot")),  # a word added between the slots
        (2, item.replace("green pears", "pears")),  # a word left out
        (3, head + " where and 40 of the other things went on for 77 days"),  # the end cut, other text after it
        (4, item.replace("counts 12", "counts 40")),  # contradicts itself
        (5, item.replace("quite a lot", "quite a very lot").replace("12", "31")),
        (6, item.replace("counts 12", "counts 40").replace("quite a lot", "quite a very lot")),
    ]
    got = decontaminate.contaminated(frame(spark, rows, "doc_id long, text string"), bench).collect()
    assert sorted(x.doc_id for x in got) == [1, 2, 3, 5]


def test_decontamination_masks_whole_names(spark):
    item = "When Mary Jane Watson drives 3.5 miles to see Anna McDonald in town. Mary Jane Watson then walks 35 minutes back home with her"
    bench = spark.createDataFrame([(1, item), (2, "12 13 14 15 16 17 18"), (3, "Tom Sawyer")], "item_id long, text string")
    renamed = item.replace("Mary Jane Watson", "Olu Smith").replace("Anna McDonald", "Tom O\u2019Brien")
    rows = [
        (1, item),
        (2, renamed),
        (3, renamed.replace("3.5", "35")),  # two values of the item became one: still each became one value
        (4, item.replace("35 minutes", "3.5 minutes")),
        (5, item.replace("Mary Jane Watson then", "Olu Smith then")),  # one person became two
        (6, item.title()),  # a headline's words are no names
        (7, "5 6 7 8 9 10 11 12 13 14 15 16 17"),  # runs of numbers alone are no windows
        (8, "12 13 14 15 16 17 18"),
        (9, "Huck Finn"),  # a short item is held by its own words only
        (10, "tom Sawyer"),
        (11, "Tom Sawyer"),
        (12, "The day Olu Smith drives 3.5 miles to see Bo in town was sunny. Then she walks 35 minutes."),
    ]
    got = decontaminate.contaminated(frame(spark, rows, "doc_id long, text string"), bench).collect()
    assert sorted((x.doc_id, x.item_id) for x in got) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 2), (11, 3)]
    assert {x.doc_id: x.n_changed for x in got if x.item_id == 1} == {1: 0, 2: 3, 3: 4, 4: 1}


def test_decontamination_of_names_at_an_items_edges(spark):
    item = "Olu counts the nine red boats that lie by the bank and paints them for Olu"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "it was Monday " + item), (2, item + " Smith who came"), (3, item.replace("for Olu", "for Ann"))]
    got = decontaminate.contaminated(frame(spark, rows, "doc_id long, text string"), bench).collect()
    assert sorted(x.doc_id for x in got) == [1, 2, 3]


def test_decontamination_of_repeated_ids_and_other_columns(spark):
    item = "they count nine red boats and seven small houses by the river"
    bench = frame(spark, [(1, item), (1, item), (None, item)], "item_id long, text string")
    rows = [(1, "so " + item), (1, "so " + item), (None, item), (2, item[:30]), (2, item[24:])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, tokens string, n_slots int")
    got = decontaminate.contaminated(df, bench).collect()
    assert [(x.doc_id, x.item_id, x.n_slots) for x in got if x.doc_id == 1] == [(1, 1, 0)] and {x.doc_id for x in got} <= {1, 2}
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0 == decontaminate.contaminated(df.where("false"), bench).count()


def test_bpe_equals_tiktoken_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    signs = [chr(x) for x in [*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0xB2, 0x661, 0x4E00, 0xE9, 0x301, 0x1F600]]
    texts = ["".join(r.choices(signs, k=r.randrange(60))) for _ in range(1500)] + [None, "", "<|endoftext|>", "a" * 3000, "antidisestablishmentarianism " * 50]
    got = bpe.digests(frame(spark, list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()
    for x in got:
        text = texts[x.doc_id] or ""
        ids = other.encode_ordinary(text)
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and x.round_trip
    back = bpe.decode(bpe.encode(frame(spark, list(enumerate(texts)), "doc_id long, text string"), path, public_tokenizers.PATTERN), path)
    assert all(x.text == (texts[x.doc_id] or "") for x in back.collect())
    assert bpe.digests(frame(spark, [], "doc_id long, text string"), path, public_tokenizers.PATTERN).count() == 0
    clash = spark.createDataFrame([(1, "some text", "x")], "doc_id long, text string, ids string")
    assert bpe.encode(clash, path, public_tokenizers.PATTERN).first().ids == other.encode_ordinary("some text")
    table = bpe.PerfectHash(ranks)
    assert sorted(table.ids) == sorted(ranks.values()) and table.get(b"no such token here") == -1


def test_bpe_memo_is_bounded_and_changes_nothing():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    r, one = random.Random(4), bpe.Encoder(ranks)
    few = bpe.Encoder(ranks, 2000)
    words = ["".join(r.choices("abcdef", k=r.randrange(1, 12))) for _ in range(300)] + ["z" * 500]
    for w in words + words[::-1]:
        assert few[w] == one[w] and (one[w] == one.merged(w.encode()) or one[w] == (one.table.get(w.encode()),))
    assert len(few) + len(few.old) < 30 and "z" * 500 not in one


def test_warc_round_trip_and_seek(spark):
    big = "é" * 600
    rows = [(1, "http://a\nb", big), (2, "u", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", big)]
    pages = frame(spark, rows, "page_id long, url string, html string").repartition(3)
    folder = shared_folder(spark, "warc")
    got = {x.page_id: x for x in warc.round_trip(spark, pages, folder).collect()}
    assert len(got) == len(rows)
    assert {k: (x.record_type, x.refers_to) for k, x in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), None: ("response", None)}
    assert all(got[p].payload_bytes == len((h or "").encode()) and got[p].payload_digest == hashlib.sha1((h or "").encode()).hexdigest() for p, _, h in rows)
    from fenmark.llm.common import Scratch

    with Scratch(spark) as s:
        index = s.table(warc.write(warc.classify(pages, s), folder + "2"))
        one = warc.fetch(index.where("page_id = 3"), folder + "2").collect()
        assert [(x.page_id, bytes(x.content)) for x in one] == [(3, big.encode())]
    assert warc.round_trip(spark, frame(spark, [], "page_id long, url string, html string"), shared_folder(spark, "warc")).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    for name in ("FAN", "TILES", "BLOCKS"):
        monkeypatch.setattr(topk, name, 2)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 1)
    r = random.Random(6)
    rows = [(i, [r.choice([0.5, -0.25, 0.1, 1.0]) for _ in range(4)]) for i in range(0, 130)]
    rows += [(500, None), (550, [None, 1.0, 1.0, 1.0]), (600, [float("nan")] * 4), (650, [float("inf")] * 4), (700, rows[3][1])]
    df = frame(spark, rows, "vec_id long, embedding array<float>").repartition(3)
    v = df.where(topk.usable("embedding")).select("vec_id", topk.quantised("embedding").alias("v"))
    got = [tuple(x) for x in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()]
    import numpy as np

    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e in rows if i < 500 or i == 700}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], e, strict=True)), i) for i, e in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0 and topk.top_k(v, v.where("false")).count() == 0
    assert topk.top_k(v.where("false"), v.where("vec_id = 50")).count() == 0


def test_top_k_repeated_candidates_and_large_numbers(spark):
    rows = [(1, [3, 4]), (2, [1, 1]), (2, [1, 1]), (3, [1 << 40, 1]), (4, [7]), (1, [3, 4])]
    v = frame(spark, rows, "vec_id long, v array<long>")
    got = [tuple(x) for x in topk.top_k(v, v.where("vec_id = 1"), 4).select("rank", "vec_id", "score").orderBy("rank").collect()]
    assert got == [(1, 3, 3 * (1 << 40) + 4), (2, 4, 21), (3, 2, 7), (4, 2, 7)]
    big = frame(spark, [(1, [1 << 40]), (2, [1 << 40])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(big, big.where("vec_id = 1")).collect()


WORDS = {"xx": "the and of that with for this".split(), "yy": "der die und nicht ist von mit".split()}


def test_language_id(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices(WORDS[x], k=r.randrange(5, 80))), x) for i in range(120) for x in [r.choice(["xx", "yy"])]]
    rows += [(900, None, "xx"), (901, "12 34 --", "xx"), (902, "", None)]
    df = frame(spark, rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 != 2"))
    got = {x.doc_id: x for x in langid.predict(df, model).collect()}
    held = [x for i, x in got.items() if i < 900 and i % 4 == 2]
    assert sum(x.lang_pred == x.lang for x in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    clash = spark.createDataFrame([(1, "the and of that", "x", 3)], "doc_id long, text string, score string, rejected int")
    assert langid.predict(clash, model).first().lang_pred == "xx" and langid.predict(clash.where("false"), model).count() == 0
    assert langid.fit(df.where("false")) == {} and langid.predict(df.limit(2), {}).count() == 2


def test_language_of_long_texts_is_not_rejected(spark):
    r = random.Random(8)
    words = {x: ["".join(r.choices(letters, k=r.randrange(2, 9))) for _ in range(3000)] for x, letters in (("xx", "abcdefghijklm"), ("yy", "defghijklmnop"))}
    text = lambda x, n: " ".join(r.choices(words[x], k=n))
    model = langid.fit(frame(spark, [(i, text(x, 200), x) for i in range(120) for x in ["xx" if i % 2 else "yy"]], "doc_id long, text string, lang string"))
    rows = [(0, text("xx", 300_000), "xx"), (1, text("yy", 300_000), "yy"), (2, text("xx", 1000), "xx")]
    got = {x.doc_id: x for x in langid.predict(frame(spark, rows, "doc_id long, text string, lang string"), model).collect()}
    assert all(x.lang_pred == x.lang and not x.rejected for x in got.values())
    assert got[0].score > got[2].score / 2


def test_toxicity_ignores_group_mentions(spark):
    r = random.Random(9)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        toxic = int(r.random() < 0.3)
        w = r.choices(plain, k=30)
        if toxic:
            w[r.randrange(30)] = r.choice(["idiot", "idiotic", "scum"])
        if r.random() < (0.6 if toxic else 0.05):  # mentions go with the label, but do not make it
            w.append("women")
        rows.append((i, " ".join(w), toxic))
    rows += [(1000, None, 1), (1001, "x", None)]
    df = frame(spark, rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id % 3 != 1"))
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    held = [(got[i], t) for i, _, t in rows[:600] if i % 3 == 1]
    assert sum((s >= toxicity.CUT) == bool(t) for s, t in held) / len(held) > 0.97
    probe = frame(spark, [(1, "w1 w2 w3"), (2, "w1 w2 w3 women"), (3, "w1 w2 w3 men"), (4, ""), (5, None)], "doc_id long, text string")
    s = {x.doc_id: x.score for x in toxicity.score(probe, model).collect()}
    assert s[2] < 0.5 and abs(s[2] - s[3]) < 0.05 and 0 <= s[4] == s[5] <= 1
    assert toxicity.fit(df.where("false")).bias == -20


def test_quality_model_finds_junk(spark):
    r = random.Random(10)
    good = lambda: " ".join(r.choices(["the", "of", "and", "in", "house", "river", "table", "wind", "stone", "bread"] + [f"v{chr(97 + i)}n" for i in range(26)], k=60)).capitalize() + "."
    junk = lambda: r.choice([" ".join(r.choices(["BUY!!", "NOW!!", "%%%", "$$$", "CLICK###"], k=50)), "| ".join(["spam"] * 60), "###*** %%%" * 20])
    rows = [(i, good() if i % 3 else junk()) for i in range(300)] + [(900, None), (901, "")]
    df = frame(spark, rows, "doc_id long, text string")
    model = quality.fit(df)
    got = {x.doc_id: x for x in quality.score(df, model).collect()}
    assert sum(got[i].kept == bool(i % 3) for i in range(300)) / 300 > 0.97 and len(got) == len(rows)
    assert quality.score(df, quality.fit(df.where("false"))).count() == len(rows)


def test_expectation_maximisation_recovers_accuracies():
    r = random.Random(11)
    acc, counts = [0.9, 0.8, 0.7, 0.6], {}
    for _ in range(20_000):
        good = r.random() < 0.7
        p = "".join("-" if r.random() < 0.2 else str(int(good == (r.random() < a))) for a in acc)
        counts[p] = counts.get(p, 0) + 1
    posterior, found = quality.expectation_maximisation(counts)
    assert [found[i, 1, 1] for i in range(4)] == pytest.approx(acc, abs=0.05) and posterior["1111"] > 0.95 > 0.2 > posterior["0000"]


def test_names_are_looked_for_at_capitals_and_marks_are_spaces(spark):
    assert decontaminate.NAME.startswith(r"(?=\p{Lu})")  # most places have none, and end there
    rows = spark.createDataFrame([("Then Ada Byron ran 5 km",), ("Then\x02Ada Byron\x03ran\x045 km",)], "text string")
    plain, marked = [r.v for r in rows.select(decontaminate._values("text").alias("v")).collect()]
    assert plain == marked == ["then", "\x02ada byron", "ran", "5", "\x04km"]
