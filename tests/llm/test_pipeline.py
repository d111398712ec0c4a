import hashlib
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from fenmark.llm import bpe
from tests.llm.test_minhash import brute


def test_stages_drop_what_they_should_and_keep_the_rest(spark, tmp_path):
    r = random.Random(12)
    vocabulary = {"en": "the and of that with house river stone wind bread table".split(), "de": "der die und nicht haus fluss stein wind brot tisch".split()}
    line = lambda lang, n=12: " ".join(r.choice(vocabulary[lang]) + str(r.randrange(10**6)) for _ in range(n))
    rows = [(i, "\n".join(line(lang) for _ in range(6)), lang) for i in range(40) for lang in ["en" if i % 2 else "de"]]
    item = " ".join(f"quiz{chr(97 + i)}x" for i in range(20))
    first = rows[1][1]
    rows += [
        (100, None, "en"),  # no language
        (101, "123 456", None),
        (102, first, "en"),  # all lines repeat
        (103, line("en") + "\n" + first.split("\n")[0] + "\n" + line("en"), "en"),  # one line repeats
        (104, "intro words here " + item + " outro", "en"),  # holds a benchmark item
    ]
    base = line("en", 300).split()
    rows += [(105, " ".join(base), "en"), (106, " ".join([*base[:150], "other", *base[151:]]), "en")]  # near copies
    rows += [(None, " ".join([*base[:20], "other", *base[21:]]), "en"), (None, "some intro here " + item + " end", "en")]  # a near copy and an item without an id
    rows += [(107, " ".join(base[100:290][::-1]), "en")] * 2  # equal rows
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or ""), 7) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {x.doc_id: x for x in found}
    assert set(got) == set(range(40)) | {103, 105, 107} and len(found) == len(got)
    texts = {d: t for d, t, _ in rows}
    kept = texts[103].split("\n")
    texts[103] = "\n".join([kept[0], kept[2]])
    # what is left has no near copies, by brute force
    assert all(v[2] for v in brute([(d, texts[d]) for d in got]).values())
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for d, x in got.items():
        ids = other.encode_ordinary(texts[d])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_empty_tables_and_rows_without_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "some item of a benchmark")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, spark.createDataFrame([], schema), str(tmp_path))
        assert out.count() == 0 and (name == "tokens" or out.columns == corpus_pipeline.COLUMNS)
    r = random.Random(3)
    text = lambda n: " ".join(str(r.randrange(10**7)) for _ in range(n))
    one, two = text(60), text(50)
    rows = [(None, one, "en", "s", 1), (None, one, "en", "s", 1), (None, two, "en", "s", 1), (4, two, "en", "s", 1), (4, text(9), "en", "s", 1), (5, None, None, None, None)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert sorted((x.doc_id or 0, x.text or "") for x in got) == sorted([(0, one), (4, two), (4, rows[4][1]), (5, "")])
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows[2:4], schema), str(tmp_path)).collect()
    assert [(x.doc_id, x.text) for x in got] == [(4, two)]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokens"]
