"""Queries opN_<name> over whole tables, with production parameters. Each derives its digest columns from an operator's outputs."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenmark.llm import bpe, decontaminate, langid, lines, periodic, quality, resample, suffix, tokenfile, topk, toxicity, warc
from fenmark.llm.minhash import near_duplicates
from fenmark.session import shared_folder


_words = lambda text: ", ".join(f"'{w}'" for w in text.split())

# an independent way: pieces of text as rows; names are found by their neighbours, slots by joins on places
DECONTAMINATE_SQL = rf"""
    WITH raw AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    cut AS (SELECT kind, id, regexp_extract_all(text, '[\p{{L}}\p{{M}}]+(?:[''\x{{2019}}][\p{{L}}\p{{M}}]+)*|[0-9]+(?:[.,][0-9]+)*|[^\p{{L}}\p{{M}}0-9]') AS ps FROM raw),
    p AS (SELECT kind, id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM cut),
    k AS (SELECT *, regexp_matches(p, '^[\p{{L}}\p{{M}}]') AS w, regexp_matches(p, '^[0-9]') AS n, regexp_matches(p, '^\p{{Lu}}') AND regexp_matches(p, '^(\p{{L}}[''\x{{2019}}])?[\p{{L}}\p{{M}}]*\p{{Ll}}') AS c FROM p),
    f AS (SELECT *, lag(p) OVER o AS p1, lag(c, 2) OVER o AS c2, lag(n) OVER o AS n1, lag(n, 2) OVER o AS n2, lead(n) OVER o AS after_n FROM k WINDOW o AS (PARTITION BY kind, id ORDER BY pos)),
    g AS (SELECT *, sum(CASE WHEN c AND NOT (coalesce(p1, '') = ' ' AND coalesce(c2, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY kind, id ORDER BY pos) AS block, c AND p[1] = upper(p[1]) AND lower(p) IN ({_words(decontaminate.OPENERS)}) AND lower(p[2:]) = p[2:] AS opener FROM f),
    h AS (SELECT *, min(pos) FILTER (c AND NOT opener) OVER (PARTITION BY kind, id, block) AS named_from FROM g),
    r AS (SELECT *, c AND pos >= named_from AS run, count(*) FILTER (c AND pos >= named_from) OVER (PARTITION BY kind, id, block) AS size FROM h),
    t AS (SELECT kind, id, pos, 0 AS z, '<name>' AS t, v FROM (SELECT kind, id, min(pos) AS pos, string_agg(lower(p), ' ' ORDER BY pos) AS v FROM r WHERE run AND size <= 3 GROUP BY kind, id, block)
          UNION ALL SELECT kind, id, pos, 1, CASE WHEN n THEN '<num>' WHEN lower(p) IN ({_words(decontaminate.UNITS)}) AND NOT coalesce(after_n, false) AND (coalesce(n1, false) OR coalesce(p1, '') = ' ' AND coalesce(n2, false)) THEN '<unit>' ELSE lower(p) END, lower(p) FROM r WHERE (w OR n) AND NOT coalesce(run AND size <= 3, false)),
    tok AS (SELECT kind, id, t, v, row_number() OVER (PARTITION BY kind, id ORDER BY pos) - 1 AS place FROM t),
    lists AS (SELECT kind, id, list(t ORDER BY place) AS ts, list(v ORDER BY place) AS vs, bool_and(t[1] = '<') AS bare FROM tok GROUP BY 1, 2),
    win AS (SELECT kind, id, unnest(CASE WHEN len(ts) < 5 OR bare THEN [struct_pack(place := CAST(0 AS BIGINT), w := 'whole ' || array_to_string(vs, ' '), told := true)]
                                       ELSE list_transform(range(0, len(ts) - 4), lambda i: struct_pack(place := i, w := array_to_string(ts[i+1:i+5], ' '), told := len(list_filter(ts[i+1:i+5], lambda x: x[1] <> '<')) > 0)) END, recursive := true) FROM lists),
    sizes AS (SELECT id AS item_id, count(DISTINCT w) AS n_windows FROM win WHERE kind = 'b' AND told GROUP BY 1),
    hits AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id, d.w, b.place AS item_at, d.place - b.place AS shift FROM win d JOIN win b ON d.w = b.w WHERE d.kind = 'd' AND b.kind = 'b' AND b.told),
    held AS (SELECT doc_id, item_id, n_windows, count(DISTINCT w) AS n_matched FROM hits JOIN sizes USING (item_id) GROUP BY ALL HAVING n_matched * 100 >= n_windows * 75),
    lined AS (SELECT doc_id, item_id, shift, count(DISTINCT w) AS n FROM hits SEMI JOIN held USING (doc_id, item_id) GROUP BY ALL),
    best AS (SELECT doc_id, item_id, arg_max(shift, (n, -shift)) AS shift, max(n) AS n_best FROM lined GROUP BY ALL),
    cover AS (SELECT doc_id, item_id, place, arg_max(shift, (n, -shift)) AS shift FROM (SELECT doc_id, item_id, shift, n, unnest(range(item_at, item_at + 5)) AS place FROM hits JOIN lined USING (doc_id, item_id, shift)) GROUP BY ALL),
    slot AS (SELECT doc_id, item_id, c.shift, i.v AS own, d.v AS there FROM cover c JOIN tok i ON i.kind = 'b' AND i.id = item_id AND i.place = c.place JOIN tok d ON d.kind = 'd' AND d.id = doc_id AND d.place = c.place + c.shift JOIN lists l ON l.kind = 'b' AND l.id = item_id WHERE i.t = d.t AND i.t[1] = '<' AND NOT (i.t = '<name>' AND c.place IN (0, len(l.ts) - 1))),
    agree AS (SELECT doc_id, item_id, count(DISTINCT (own, there)) = count(DISTINCT own) AS every, count(DISTINCT (own, there)) FILTER (s.shift = b.shift) = count(DISTINCT own) FILTER (s.shift = b.shift) AS on_best FROM slot s JOIN best b USING (doc_id, item_id) GROUP BY ALL),
    marks AS (SELECT doc_id, item_id, count(*) AS n_slots, count(*) FILTER (i.v <> d.v) AS n_changed FROM best b JOIN tok i ON i.kind = 'b' AND i.id = item_id JOIN tok d ON d.kind = 'd' AND d.id = doc_id AND d.place = i.place + b.shift WHERE i.t[1] = '<' GROUP BY ALL)
    SELECT doc_id, item_id, n_windows, n_matched, CAST(coalesce(n_slots, 0) AS INTEGER) AS n_slots, CAST(coalesce(n_changed, 0) AS INTEGER) AS n_changed
    FROM held JOIN best USING (doc_id, item_id) LEFT JOIN agree USING (doc_id, item_id) LEFT JOIN marks USING (doc_id, item_id)
    WHERE coalesce(every, true) OR n_best * 100 >= n_windows * 75 AND coalesce(on_best, true)"""

# an independent way: lines that share their first or second half are compared place by place
LINES_SQL = """
    WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, line_no, line, lower(trim(line, ' ')) AS t FROM l),
    f AS (SELECT t, min((doc_id, line_no)) AS p FROM n WHERE t <> '' AND doc_id IS NOT NULL GROUP BY 1),
    k AS (SELECT t, p, length(t) AS s, m, unnest(['h' || left(t, m // 2), 't' || right(t, m // 2)]) AS k FROM (SELECT t, p, unnest([length(t), length(t) + 1]) AS m FROM f)),
    c AS (SELECT DISTINCT a.t, a.p, b.t AS u FROM k a JOIN k b ON a.m = b.m AND a.k = b.k AND b.p < a.p AND abs(a.s - b.s) <= 1),
    e AS (SELECT DISTINCT t FROM c WHERE len(list_filter(range(1, greatest(length(t), length(u)) + 1), lambda i:
            CASE WHEN length(t) = length(u) THEN left(t, i - 1) = left(u, i - 1) AND substr(t, i + 1) = substr(u, i + 1)
                 WHEN length(t) > length(u) THEN left(t, i - 1) = left(u, i - 1) AND substr(t, i + 1) = substr(u, i)
                 ELSE left(t, i - 1) = left(u, i - 1) AND substr(t, i) = substr(u, i + 1) END)) > 0),
    d AS (SELECT n.*, f.p IS NOT NULL AND ((n.doc_id, n.line_no) <> f.p OR e.t IS NOT NULL) AS gone FROM n LEFT JOIN f USING (t) LEFT JOIN e USING (t)),
    r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_dropped FROM d GROUP BY 1)
    SELECT doc_id, text, n_lines, n_dropped FROM r UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL"""

# the checksum is made byte by byte for each distinct word, from a table that its polynomial gives
RESAMPLE_SQL = r"""
    WITH texts AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
    w AS (SELECT kind, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
    c AS (SELECT kind, r, w, count(*) AS n FROM w GROUP BY ALL),
    tab AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) x(n)),
    h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM c)),
    k AS (SELECT w, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
    g AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM c JOIN k USING (w) GROUP BY 1),
    whole AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t FROM g),
    gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(g.t, 0) AS DOUBLE) + 1) * (whole.s + 10000) / ((CAST(coalesce(g.s, 0) AS DOUBLE) + 1) * (whole.t + 10000)))) AS BIGINT) AS gain FROM g, whole),
    d AS (SELECT doc_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_features, CAST(coalesce(sum(n * gain), 0) AS BIGINT) AS weight FROM texts LEFT JOIN c USING (kind, r) LEFT JOIN k USING (w) LEFT JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r, doc_id),
    e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d),
    o AS (SELECT *, n_features >= 20 AND score IS NOT NULL AS able FROM e),
    p AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM o)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 10 * n // 100 THEN place END AS rank FROM p"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, _table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # the labelled rows that may be learnt from are cut to the documented bound before they meet the texts
    known = _table(spark, sf_dir, "labels").where("doc_id is not null and toxic in (0, 1)").where(_fold(3) != 1)
    known = known.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id")).limit(toxicity.TRAIN_ROWS)
    model = toxicity.fit(docs.join(F.broadcast(known), "doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where(topk.usable("embedding")).select("vec_id", topk.quantised("embedding").alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang").where(_fold(4) != 2))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=1, buckets=10_000, least_words=20, percent=10, seed="2024")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _repeating(doc_id: int, n: int) -> np.ndarray | None:
    """The periodic tails that the query gives to a tenth of the documents."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(_table(spark, sf_dir, "documents"), least=24, times=3, reorder=_repeating)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfile.round_trip(spark, _table(spark, sf_dir, "documents"), path, shared_folder(spark, "ids"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_minhash_dedup, op3_warc, op4_toxicity, op5_exact_top_k, op6_suffix_dedup, op7_language_id, op8_decontaminate, op9_line_dedup, op10_byte_bpe, op11_resample, op12_periodic_runs, op13_token_file)}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest FROM p),
        m AS (SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
               CASE WHEN page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < target THEN target END AS refers_to
        FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND payload_bytes >= 1000""",
    "op8_decontaminate": DECONTAMINATE_SQL,
    "op11_resample": RESAMPLE_SQL,
    "op9_line_dedup": LINES_SQL,
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
