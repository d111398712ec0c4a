"""Operator 7, language identification by compression.

Each language has a raw-content Zstandard dictionary made of labelled sample texts. A text is compressed with every dictionary, in
blocks, as a dictionary saves a bounded number of bytes each time; the smallest sum names the language, and the margin to the second
smallest is the score. Narrow margins are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import each_batch

#: The bound of the fitted sample: texts a language, and pieces of each, spread over the whole text, of so many characters.
SAMPLES, PIECES, PIECE_CHARS = 96, 4, 256
LEVEL = 6
MARGIN = 0.004
#: Bytes that are compressed at once.
BLOCK = 16 << 10

LETTER = regex.compile(r"\p{L}")


def _spread(text: str) -> str:
    """PIECES pieces of a text at even distances, its beginning and its end among them; a shorter text whole."""
    gap = (len(text) - PIECE_CHARS) / (PIECES - 1)
    return text if gap < PIECE_CHARS else " ".join(text[int(i * gap) : int(i * gap) + PIECE_CHARS] for i in range(PIECES))


def fit(labelled: DataFrame, samples: int = SAMPLES) -> dict[str, bytes]:
    """A dictionary for each language of labelled (doc_id, text, lang), from pieces of at most `samples` of its texts.

    Rows with a null or empty text, or a null doc_id or lang, are passed over. The choice is by a hash of doc_id: the smallest in
    each of `samples` buckets, so that neither the sample nor its making grows with the input. Of rows that repeat a doc_id each
    different text counts. The commonest language is first.
    """
    rows = labelled.where("doc_id is not null and lang is not null and length(trim(text)) > 0").select("text", "lang", F.xxhash64("doc_id").alias("h"))
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(samples)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h")

    def spread(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.set_column(2, "text", pa.array([_spread(t.as_py().lower()) for t in batch.column("text")], pa.string()))

    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text").mapInArrow(each_batch(spread), "lang string, h long, text string").distinct().collect()
    out: dict[str, list[bytes]] = {r.lang: [] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    for r in sorted(texts, key=lambda r: (r.lang, r.h, r.text)):
        out[r.lang].append(r.text.encode())
    return {lang: b"\n".join(parts) for lang, parts in out.items()}


class Compressors:
    def __init__(self, model: dict[str, bytes]):
        self.langs, self.compress = list(model), []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def classify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(f(b)) for b in blocks) for f in self.compress]
        sizes = sorted((x, i) for i, x in enumerate(sizes))
        best = sizes[0][0]
        return self.langs[sizes[0][1]], 1 - best / sizes[1][0] if len(sizes) > 1 else 1.0


def predict(documents: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """documents with lang_pred, score (0 to 1: the share of bytes saved against the second language) and rejected.

    A null text, or one without a letter, is `und`, with score 0; so is every text if the model is empty. Ties go to the
    commonest of the languages. rejected: `und`, or a score below margin. Columns with these three names are replaced; others are kept.
    Long texts are compressed in blocks, so that a worker holds a text and little more.
    """
    names = ("lang_pred", "score", "rejected")
    rest = documents.drop(*names)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema) + "lang_pred string, score double, rejected boolean"
    sent = documents.sparkSession.sparkContext.broadcast(model)
    made: list[Compressors] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Compressors(sent.value))
        found = [made[0].classify(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
        lang, score = pa.array([x for x, _ in found], pa.string()), [s for _, s in found]
        rejected = pa.array([x == "und" or s < margin for x, s in found])
        yield pa.RecordBatch.from_arrays([*batch.columns, lang, pa.array(score, pa.float64()), rejected], names=[*batch.schema.names, *names])

    return rest.mapInArrow(each_batch(run), schema)
