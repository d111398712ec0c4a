"""Operator 9, line dedup by a deletion-neighbourhood join. DataFrame functions only.

A line is dropped if an earlier line (by doc_id, then line number) is equal or within one edit (a character replaced, added or
left out), after trimming spaces and lower-casing. Variants with one character deleted are emitted as hashed keys and equal
variants meet: lines that agree without their i-th character differ by a replacement there; a line equal to another's variant
differs by that character. So each group needs its earliest line only, never its pairs.

Emitting L variants of each line of L characters is too much for all lines. Two exact filters come first, by the same deletions at
block level: lines within one edit agree on all but one of m blocks (blocks before it counted from the start, those after it from
the end). Lines that share no such key with another line, first with 2 and then with 16 blocks, have no neighbour. Equal lines are those whose
128 bits of MD5 are equal; what one edit tells apart is verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import Scratch, salted_join

BLOCKS = (2, 16)
#: Characters of a piece. A variant is told by the hashes of whole pieces before and after its place and by the few characters between.
PIECE = 64


def _norm(line: str) -> Column:
    return F.lower(F.trim(line))


def _block_keys(text: str, m: int) -> Column:
    """A key for each block left out, for pairs whose longer line has this length and for pairs whose longer line has one more."""
    size = F.length(text)
    keys = []
    for longer in (size, size + 1):
        for j in range(m):
            head = F.floor(longer * j / m).cast("int")
            tail = F.floor(longer * (m - 1 - j) / m).cast("int")
            keys.append(F.xxhash64(F.lit(m * 100 + j), longer, F.substring(F.col(text), F.lit(1), head), F.substring(F.col(text), size - tail + 1, tail)))
    return F.array(*keys)


def _shared(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """h of those rows (h, keys) that have a key in common with another h."""
    each = rows.select("h", F.explode("keys").alias("key"))
    shared = scratch.table(each.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select("key"))
    return scratch.table(salted_join(each, scratch.small(shared), ["key"], F.col("h")).select("h").distinct())


def _without(text: str, i: str) -> Column:
    """text without its character number i, or as it is where i is -1."""
    t, n = F.col(text), F.col(i)
    return F.when(n < 0, t).otherwise(F.concat(F.substring(t, F.lit(1), n), F.substring(t, n + 2, F.length(t))))


def _variants(lines: DataFrame) -> DataFrame:
    """(h, place, i, v) of lines (h, place, t): for each character i, v tells the line without it; with i = -1 come the names that the
    line itself has as another one's variant. Equal v stands for equal texts.

    A text is named for each place by its length, the pieces before the place (counted from the start), the pieces after it (from the
    end), and what is between, fewer than two pieces. So the cost is that of PIECE characters for each character, however long the
    line is.
    """
    size, pattern, none = F.length("t"), F.lit(f"(?s).{{1,{PIECE}}}"), F.array(F.lit(0).cast("long"))

    def chained(parts: Column) -> Column:
        return F.aggregate(parts, none, lambda known, x: F.array_append(known, F.xxhash64(F.element_at(known, -1), x)))

    cut = lines.select("h", "place", size.alias("n"), F.regexp_extract_all("t", pattern, F.lit(0)).alias("parts"), F.regexp_extract_all(F.substring("t", size % PIECE + 1, size), pattern, F.lit(0)).alias("last"))
    cut = cut.select("h", "place", "n", F.concat("parts", F.array(F.lit(""))).alias("parts"), chained(F.col("parts")).alias("before"), chained(F.reverse("last")).alias("after"))

    def piece(x: Column, j: Column) -> Column:
        q = F.floor((F.col("n") - j * PIECE) / PIECE).cast("int")
        return F.struct(j.alias("j"), F.concat(x, F.coalesce(F.get("parts", j + 1), F.lit(""))).alias("text"), F.get("before", j).alias("before"), q.alias("q"), F.get("after", q).alias("near"), F.get("after", q - 1).alias("far"))

    each = cut.select("h", "place", "n", F.explode(F.transform("parts", piece)).alias("p")).select("h", "place", "n", "p.*")
    # x = -2, -1: the line itself, up to the nearer and the farther whole piece after this place
    each = each.withColumn("x", F.explode(F.sequence(F.lit(-2), F.least(F.lit(PIECE), F.col("n") - F.col("j") * PIECE) - 1)))
    x, start = F.col("x"), F.col("j") * PIECE
    there = F.when(x == -2, F.col("q")).when(x == -1, F.col("q") - 1).otherwise(F.floor((F.col("n") - 1 - start - x) / PIECE)).cast("int")
    each = each.withColumn("to", there).where("to >= 0")
    between = F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("to") * PIECE - start)
    rest = F.when(x < 0, between).otherwise(F.concat(F.substring(between, F.lit(1), x), F.substring(between, x + 2, F.lit(2 * PIECE))))
    after = F.when(F.col("to") == F.col("q"), F.col("near")).otherwise(F.col("far"))
    v = F.xxhash64(F.when(x < 0, F.col("n")).otherwise(F.col("n") - 1), "j", "to", "before", after, rest)
    return each.select("h", "place", F.when(x < 0, -1).otherwise(start + x).alias("i"), v.alias("v"))


def duplicate_lines(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, line_no) of the lines to drop, as a table of scratch. Lines that are empty once trimmed take no part."""
    split = documents.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = split.select("doc_id", "line_no", _norm("line").alias("t")).where(F.length("t") > 0).withColumn("h", F.unhex(F.md5("t")))
    place = F.struct("doc_id", "line_no")
    thin = scratch.table(lines.select("doc_id", "line_no", "h", _block_keys("t", BLOCKS[0]).alias("keys")))
    # one row for each distinct line, with its earliest place
    firsts = scratch.table(thin.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys")))
    again = scratch.table(firsts.where("n > 1").select("h", "first"))
    equal = salted_join(thin.select("doc_id", "line_no", "h"), again, ["h"], F.col("doc_id")).where(place != F.col("first"))

    some = _shared(firsts.select("h", "keys"), scratch)
    some = scratch.table(firsts.select("h", "first").join(scratch.small(some), "h").select("h", "first.doc_id", "first.line_no"))
    near = lines.join(scratch.small(some).withColumnRenamed("h", "own"), ["doc_id", "line_no"]).where("h = own").select("h", "doc_id", "line_no", "t").distinct()
    near = scratch.table(near)
    fine = _shared(near.select("h", _block_keys("t", BLOCKS[1]).alias("keys")), scratch)
    near = scratch.table(near.join(scratch.small(fine), "h"))

    variants = scratch.table(_variants(near.select("h", place.alias("place"), "t")))
    at = variants.groupBy("v", "i").agg(F.min("place").alias("p"), F.count(F.lit(1)).alias("n"))
    at = scratch.table(at)
    whole = at.where("i < 0").select("v", F.col("p").alias("whole"))
    cut = at.where("i >= 0").groupBy("v").agg(F.min(F.struct("p", "i")).alias("cut"))
    met = scratch.table(whole.join(cut, "v"))
    # i and at: the characters that line and witness have to lose to be equal, or -1
    replaced = salted_join(variants, at.where("n > 1 and i >= 0").drop("n"), ["v", "i"], F.col("h")).select("h", "place", F.col("p").alias("witness"), "i", F.col("i").alias("at"))
    own = F.col("i") < 0
    added = salted_join(variants, met, ["v"], F.col("h")).select("h", "place", F.when(own, F.col("cut.p")).otherwise(F.col("whole")).alias("witness"), "i", F.when(own, F.col("cut.i")).otherwise(-1).alias("at"))
    pairs = replaced.union(added).where("witness < place").groupBy("h", "witness").agg(F.min(F.struct("i", "at")).alias("lost")).select("h", "witness", "lost.*")
    found = pairs.join(near.select("h", "t"), "h").join(near.select(place.alias("witness"), F.col("t").alias("w")), "witness")
    found = scratch.table(found.where(_without("t", "i") == _without("w", "at")).select("h").distinct())
    # the earliest of the equal lines goes too; the others went already
    edited = found.join(firsts.select("h", "first"), "h").select("first.doc_id", "first.line_no")
    return scratch.table(equal.select("doc_id", "line_no").union(edited).distinct())


def dedup_lines(documents: DataFrame) -> DataFrame:
    """documents with text without its duplicate lines, n_lines (before) and n_dropped. All rows and other columns are kept.

    A null text stays null, with no lines; an empty text is one empty line. Rows with a null doc_id are left as they are. Lines of
    rows that repeat a doc_id stand at the same place, so equal rows do not drop each other; a line number dropped in one is dropped
    in all. Columns named n_lines or n_dropped are replaced. Empty lines stay. An empty table gives no rows. Memory grows with the
    longest text only as far as Spark's own rows do: a line is one value, and its variants cost the same for each character.
    """
    with Scratch(documents.sparkSession) as scratch:
        drops = duplicate_lines(documents.select("doc_id", "text"), scratch)
        drops = scratch.keep(scratch.table(drops.groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("_drops"))))
        rows = documents.drop("n_lines", "n_dropped").join(scratch.small(drops), "doc_id", "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("_drops", i)), "\n")
    kept = rows.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), "n_dropped": F.coalesce(F.size("_drops"), F.lit(0))})
    kept = kept.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    kept = kept.withColumn("text", F.when(F.col("n_dropped") > 0, left).otherwise(F.col("text")))
    return kept.select(*[c for c in documents.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
