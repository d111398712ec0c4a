"""Operator 8, benchmark decontamination by templates. DataFrame functions only.

Numbers, names and units become typed placeholders. Windows of five template tokens are hashed and joined with those of the
benchmark items. A document that has at least 75 % of an item's windows holds the item, unless the values in its slots contradict
each other: one value of the item that stands in several slots must have become one value in the document too. Only slots in
windows that matched count for this, each at the shift of its own window. A name at the item's very beginning or end does not, as it
may run into a name of the text around it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import Scratch, salted_join

WINDOW = 5
LEAST_SHARE = 75

#: Unit words that may follow a number.
UNITS = "km cm mm kg mg lb oz ml kb mb gb mph kph hours hour minutes minute seconds second days day years year miles mile feet foot inches inch metres meters metre meter grams gram litres liters litre liter percent dollars dollar euros euro pounds pound degrees degree"
#: Words that open sentences and are no names, though capitalised there.
OPENERS = "a an the this that these those it he she they we you i in on at to of for from by with and but or if when while as after before what which who how why where there here one two all some each every many most is are was were do does did can could not no so then given find let calculate compute write read choose der die das ein eine er sie es wir ich und aber wenn wie was wo wer nicht mit von im am es auf zu bei nach le la les un une des il elle nous vous je et mais si quand dans de du en par pour sur avec el los las una unos unas y pero cuando donde en como"

LETTERS = r"[\p{L}\p{M}]"
WORD = rf"{LETTERS}++(?:['\u2019]{LETTERS}++)*+"
NUMBER = r"[0-9]++(?:[.,][0-9]++)*+"
#: A word with a capital first and a small letter in it, after a single letter and an apostrophe at the latest.
CAPITALISED = rf"(?=\p{{Lu}})(?=(?:\p{{L}}['\u2019])?{LETTERS}*\p{{Ll}}){WORD}"
OPENER = rf"(?:{'|'.join(w.capitalize() for w in OPENERS.split())})(?!['\u2019]?{LETTERS})"
# a capital is looked for first, as most places have none
NAME = rf"(?=\p{{Lu}})(?<!{LETTERS})(?<!{LETTERS}['\u2019])(?!{OPENER}){CAPITALISED}(?: {CAPITALISED})*+"
#: Marks before a name and a unit, and after a name.
NAME_MARK, NAME_END, UNIT_MARK = "\x02", "\x03", "\x04"
NAME_WORDS = 3


def _values(text: str) -> Column:
    """The tokens of a text, lower-cased: words, numbers with their decimals, names of up to NAME_WORDS words as one token behind
    NAME_MARK, and units behind UNIT_MARK.

    A name is a run of capitalised words that does not begin with a usual sentence opener. Longer runs are headlines: plain words.
    Nouns that a language capitalises count as names, in items and documents alike.
    """
    # translating costs much for each character, and next to no text has the marks
    marks = [NAME_MARK, NAME_END, UNIT_MARK]
    clean = F.when(reduce(or_, [F.contains(F.col(text), F.lit(m)) for m in marks]), F.translate(text, "".join(marks), "   ")).otherwise(F.col(text))
    named = F.regexp_replace(clean, NAME, f"{NAME_MARK}$0{NAME_END}")
    named = F.regexp_replace(named, f"{NAME_MARK}([^{NAME_END} ]++(?: [^{NAME_END} ]++){{{NAME_WORDS},}}+){NAME_END}", "$1")
    marked = F.regexp_replace(F.lower(named), rf"([0-9]) ?({'|'.join(UNITS.split())})(?!['\u2019]?[\p{{L}}\p{{M}}0-9])", f"$1 {UNIT_MARK}$2")
    return F.regexp_extract_all(marked, F.lit(f"{NAME_MARK}[^{NAME_END}]*+|{UNIT_MARK}?{WORD}|{NUMBER}"), F.lit(0))


def _template(values: str) -> Column:
    """Placeholders in the values' place; words stay. Marks and digits come before all letters."""
    return F.transform(values, lambda t: F.when(t < NAME_END, "<name>").when(t < "\x05", "<unit>").when(t < ":", "<num>").otherwise(t))


def _is_slot(t: Column) -> Column:
    return t < "="  # placeholders begin with <


def _windows(tokens: str, values: str) -> Column:
    """Hash of each run of WINDOW tokens. A text of fewer tokens, or of placeholders alone, has its values as a whole as one."""
    n = F.size(tokens)
    run = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(tokens), i + j) for j in range(WINDOW)]))
    whole = (n < WINDOW) | ~F.exists(tokens, lambda t: ~_is_slot(t))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(whole, F.array(F.xxhash64(F.lit("whole"), F.array_join(F.col(values), " ")))).otherwise(run)


def _consistent(slots: Column) -> Column:
    """Whether each value of the item has become one value of the document (doc_values)."""
    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(s["own"].alias("own"), F.get("doc_values", s["at"]).alias("there"))))
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["own"])))


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots, n_changed, for each item (item_id, text) that a document (doc_id, text) holds.

    n_windows: the item's windows with a word among their tokens; n_slots: placeholders of the item on the best alignment; n_changed:
    those with another value in the document. Null and empty texts hold nothing and are held by nothing, nor are rows with null ids;
    an empty table on either side gives no rows. Repeated ids count as one text with the windows of all; rows come once. An item of
    fewer than WINDOW tokens, or without words, is held by a document with the same tokens as a whole. Other columns are ignored.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", _values("text").alias("values")).select("item_id", "values", _template("values").alias("tokens"))
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    with Scratch(documents.sparkSession) as scratch:
        items = scratch.keep(scratch.table(items.where(F.size("tokens") > 0)))
        runs = items.select("item_id", "tokens", F.posexplode(_windows("tokens", "values")).alias("item_at", "w"))
        # runs of placeholders tell nothing of an item
        told = (F.size("tokens") < WINDOW) | F.exists(F.slice("tokens", F.col("item_at") + 1, WINDOW), lambda t: ~_is_slot(t)) | ~F.exists("tokens", lambda t: ~_is_slot(t))
        item_windows = scratch.table(runs.where(told).select("item_id", "item_at", "w"))
        sizes = item_windows.groupBy("item_id").agg(F.countDistinct("w").alias("n_windows"))
        wanted = scratch.table(item_windows.select("item_id", "w").distinct())

        read = docs.select("doc_id", _values("text").alias("values")).select("doc_id", "values", _template("values").alias("tokens"))
        windows = read.select("doc_id", F.explode(F.array_distinct(_windows("tokens", "values"))).alias("w"))
        # the benchmark does not grow with the documents; beyond the checked size the windows are shuffled, common ones salted
        met = windows.join(F.broadcast(wanted), "w") if scratch.is_small(wanted) else salted_join(windows, wanted, ["w"], F.col("doc_id"))
        shares = met.groupBy("doc_id", "item_id").agg(F.countDistinct("w").alias("n_matched"))
        held = shares.join(sizes, "item_id").where(F.col("n_matched") * 100 >= F.col("n_windows") * LEAST_SHARE)
        held = scratch.table(held)

        # places are looked at in the few documents that may hold an item
        ids = scratch.table(held.select("doc_id").distinct())
        texts = docs.join(scratch.small(ids), "doc_id").select("doc_id", _values("text").alias("doc_values")).select("doc_id", "doc_values", _template("doc_values").alias("doc_tokens"))
        texts = scratch.keep(scratch.table(texts))
        places = texts.select("doc_id", F.posexplode(_windows("doc_tokens", "doc_values")).alias("at", "w"))
        hits = places.join(scratch.small(item_windows), "w").join(scratch.small(held).select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")
        hits = scratch.table(hits.select("doc_id", "item_id", "item_at", "w", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
        # the alignment with the most windows, the earliest of those that tie
        lined = hits.groupBy("doc_id", "item_id", "shift").agg(F.countDistinct("w").alias("n"))
        best = lined.groupBy("doc_id", "item_id").agg(F.max(F.struct("n", -F.col("shift"))).alias("b")).select("doc_id", "item_id", (-F.col("b.col2")).alias("shift"), F.col("b.n").alias("n_best"))
        held = scratch.keep(scratch.table(held.join(best, ["doc_id", "item_id"])))
        # places of the item in matched windows; of a place's windows the one on the alignment with the most windows gives the shift
        own = hits.select("doc_id", "item_id", "item_at", "shift").distinct().join(lined, ["doc_id", "item_id", "shift"])
        own = own.select("doc_id", "item_id", "shift", "n", F.explode(F.sequence(F.col("item_at"), F.col("item_at") + (WINDOW - 1))).alias("place"))
        own = own.groupBy("doc_id", "item_id", "place").agg(F.max(F.struct("n", -F.col("shift"))).alias("b")).select("doc_id", "item_id", F.struct("place", (-F.col("b.col2")).alias("shift")).alias("e"))
        own = scratch.keep(scratch.table(own.groupBy("doc_id", "item_id").agg(F.map_from_entries(F.collect_list("e")).alias("shifts"))))

        pairs = held.join(own, ["doc_id", "item_id"]).join(texts, "doc_id").join(items, "item_id")
        slots = F.filter(
            F.transform("tokens", lambda t, i: F.struct(t.alias("t"), F.get("values", i).alias("own"), F.get("doc_values", i + F.col("shift").cast("int")).alias("there"))),
            lambda s: _is_slot(s["t"]) & s["there"].isNotNull(),
        )
        covered = F.filter(
            F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("place"), F.get("values", i).alias("own"), F.col("shifts")[i].alias("shift"), (i + F.col("shifts")[i]).cast("int").alias("at"))),
            lambda s: _is_slot(s["t"]) & (F.get("doc_tokens", s["at"]) == s["t"]) & ~((s["t"] == "<name>") & s["place"].isin(F.lit(0), F.size("tokens") - 1)),
        )
        slots = pairs.select("doc_id", "item_id", "n_windows", "n_matched", "n_best", "shift", "doc_values", slots.alias("slots"), covered.alias("covered"))
        # a share of windows that suffices must agree: those of the best alignment, or all that matched
        whole = F.col("n_best") * 100 >= F.col("n_windows") * LEAST_SHARE
        on_best = F.filter("covered", lambda s: s["shift"] == F.col("shift"))
        checked = slots.where(_consistent(F.col("covered")) | (whole & _consistent(on_best)))
        changed = F.size(F.filter("slots", lambda s: s["own"] != s["there"]))
        return checked.select("doc_id", "item_id", F.col("n_windows").cast("long"), F.col("n_matched").cast("long"), F.size("slots").alias("n_slots"), changed.alias("n_changed")).distinct()
