"""Operator 6, exact removal of repeated 100-byte strings by sorting suffixes, deep-shallow.

Each 100-byte string has an anchor: its k-byte piece of least hash (the leftmost of those that tie), which depends on the string
alone. Runs of strings with one anchor form a segment, about 3 in 100 bytes of text, so only suffixes at anchors are sorted. Equal
segments are settled by fingerprints. Where an anchor piece occurs in different segments, the segments' bytes after the anchor and,
reversed, before it are sorted: multikey quicksort to a shallow depth, blind tries for groups that still tie. Common prefixes of
neighbours in both orders tell which of the segments' strings are equal. Groups that are too large for one task are split by the
next bytes first: strings that begin at like distances before the anchor share the bytes around it. What is too large after that
is one string at one distance in very many segments, up to a few bytes; there each string is named by its bytes, and its first place
is an aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm.common import BASE, BYTE_CODES, Scratch, chunks, each_batch, mix, signed

LENGTH = 100
PIECE = 32
SPAN = LENGTH - PIECE + 1
#: Bytes of text that are looked at together; equal segments among them are settled before the shuffle.
CHUNK = 4 << 20
#: Words of 8 bytes that the shallow sort looks at.
SHALLOW = 6
#: Segments that one task sorts at once; larger groups are split into strings of STEP neighbouring distances.
HOT_SEGMENTS = 4096
STEP = 9
BLOCK_ROWS = 30_000

ANCHORS = "key long, ctx long, doc_id long, pos long, before int, runs int"


def segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, anchor, first start and last start of each segment of a chunk, with hashes of its piece and of all its bytes."""
    n = len(data)
    none = np.zeros(0, np.int64)
    sizes = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    if not sizes.sum():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    # polynomials of 32 and of 64 bytes from each place on, by doubling
    value, width = BYTE_CODES[data], 1
    while width < PIECE:
        value = value[:-width] + value[width:] * np.uint64(pow(BASE, width, 1 << 64))
        width *= 2
    piece, wide = mix(value), value[:-width] + value[width:] * np.uint64(pow(BASE, width, 1 << 64))
    del value
    bits = max(24, n.bit_length())
    least = (piece >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(piece), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(row)) + np.repeat(offs[:-1] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    at = (least[start] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    last = start[np.r_[new[1:], len(start)] - 1]
    row, at, first = row[new], at[new], start[new]
    # a segment has 100 to 168 bytes: its first, middle and last 64 hold them all
    long = last - first + LENGTH - 64
    whole = ((at - first) * 1000 + (last - first)).astype(np.uint64)
    for part in (wide[first], wide[first + long // 2], wide[first + long]):
        whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + part)
    return row, at, first, last, piece[at], whole


def _windows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes of it that came before, bytes, offsets) of runs of whole rows, and of a longer row the windows that together
    hold each of its strings once."""
    for a, _, data, offs in chunks(column, CHUNK):
        for low in range(0, max(1, len(data) - LENGTH + 1), CHUNK) if len(offs) == 2 else (0,):
            part = data[low : low + CHUNK + LENGTH - 1] if len(offs) == 2 else data
            yield a, low, part, np.array([0, len(part)]) if len(offs) == 2 else offs


def _anchors(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row for each segment; of equal segments in a run of rows only the earliest, and rows with runs < 0 for the bytes of the others."""
    ids = batch.column("doc_id").to_numpy()
    for a, gone, data, offs in _windows(batch.column("text")):
        row, at, first, last, key, ctx = segments(data, offs)
        if not len(row):
            continue
        doc, base = ids[row + a], offs[row] - gone
        pos = at - base
        order = np.lexsort((pos, doc, ctx, key))
        same = np.zeros(len(order), bool)
        same[1:] = (key[order][1:] == key[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
        # a repeated doc_id must not make a row its own copy: segments at the place of the earliest one are that one
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        moved = (doc[order] != doc[lead]) | (pos[order] != pos[lead])
        one, two = order[~same], order[same & moved]
        k, c = signed(key), signed(ctx)
        low, high = first[two] - base[two], last[two] - base[two] + LENGTH
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[k[one], k[two] ^ doc[two]]), pa.array(np.r_[c[one], low]), pa.array(np.r_[doc[one], doc[two]]), pa.array(np.r_[pos[one], high]), pa.array(np.r_[at[one] - first[one], low * 0].astype(np.int32)), pa.array(np.r_[last[one] - first[one], low * 0 - 1].astype(np.int32))],
            names=[x.split()[0] for x in ANCHORS.split(", ")],
        )


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key, ctx, doc_id, pos: bytes of repeated segments (runs < 0), and the first segment of each of the
    several that share a key. Only the last row, its earliest equal's place and the key's first segment are kept between batches."""
    held, last, place = None, None, None
    names = [x.split()[0] for x in ANCHORS.split(", ")]
    for b in batches:
        if not b.num_rows:
            continue
        key, ctx, doc, pos, before, runs = (b.column(c).to_numpy() for c in names)
        given = runs < 0
        out = [[x[given] for x in (key, ctx, doc, pos, before, runs)]]
        key, ctx, doc, pos, before, runs = (x[~given] for x in (key, ctx, doc, pos, before, runs))
        if len(key):
            if last is not None:
                key, ctx, doc, pos, before, runs = (np.r_[np.array([v], x.dtype), x] for v, x in zip(last, (key, ctx, doc, pos, before, runs), strict=True))
            new_key = np.r_[True, key[1:] != key[:-1]]
            new = new_key | np.r_[True, ctx[1:] != ctx[:-1]]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            lead_doc, lead_pos = doc[lead], pos[lead]
            if last is not None:
                lead_doc[lead == 0], lead_pos[lead == 0] = place
            again = np.flatnonzero(~new & ((doc != lead_doc) | (pos != lead_pos)))
            low = pos[again] - before[again]
            out.append([key[again], low, doc[again], low + runs[again] + LENGTH, before[again] * 0, before[again] * 0 - 1])
            if last is not None:  # the row carried over was looked at already
                new[0] = False
            later = new & ~new_key
            # a key's first segment is wanted once a second one comes
            owner = np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))
            wanted = np.unique(owner[later])
            carried = wanted[wanted == 0] if last is not None else wanted[:0]
            pick = np.r_[wanted[len(carried) :], np.flatnonzero(later)]
            out.append([x[pick] for x in (key, ctx, doc, pos, before, runs)])
            if len(carried) and held is not None:
                out.append([np.array([v], x.dtype) for v, x in zip(held, (key, ctx, doc, pos, before, runs), strict=True)])
                held = None
            tail = int(owner[-1])
            if tail != 0 or last is None:
                held = None if tail in set(wanted.tolist()) else tuple(x[tail] for x in (key, ctx, doc, pos, before, runs))
            last = tuple(x[-1] for x in (key, ctx, doc, pos, before, runs))
            place = lead_doc[-1], lead_pos[-1]
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64,) * 4 + (np.int32,) * 2, strict=True)], names=names)


def _contexts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The bytes before each segment's anchor, reversed, and from it on."""
    keys, docs, at, befores, run, left, right = [], [], [], [], [], [], []
    for doc, text, segs in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("segs").to_pylist(), strict=True):
        raw = text.as_py().encode()
        for s in segs:
            a, b, r = s["pos"], s["before"], s["runs"]
            keys.append(s["key"])
            docs.append(doc)
            at.append(a)
            befores.append(b)
            run.append(r)
            left.append(raw[a - b : a][::-1])
            right.append(raw[a : a - b + r + LENGTH])
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(at, pa.int64()), pa.array(befores, pa.int32()), pa.array(run, pa.int32()), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["key", "doc_id", "pos", "before", "runs", "left", "right"])


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """members in order of their strings, by a trie that keeps branching depths and bytes only: a string goes down blindly, is
    compared once with the leaf it meets, and is put in where they part."""
    # a node is [depth, {byte or -1: node}] or, as a leaf, a list of members as a tuple's only item
    root = ([members[0]],)
    for m in members[1:]:
        s = strings[m]
        node = root
        while len(node) == 2:
            d = node[0]
            b = s[d] if d < len(s) else -1
            node = node[1].get(b) or next(iter(node[1].values()))
        other = strings[node[0][0]]
        n = common(s, other)
        if n == len(s) == len(other):
            node[0].append(m)
            continue
        above, byte, node = None, None, root
        while len(node) == 2 and node[0] < n:
            above, byte = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(byte)
            if node is None:
                break
        b, leaf = s[n] if n < len(s) else -1, ([m],)
        if node is None:
            above[1][byte] = leaf
        elif len(node) == 2 and node[0] == n:
            node[1][b] = leaf
        else:
            parted = [n, {b: leaf, (other[n] if n < len(other) else -1): node}]
            if above is None:
                root = parted
            else:
                above[1][byte] = parted
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 1:
            out += node[0]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def _matrix(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def deep_shallow(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings by group, then by bytes, and for each place the common prefix with the string before (0 over groups)."""
    n = len(strings)
    heads = _matrix(strings, 8 * SHALLOW).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0, True])
    stack = [(int(a), int(b), 0) for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1]
    while stack:  # multikey quicksort, a word of 8 bytes as a character
        low, high, depth = stack.pop()
        part = order[low:high]
        if depth == SHALLOW:
            order[low:high] = blind_trie(strings, part.tolist())
            continue
        v = heads[part, depth]
        pivot = v[len(v) // 2]
        less, more = v < pivot, v > pivot
        a, b = int(less.sum()), int(more.sum())
        if a or b:
            order[low:high] = np.concatenate([part[less], part[~less & ~more], part[more]])
        stack += [(x, y, d) for x, y, d in ((low, low + a, depth), (low + a, high - b, depth + 1), (high - b, high, depth)) if y - x > 1]
    size = np.array([len(s) for s in strings])
    full = _matrix(strings, max(1, int(size.max())))[order]
    prefix = np.zeros(n, np.int64)
    unlike = full[1:] != full[:-1]
    found = np.where(unlike.any(axis=1), unlike.argmax(axis=1), full.shape[1])
    prefix[1:] = np.where(group[order][1:] == group[order][:-1], np.minimum(found, np.minimum(size[order][1:], size[order][:-1])), 0)
    return order, prefix


def repeated(group: np.ndarray, place: np.ndarray, before: np.ndarray, runs: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments in order of their places, which are numbered: (segment, first, last) of runs of distances before the anchor at which
    strings start that a segment of the group at an earlier place has too."""
    n = len(group)
    orders = [deep_shallow(left, group), deep_shallow(right, group)]
    # bytes after a shorter string's end are not common, so classes at a depth hold only strings that long, besides lone short ones
    hit = np.zeros((n, SPAN + 1), bool)
    for d in range(SPAN):
        valid = np.flatnonzero((d <= before) & (d >= before - runs))
        if len(valid) < 2:
            continue
        label = []
        for (order, prefix), depth in zip(orders, (d, LENGTH - d), strict=True):
            cls = np.empty(n, np.int64)
            cls[order] = np.cumsum((prefix < depth) | np.r_[True, group[order][1:] != group[order][:-1]])
            label.append(cls[valid])
        both = label[0] * (n + 1) + label[1]
        o = np.argsort(both, kind="stable")
        new = np.r_[True, both[o][1:] != both[o][:-1]]
        lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
        hit[valid[o[place[valid[o]] != place[valid[lead]]]], d] = True
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), hit.astype(np.int8)], axis=1), axis=1)
    seg, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return seg, low, high - 1


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key, doc_id, pos: bytes to remove. Whole keys are gathered to about BLOCK_ROWS rows."""

    def work(t: pa.Table) -> pa.RecordBatch:
        key, doc, pos = (t[c].to_numpy() for c in ("key", "doc_id", "pos"))
        place = np.lexsort((pos, doc))
        before, runs = t["before"].to_numpy()[place], t["runs"].to_numpy()[place]
        left, right = (t[c].take(pa.array(place)).to_pylist() for c in ("left", "right"))
        where = np.cumsum(np.r_[True, (np.diff(doc[place]) != 0) | (np.diff(pos[place]) != 0)])
        seg, low, high = repeated(np.unique(key[place], return_inverse=True)[1], where, before, runs, left, right)
        at = pos[place][seg]
        return pa.RecordBatch.from_arrays([pa.array(doc[place][seg]), pa.array(at - high), pa.array(at - low + LENGTH)], names=["doc_id", "low", "high"])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows >= BLOCK_ROWS:
            key = held["key"].to_numpy()
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            if cut:
                yield work(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield work(held.combine_chunks())


SEGMENTS = "key long, doc_id long, pos long, before int, runs int, left binary, right binary"


def _split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Each segment's strings by STEP neighbouring distances before the anchor, under a key made of all bytes that these share."""
    out: list[list] = [[] for _ in range(7)]
    for r in batch.to_pylist():
        low, high = r["before"] - r["runs"], r["before"]
        for first in range(low - low % STEP, high + 1, STEP):
            a, b = max(low, first), min(high, first + STEP - 1)
            shared = first.to_bytes(1, "big") + r["key"].to_bytes(8, "big", signed=True) + r["left"][:first] + b"|" + r["right"][: LENGTH - first - STEP + 1]
            key = int.from_bytes(hashlib.sha1(shared).digest()[:8], "big", signed=True)
            for c, v in zip(out, (key, r["doc_id"], r["pos"], b, b - a, r["left"][:b], r["right"][: LENGTH - a]), strict=True):
                c.append(v)
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 2
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])


def _each_string(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Every string of a segment, named by 128 bits of SHA-1."""
    a, b, docs, at = [], [], [], []
    for r in batch.to_pylist():
        raw, start = r["left"][::-1] + r["right"], r["pos"] - r["before"]
        for i in range(r["runs"] + 1):
            h = hashlib.sha1(raw[i : i + LENGTH]).digest()
            a.append(int.from_bytes(h[:8], "big", signed=True))
            b.append(int.from_bytes(h[8:16], "big", signed=True))
            docs.append(r["doc_id"])
            at.append(start + i)
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, docs, at)], names=["a", "b", "doc_id", "low"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins overlapping and touching runs of rows in order of doc_id, low; the last run is kept between batches."""
    held = None
    for b in batches:
        doc, low, high = (b.column(c).to_numpy() for c in ("doc_id", "low", "high"))
        if held is not None:
            doc, low, high = (np.r_[np.int64(v), x] for v, x in zip(held, (doc, low, high), strict=True))
        if not len(doc):
            continue
        new_doc = np.r_[True, doc[1:] != doc[:-1]]
        # running maximum of the ends within a document, by lifting each document above the last
        lift = np.cumsum(new_doc) * np.int64(1 << 40)
        reach = np.maximum.accumulate(high + lift) - lift
        new = new_doc | np.r_[True, low[1:] > reach[:-1]]
        first = np.flatnonzero(new)
        end = reach[np.r_[first[1:], len(doc)] - 1]
        held = (doc[first[-1]], low[first[-1]], end[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[first[:-1]]), pa.array(low[first[:-1]]), pa.array(end[:-1])], names=["doc_id", "low", "high"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in held], names=["doc_id", "low", "high"])


def _parted(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of keys with more than HOT_SEGMENTS rows, and the others. At most one key in HOT_SEGMENTS is hot; small() checks."""
    hot = scratch.table(rows.groupBy("key").count().where(F.col("count") > HOT_SEGMENTS).select("key"))
    return rows.join(scratch.small(hot), "key", "left_semi"), rows.join(scratch.small(hot), "key", "left_anti")


def repeated_spans(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, low, high): maximal runs of bytes of documents (doc_id, text) to remove, as a table of scratch."""
    docs = documents.where("doc_id is not null and octet_length(text) >= 100").select("doc_id", "text")
    runs = "doc_id long, low long, high long"
    found = docs.mapInArrow(each_batch(_anchors), ANCHORS).repartition("key").sortWithinPartitions("key", "ctx", "doc_id", "pos").mapInArrow(_settle, ANCHORS)
    found = scratch.table(found)
    spans = found.where("runs < 0").select("doc_id", F.col("ctx").alias("low"), F.col("pos").alias("high"))
    segs = found.where("runs >= 0").select("key", "doc_id", "pos", "before", "runs")
    by_doc = scratch.table(segs.groupBy("doc_id").agg(F.collect_list(F.struct("key", "pos", "before", "runs")).alias("segs")))
    # this list grows with the input and soon passes any bound for a broadcast, so it is joined alike at every size
    near = scratch.table(docs.join(by_doc, "doc_id").mapInArrow(each_batch(_contexts), SEGMENTS))
    hot, cold = _parted(near, scratch)
    hot, finer = _parted(scratch.table(hot.mapInArrow(each_batch(_split), SEGMENTS)), scratch)
    sorted_out = cold.union(finer).repartition("key").sortWithinPartitions("key", "doc_id", "pos").mapInArrow(_sorted_out, runs)
    strings = scratch.table(hot.mapInArrow(each_batch(_each_string), "a long, b long, doc_id long, low long"))
    earliest = strings.groupBy("a", "b").agg(F.min(F.struct("doc_id", "low")).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "p")
    hit = strings.join(scratch.table(earliest), ["a", "b"]).where(F.struct("doc_id", "low") != F.col("p")).select("doc_id", "low", (F.col("low") + LENGTH).alias("high"))
    every = spans.union(sorted_out).union(hit).repartition("doc_id").sortWithinPartitions("doc_id", "low", "high").mapInArrow(_merge, runs)
    return scratch.table(every)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    raw, removed = [], []
    for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
        t, at, parts = (text.as_py() or "").encode(), 0, []
        for s in sorted(spans or [], key=lambda s: s["low"]):
            parts.append(t[at : s["low"]])
            at = s["high"]
        parts.append(t[at:])
        raw.append(b"".join(parts))
        removed.append(len(t) - len(raw[-1]))
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r + len(x) for r, x in zip(removed, raw, strict=True)], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s or []) for s in batch.column("spans").to_pylist()], pa.int64()), batch.column("spans"), pa.array(raw, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (array of low, high in bytes) and kept (binary: the bytes left) for every row of
    documents (doc_id, text; other columns are ignored).

    Null and empty texts have no bytes; texts of fewer than 100 bytes lose none; an empty table gives no rows. Rows with a null
    doc_id are left whole and are no earlier copy for others. A doc_id should name one text: rows that repeat it count as standing at
    one place, so that they do not remove each other, and runs found in one are removed from each, as far as it reaches. A text is held
    whole by one worker, with its anchors and its list of runs.
    """
    with Scratch(documents.sparkSession) as scratch:
        spans = repeated_spans(documents, scratch)
        spans = scratch.keep(scratch.table(spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))))
        rows = documents.select("doc_id", "text").join(scratch.small(spans), "doc_id", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(each_batch(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<low: long, high: long>>, kept binary")
