"""Repeated byte strings across a corpus, by prefix doubling over ranks of positions.

A position's rank for length L is a hash class of the L bytes that start there; ranks for 2L come from the
pair of ranks at a position and at the position L further on, and a position whose rank is unique never needs a
longer one.  Here that runs over three lengths, and Spark sorts (rank pair, position) at each of them:

1. Length 48, at sampled positions only.  Every 100-byte window names one anchor: the leftmost smallest rank
   among the 48-byte strings inside it.  Equal windows name equal anchors at the same offset, so a window whose
   anchor is unique is unique.  About one position in 26 is an anchor.
2. The pair (anchor rank, rank of all the bytes that the anchor's windows cover).  Rows with an equal pair are
   copies in every window; all but the first are settled.  Interiors of long copies end here.
3. Length 100, at every position of the windows that are left: the first one of each class of the anchor rank
   where the classes of the covered bytes differ.  All but the smallest position of a rank are repeats.

Each task first merges equal pairs of its own batch, and of an anchor with several contexts sends just one
row on as witness, so a passage that a third of the corpus holds arrives once per batch, not once per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telerisk.llm.keys import keyed, public_id
from telerisk.llm.words import Roller, blocks, column_bytes, mix
from telerisk.session import materialise

ANCHOR = 48
CHUNK = 1 << 20
_INDEX = np.uint64((1 << 22) - 1)
FIRST, SECOND = Roller(11), Roller(12)
#: an anchor's rank only says which anchors to compare, so 48 bits do; with the second rank a class has 112 bits
WIDE = np.uint64((1 << 48) - 1)
#: open: its anchor rank must meet others'; witness: the same, and known to be ambiguous; rest: known to be ambiguous; settled: a repeat
OPEN, WITNESS, REST, SETTLED = range(4)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (width - span)], values[width - span:])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> list[np.ndarray]:
    """Rank of the anchor, rank of the bytes its windows cover, row, first and last window (in the row)."""
    out = [[], [], [], [], []]
    n = len(data)
    for begin in range(0, max(0, n - length + 1), CHUNK):
        part = data[begin:begin + CHUNK + length - 1]
        sums = FIRST.sums(part)
        at = np.arange(len(part) - ANCHOR + 1)
        rank = FIRST.spans(sums, at, at + ANCHOR)
        least = sliding_min((rank & ~_INDEX) | at.astype(np.uint64), length - ANCHOR + 1)
        row = np.searchsorted(offsets, begin + np.arange(len(least)), "right") - 1
        window = np.flatnonzero(begin + np.arange(len(least)) + length <= offsets[row + 1])
        if not len(window):
            continue
        place = (least[window] & _INDEX).astype(np.int64)
        row = row[window]
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        lo, hi, place, row = window[first], window[last], place[first], row[first]
        covered = mix(FIRST.spans(sums, lo, hi + length) + (place - lo).astype(np.uint64))
        for target, values in zip(out, (rank[place] & WIDE, covered, row, begin + lo - offsets[row], begin + hi - offsets[row])):
            target.append(values)
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64)
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds)]


def planes(x: np.ndarray) -> bytes:
    """Bytes of a column by significance, compressed: high bytes of small numbers and ranks left out all but vanish."""
    body = pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)
    return len(body).to_bytes(4, "little") + body


def pack(ranks: list[np.ndarray], ints: list[np.ndarray]) -> bytes:
    """Ranks as they are; integers as differences."""
    parts = [planes(r) for r in ranks] + [planes(np.diff(x, prepend=x.dtype.type(0))) for x in ints]
    return len(ranks[0]).to_bytes(4, "little") + b"".join(parts)


def unpack(data: bytes, ranks: int, kinds: tuple) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for k, kind in enumerate([np.uint64] * ranks + list(kinds)):
        size, width = int.from_bytes(data[at:at + 4], "little"), np.dtype(kind).itemsize
        raw = np.frombuffer(pa.decompress(data[at + 4:at + 4 + size], n * width, "zstd"), np.uint8)
        x = np.ascontiguousarray(raw.reshape(width, n).T).view(kind)[:, 0]
        out.append(x if k < ranks else np.cumsum(x, dtype=kind))
        at += 4 + size
    return out


def dealt(ranks: list[np.ndarray], ints: list[np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """One packed row per bucket."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    rows = [pack([r[i] for r in ranks], [x[i] for x in ints]) for i in np.split(order, first[1:])] if len(names) else []
    return pa.record_batch([pa.array(names.astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "entries"])


def leaders(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by (keys, place), and which entries of that order are the first with their keys."""
    order = np.lexsort([*place[::-1], *keys[::-1]])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


KINDS = (np.int64, np.int32, np.int64, np.int16, np.int8)  # document, copy, first window, further windows, kind
PLACES = (np.int64, np.int32, np.int64)  # document, copy, position


def merge(rank, pair, doc, copy, lo, hi, kind):
    """Entries of one batch or bucket in (rank, pair, place) order with their new kinds."""
    order, lead = leaders([rank, pair], [doc, copy, lo])
    rank, pair, doc, copy, lo, hi, kind = (x[order] for x in (rank, pair, doc, copy, lo, hi, kind))
    kind = np.where(lead, kind, SETTLED).astype(np.int8)
    # a rank with two leading pairs has different contexts
    group = np.cumsum(np.append(True, rank[1:] != rank[:-1])) - 1 if len(rank) else np.zeros(0, np.int64)
    several = (np.bincount(group[lead]) > 1)[group] if len(rank) else np.zeros(0, bool)
    return rank, pair, doc, copy, lo, hi, kind, several


def repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes of each document that strings of ``length`` bytes cover which also start earlier.

    Earlier means a smaller doc_id, or the same document and an earlier byte; matches never cross documents and
    may overlap.  Strings are judged on the input.  Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``kept_sha256`` (of the bytes that stay) and ``spans`` (start and end of each run).

    Null texts are empty.  Rows equal in id and text are one document and give one row; different texts under one
    id come in the order of the texts; a null id comes first.  Texts shorter than ``length`` keep all.  Other
    columns are not read; an empty table gives an empty result.
    """
    if not ANCHOR < length < 1 << 15:
        raise ValueError(f"length must be over {ANCHOR} and under 32768")
    spark = docs.sparkSession
    # several to a partition, so that partitions even out
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one exchange of the texts serves both joins below
    texts = keyed(docs, id_col, text_col)
    by_doc = texts.repartition("doc", "copy")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, copy = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = [[] for _ in range(6)]
            for block in blocks(batch.column(2)):
                rank, pair, row, lo, hi = anchors(block.data, block.offsets, length)
                for target, values in zip(found, (rank, pair, doc[block.lo + row], copy[block.lo + row], lo, hi)):
                    target.append(values)
            rank, pair, doc, copy, lo, hi = (np.concatenate(x) for x in found) if found[0] else (np.zeros(0, k) for k in (np.uint64, np.uint64, *KINDS[:4]))
            rank, pair, doc, copy, lo, hi, kind, several = merge(rank, pair, doc, copy, lo, hi, np.zeros(len(rank), np.int8))
            lead = kind != SETTLED
            first = np.append(True, rank[1:] != rank[:-1]) if len(rank) else several
            kind[lead & several] = REST
            kind[lead & several & first] = WITNESS
            bucket = np.where(kind <= WITNESS, mix(rank), mix(doc.astype(np.uint64))) % np.uint64(buckets)
            known = kind > WITNESS  # their ranks have done their work
            rank, pair = (np.where(known, np.uint64(0), x) for x in (rank, pair))
            back = np.lexsort((lo, copy, doc))
            yield dealt([x[back] for x in (rank, pair)], [x[back] for x in (doc, copy, lo, (hi - lo).astype(np.int16), kind)], bucket[back])

    def rank_pairs(key: tuple, group: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), 2, KINDS) for x in group.column("entries")]
        rank, pair, doc, copy, lo, more, kind = (np.concatenate(x) for x in zip(*parts))
        hi = lo + more
        done = kind > WITNESS
        # from the kinds as they came: a witness that repeats another task's pair is settled by the merge
        ambiguous = rank[kind == WITNESS]
        a = merge(*(x[~done] for x in (rank, pair, doc, copy, lo, hi, kind)))
        several = a[7] | np.isin(a[0], ambiguous)
        known = a[6] == SETTLED
        use = known | several
        doc, copy, lo, hi = (np.concatenate([x[use], y[done]]) for x, y in zip(a[2:6], (doc, copy, lo, hi)))
        todo = np.concatenate([~known[use], kind[done] == REST])
        back = np.lexsort((lo, copy, doc))
        return pa.table({"doc": doc[back], "copy": copy[back], "run": (lo * length + hi - lo)[back], "todo": todo[back]})

    def runs(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of each row's runs of windows, and their first and last windows; a run is first * length + further."""
        size = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
        run = column.flatten().to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum(size)]), run // length, run // length + run % length

    shape = "bucket int, entries binary"
    ranked = materialise(texts.mapInArrow(scan, shape).groupBy("bucket").applyInArrow(
        rank_pairs, "doc long, copy int, run long, todo boolean"), "ranked")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, copy = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = column_bytes(batch.column(2))
            bounds, lo, hi = runs(batch.column(3))
            found = [[] for _ in range(5)]
            for row in range(len(doc)):
                part = data[offsets[row]:offsets[row + 1]]
                own = slice(bounds[row], bounds[row + 1])
                for begin in range(0, len(part) - length + 1, CHUNK):
                    piece = part[begin:begin + CHUNK + length - 1]
                    here = (hi[own] >= begin) & (lo[own] < begin + CHUNK)
                    if not here.any():
                        continue
                    step = np.zeros(len(piece) - length + 2, np.int64)
                    np.add.at(step, np.maximum(lo[own][here] - begin, 0), 1)
                    np.add.at(step, np.minimum(hi[own][here] - begin + 1, len(step) - 1), -1)
                    at = np.flatnonzero(np.cumsum(step)[:-1])
                    for target, values in zip(found, (
                            FIRST.spans(FIRST.sums(piece), at, at + length), SECOND.spans(SECOND.sums(piece), at, at + length) & WIDE,
                            np.full(len(at), doc[row]), np.full(len(at), copy[row]), begin + at)):
                        target.append(values)
            if not found[0]:
                continue
            one, two, doc, copy, at = (np.concatenate(x) for x in found)
            order, lead = leaders([one, two], [doc, copy, at])
            one, two, doc, copy, at = (x[order] for x in (one, two, doc, copy, at))
            # repeats inside the batch need no other rank: they are sent on by document, with a rank that says so
            one, two = np.where(lead, one, 0).astype(np.uint64), np.where(lead, two, 0).astype(np.uint64)
            bucket = np.where(lead, mix(one), mix(doc.astype(np.uint64))) % np.uint64(buckets)
            back = np.lexsort((at, copy, doc))
            yield dealt([one[back], two[back]], [doc[back], copy[back].astype(np.int32), at[back]], bucket[back])

    def last_ranks(key: tuple, group: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), 2, PLACES) for x in group.column("entries")]
        one, two, doc, copy, at = (np.concatenate(x) for x in zip(*parts))
        order, lead = leaders([one, two], [doc, copy, at])
        again = np.sort(order[~lead | ((one == 0) & (two == 0))[order]])
        return pa.table({"doc": doc[again], "copy": copy[again], "run": at[again] * length})

    todo = ranked.where("todo").groupBy("doc", "copy").agg(F.collect_list("run").alias("ranges"))
    late = (by_doc.join(todo, ["doc", "copy"]).select("doc", "copy", "text", "ranges").mapInArrow(windows, shape)
            .groupBy("bucket").applyInArrow(last_ranks, "doc long, copy int, run long"))
    cuts = (ranked.where("NOT todo").drop("todo").union(late).groupBy("doc", "copy")
            .agg(F.collect_list("run").alias("cuts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            bounds, lo, hi = runs(batch.column(2))
            out = []
            for row in range(len(batch)):
                text = data[offsets[row]:offsets[row + 1]]
                own = slice(bounds[row], bounds[row + 1])
                if own.start == own.stop:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), []))
                    continue
                step = np.zeros(len(text) + 1, np.int64)
                np.add.at(step, lo[own], 1)
                np.add.at(step, hi[own] + length, -1)
                gone = np.cumsum(step)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                out.append((len(text), int(gone.sum()), len(edges), hashlib.sha256(text[~gone]).hexdigest(),
                            [{"start": int(a), "end": int(b)} for a, b in edges]))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, (
                pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))))],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return by_doc.join(cuts, ["doc", "copy"], "left").select("doc", "text", "cuts").mapInArrow(
        cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    ).select(public_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
