"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole, so tokens are those a model would see.  Token byte lengths give every
token's character span, and an interval join against the document's sections (both sorted, so a binary search
per end) gives each token its section.  A token that crosses a boundary goes by an explicit rule:
``largest``: to the section that holds most of its characters, the first of equals; ``first``: to the one that
holds its first character; ``split``: to each in proportion to its characters.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telerisk.llm.words import column_bytes

RULES = ("largest", "first", "split")
#: how the vocabulary splits text before merging (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The encoder of a ranks file that every worker can read, and the byte length of each token."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def token_spans(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First character of each token, the end of its last one, and the number of characters before each byte."""
    end = np.cumsum(size)
    chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    begin = end - size
    return chars[np.minimum(begin + 1, len(text))] - 1, chars[end], chars


def lines(text: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections of a text: its lines, each with its line feed, so that they cover the text."""
    cut = np.flatnonzero(text == 0x0A) + 1
    start = np.concatenate([[0], chars[cut[cut < len(text)]]]) if len(text) else np.zeros(0, np.int64)
    return start.astype(np.int64), np.append(start[1:], chars[-1]).astype(np.int64)[:len(start)]


def allocate(begin: np.ndarray, end: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens and crossing tokens of each section, and tokens of none; sections are sorted and do not overlap."""
    n = len(start)
    total, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not len(begin):
        return total, crossing, float(len(begin))
    first = np.searchsorted(stop, begin, "right")
    last = np.searchsorted(start, end, "left") - 1
    one = first == last
    total += np.bincount(first[one], minlength=n)
    many = np.flatnonzero(last > first)
    outside = float(np.sum(last < first))
    # a token may also cross into a gap between sections; then its part inside a section decides alone
    best, most = first[many].copy(), np.zeros(len(many), np.int64)
    weight = np.zeros(len(many))
    parts = []
    for step in range(int((last - first)[many].max()) + 1 if len(many) else 0):
        here = first[many] + step
        on = here <= last[many]
        at = np.minimum(here, n - 1)
        share = np.where(on, np.minimum(end[many], stop[at]) - np.maximum(begin[many], start[at]), 0)
        better = share > most
        best, most = np.where(better, at, best), np.where(better, share, most)
        weight += share
        parts.append((at, share))
    if rule == "split":
        for at, share in parts:
            total += np.bincount(at, weights=np.divide(share, weight, out=np.zeros(len(share)), where=weight > 0), minlength=n)
    else:
        total += np.bincount(first[many] if rule == "first" else best, minlength=n)
    for at, share in parts:
        crossing += np.bincount(at[share > 0], minlength=n)
    return total, crossing, outside


SHAPE = "n_tokens long, n_chars long, n_outside long, sections array<struct<section:int,start:long,end:long,tokens:double,crossing:long>>"


def attribute(docs: DataFrame, vocabulary: str, rule: str = "largest", sections_col: str | None = None, text_col: str = "text",
              pattern: str = PATTERN) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with its token count and the tokens of each of its sections.

    ``vocabulary`` is the path of a ranks file on every worker.  Sections come from ``sections_col``, an array of
    (start, end) in code points, sorted and disjoint; without it they are the text's lines.  The tokens of all
    sections and ``n_outside`` (tokens that meet no section) add up to ``n_tokens``.  ``crossing`` counts the tokens
    that a section shares with another.  Null and empty texts have no tokens and no lines; null sections are none; a
    section without characters gets nothing.  Whole texts are encoded whatever their length.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sizes = encoding(vocabulary, pattern)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            given = batch.column(2).to_pylist() if sections_col else None
            counts, parts, bounds = [], [], [0]
            for k in range(len(batch)):
                text = data[offsets[k]:offsets[k + 1]]
                ids = np.array(encoder.encode_ordinary(text.tobytes().decode("utf-8", "replace")), np.int64)
                begin, end, chars = token_spans(text, sizes[ids])
                if sections_col:
                    pairs = np.array([(s["start"], s["end"]) for s in given[k] or () if s and s["end"] > s["start"]], np.int64).reshape(-1, 2)
                    number = np.array([i for i, s in enumerate(given[k] or ()) if s and s["end"] > s["start"]], np.int32)
                    start, stop = pairs[:, 0], pairs[:, 1]
                else:
                    start, stop = lines(text, chars)
                    number = np.arange(len(start), dtype=np.int32)
                total, crossing, outside = allocate(begin, end, start, stop, rule)
                counts.append((len(ids), int(chars[-1]), int(outside)))
                parts.append((number, start, stop, total, crossing))
                bounds.append(bounds[-1] + len(start))
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0)] * 5
            inner = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                                               ["section", "start", "end", "tokens", "crossing"])
            table = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.record_batch([batch.column(0), *(pa.array(table[:, i]) for i in range(3)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), inner)],
                                  ["row", "n_tokens", "n_chars", "n_outside", "sections"])

    more = [F.col(sections_col).alias("sections")] if sections_col else []
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"), *more)
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {SHAPE}")
