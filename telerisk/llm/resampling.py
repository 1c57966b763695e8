"""Importance resampling towards a target distribution of hashed word n-grams.

A 256-byte table lower-cases ASCII letters and blanks every other ASCII byte but digits, ``bytes.split`` yields
the words, and chained CRC-32 seeds extend a word's checksum to those of its bigram and trigram.  Counters
reduce the checksums to buckets inside each task, Spark sums the buckets, and every text is weighed by the
logarithms of the target's share over the corpus's share in its buckets.  Gumbel noise from a hash of the id
turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telerisk.llm.words import blocks
from telerisk.session import materialise

#: bytes split at a time, so that memory follows this and not the length of a text
CHUNK = 1 << 20

TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def checksums(text: bytes, chunk: int = CHUNK) -> Iterator[tuple[int, Iterator[int]]]:
    """Number of words and the CRC-32 of every run of one to three words, piece by piece of the text.

    A piece ends at a blank; its first runs continue the last two words of the piece before.
    """
    text, words, at = text.translate(TABLE), [], 0
    while at < len(text):
        end = text.find(b" ", at + chunk)
        end = len(text) if end < 0 else end
        more = text[at:end].split()
        at = end
        old = len(words[-2:])
        words = words[-2:] + more
        spaced = [b" " + w for w in words]
        one = list(map(crc32, words))
        two = list(map(crc32, spaced[1:], one))
        three = list(map(crc32, spaced[2:], two))
        yield len(more), chain(one[old:], two[max(old - 1, 0):], three)


def texts(column: pa.Array) -> Iterator[bytes]:
    for block in blocks(column):
        data = block.data.tobytes()
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            yield data[a:b]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = 10000) -> DataFrame:
    """``bucket`` and ``n``, the occurrences of its features over all texts; buckets without any are absent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in texts(batch.column(0)):
                for _, found in checksums(text):
                    seen = Counter(found)
                    keys = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
                    np.add.at(total, keys, np.fromiter(seen.values(), np.int64, len(seen)))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10000) -> np.ndarray:
    """floor(1000 * ln(target share / corpus share)) of each bucket, both shares smoothed by one."""
    counted = (bucket_counts(docs, text_col, buckets).withColumn("side", F.lit(0))
               .union(bucket_counts(target, text_col, buckets).withColumn("side", F.lit(1))).toPandas())
    corpus, goal = (np.zeros(buckets) for _ in range(2))
    for side, into in ((0, corpus), (1, goal)):
        part = counted[counted["side"] == side]
        into[part["bucket"].to_numpy(int)] = part["n"].to_numpy(float)
    ratio = (goal + 1) * (corpus.sum() + buckets) / ((corpus + 1) * (goal.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight`` of each row of ``docs``; texts without a word weigh 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(texts(batch.column(1))):
                for n, found in checksums(text):
                    at = np.fromiter(found, np.int64) % len(gain)
                    out[i] += n, len(at), gain[at].sum()
            yield pa.record_batch([batch.column(0), *map(pa.array, out.T.copy())], ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = 10000,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of each row of ``docs``.

    Of the N rows with at least ``min_words`` words, the floor(percent * N / 100) highest scores are drawn and ranked
    from 1, ties to the smaller id; all other rows have a null rank.  Null texts have no words.  A null id is hashed as
    an empty one and comes before other ids in a tie.  Each of several equal rows counts, and is ranked, for itself.
    Empty tables give no rows; an empty target is a flat one.  Columns beside the id and the text are not read.

    Ranks come from one range partitioning by score and the sizes of its parts, so no task sorts all rows.  Only the
    gains (one number for each bucket) pass through the driver.
    """
    spark = docs.sparkSession
    # written before it is dealt: sampling the ranges would read the texts once more
    scored = materialise(weigh(docs, gains(docs, target, text_col, buckets), id_col, text_col), "weights")
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((first.cast("double") + 0.5) / 4294967296)))
    order = [(F.col("n_words") >= min_words).desc(), F.col("score").desc(), F.col("id").asc()]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # ids of sorted rows: the partition in the upper bits, the place in it below
    placed = materialise(scored.withColumn("score", F.col("weight") + noise).repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("at", F.monotonically_increasing_id()), "resample")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"), F.count(F.when(F.col("n_words") >= min_words, 1)).alias("fit")).collect()
    before, total = [], 0
    for r in sorted(sizes):  # one row for each partition
        before.append((r.part, total))
        total += r.n
    drawn = percent * sum(r.fit for r in sizes) // 100
    starts = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", F.shiftright("at", 33)).join(starts, "part").select(
        F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score", F.when((F.col("n_words") >= min_words) & (rank <= drawn), rank).alias("rank"))


def drawn(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is drawn in ``ranked`` (a result of ``resample``), as they are; null ids never match."""
    return docs.join(ranked.where("rank IS NOT NULL").select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_semi")
