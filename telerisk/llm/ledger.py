"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one bit per failed
rule.  Policies are named masks over those bits, so a new version of a policy, or leaving one rule out,
needs the ledger only and never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telerisk.llm.words import SPACE, WORDS, Block, blocks, grams, mix, segments

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    _, index, count = np.unique(keys, return_inverse=True, return_counts=True)
    return count[index] > 1


def measure(block: Block) -> list[np.ndarray]:
    data, rows = block.data, block.rows
    starts, ends, row = block.words()
    n_words = np.bincount(row, minlength=rows)
    solid = ~SPACE[data]
    chars = block.per_row(solid & ((data & 0xC0) != 0x80))
    symbols = block.per_row(SYMBOLS[data])
    sums = WORDS.sums(data)
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))

    cut = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([block.offsets[:-1][np.diff(block.offsets) > 0], cut + 1]))
    begin = np.unique(begin[begin < len(data)])
    line_row = block.row_of(begin)
    finish = np.minimum(np.append(begin[1:], len(data)), block.offsets[line_row + 1])
    finish = finish - ((finish > begin) & (data[finish - 1] == 0x0A)) if len(begin) else finish
    filled = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    begin, finish, line_row = begin[filled], finish[filled], line_row[filled]
    _, first = np.unique(WORDS.spans(sums, begin, finish) ^ salt[line_row], return_index=True)
    again = np.ones(len(begin), bool)
    again[first] = False
    lines = np.bincount(line_row, minlength=rows)
    dup_lines = np.bincount(line_row[again], minlength=rows)

    runs, at = grams(WORDS.spans(sums, starts, ends), row, WINDOW)
    twice = at[repeated(runs ^ salt[row[at]])] if len(at) else at
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    repeat_words = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=rows)

    upper = block.per_row((data >= 0x41) & (data <= 0x5A))
    letters = upper + block.per_row((data >= 0x61) & (data <= 0x7A))
    return [n_words, chars, symbols, dup_lines, repeat_words, lines, upper, letters]


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements (long) of every row, each taken once over the whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(b) for b in blocks(batch.column(1))]
            columns = [pa.array(np.concatenate(p).astype(np.int64)) for p in zip(*parts)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", *MEASURES])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


#: rules in bit order
RULES = ("few_words", "repeated_words", "symbols", "duplicate_lines", "word_length", "shouting")


def rules() -> dict[str, Column]:
    """Rules in bit order: true where a document fails.  Each reads measurements only."""
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_words": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 20 * c("n_words"),
        "duplicate_lines": (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
        "shouting": (c("n_letters") >= 40) & (100 * c("n_upper") > 50 * c("n_letters")),
    }


BASE_RULES = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "symbols", "duplicate_lines", "word_length", "shouting"),
}
CURRENT = "v1"


def mask(names) -> int:
    return sum(1 << RULES.index(n) for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failed`` (one bit per failed rule) of every row.

    Null and empty texts have zero words, so they fail ``few_words`` only.  Repeated rows and tied or null ids
    keep a row each; an empty table gives an empty ledger; other columns are not read.
    """
    failed = F.lit(0).cast("long")
    for k, rule in enumerate(rules().values()):
        failed = failed.bitwiseOR(F.when(rule, F.lit(1 << k)).otherwise(0).cast("long"))
    return measurements(docs, id_col, text_col).withColumn("failed", failed)


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``base_failed`` and ``kept`` of each ledger entry under a policy."""
    hit = lambda names: F.col("failed").bitwiseAND(F.lit(mask(names)).cast("long")) != 0
    return entries.withColumn("base_failed", hit(BASE_RULES)).withColumn(
        "kept", ~(hit(BASE_RULES) | hit(POLICIES[policy])))


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects.

    Entries are first counted by their mask (at most 2^rules rows), so the rest is independent of the corpus.
    """
    used = POLICIES[policy]
    by_mask = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(used)).cast("long")).alias("hit")).agg(F.count("*").alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).cast("long").alias("bit")) for n in used]))
    return (by_mask.select("hit", "n", table.alias("r")).where(F.col("hit").bitwiseAND(F.col("r.bit")) != 0)
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only")))
