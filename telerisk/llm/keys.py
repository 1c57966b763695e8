"""Row keys for documents whose ids may be null or shared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: stands for a null id inside operators, and so comes before every other id
NULL_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc``, ``copy`` (both never null) and ``text`` (null: empty), one row for each pair of id and text.

    copy is 0 unless different texts share an id; then it numbers them in the order of the texts.  Whether ids
    are unique is looked up first over the id column alone, so the texts are only shuffled where they are not.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = rows.groupBy("doc").count().where("count > 1").limit(1).count()
    if not shared:
        # always 0, yet not a literal: a constant would leave the join keys, and joins would deal the texts anew
        return rows.select("doc", (F.col("doc") % 1).cast("int").alias("copy"), "text")
    return rows.distinct().select(
        "doc", (F.row_number().over(Window.partitionBy("doc").orderBy("text")) - 1).cast("int").alias("copy"), "text")


def public_id(name: str = "doc"):
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))
