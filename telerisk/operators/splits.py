"""Stratified splits that are reproducible on any engine, and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telerisk.errors import ContractError
from telerisk.functions.columns import seeded_hex
from telerisk.operators.ordered import number_by_hash


#: lines of one list whose digest is taken, about
LEAF = 16


def digest_depth(lines: int, leaf: int = LEAF) -> int:
    """Hex digits of md5(key) that split so many lines into leaves of about ``leaf``."""
    depth = 0
    while lines > leaf * 16**depth:
        depth += 1
    return depth


def digest_tree(df: DataFrame, key: Column, line: Column, name: str, count: str) -> DataFrame:
    """SHA-256 of the sorted lines of each leaf, then of the digests of each node's children, up to the root; with the line count.

    A leaf is a run of leading digits of md5(key), as many as the number of lines calls for, and an inner node has at most 16
    children: no list grows with the data.
    """
    rows = df.select(F.md5(key).alias("_hex"), line.alias("_line"))
    depth = digest_depth(rows.count())
    node = (rows.groupBy(F.substring("_hex", 1, depth).alias("_node"))
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_line")), "\n"), 256).alias("_digest"), F.count(F.lit(1)).alias("_n")))
    for level in range(depth - 1, -1, -1):
        children = F.transform(F.array_sort(F.collect_list(F.struct("_node", "_digest"))), lambda c: c["_digest"])
        node = node.groupBy(F.substring("_node", 1, level).alias("_node")).agg(
            F.sha2(F.array_join(children, "\n"), 256).alias("_digest"), F.sum("_n").alias("_n"))
    return node.agg(F.coalesce(F.max("_digest"), F.sha2(F.lit(""), 256)).alias(name), F.coalesce(F.sum("_n"), F.lit(0)).alias(count))


def label_fingerprint(reference: DataFrame) -> DataFrame:
    """Digest of the ``id:label`` lines: any added, removed or relabelled entity changes it."""
    line = F.concat_ws(":", F.col("gpsno"), F.col("label").cast("string"))
    return digest_tree(reference, F.col("gpsno"), line, "label_fingerprint", "entities")


MANIFEST = "label_fingerprint string, entities long, seed int, folds int, holdout double"


def frozen_split(reference: DataFrame, folder: str, seed: int = 2026, folds: int = 5, holdout: float = 0.2) -> DataFrame:
    """The split kept in ``folder``: made on the first call, read on later ones, refused if anything it depends on has changed.

    Labels, entities, seed, number of folds and holdout share are compared with those of the kept split.  The manifest
    is written after the rows; a folder without one holds no split yet.
    """
    spark = reference.sparkSession
    found = label_fingerprint(reference).first()
    now = (found.label_fingerprint, found.entities, seed, folds, float(holdout))
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{folder}/manifest")
    kept = [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()]
    if not kept:
        stratified_split(reference, seed, folds, holdout).write.mode("overwrite").parquet(f"{folder}/split")
        spark.createDataFrame([now], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    elif kept[0] != now:
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        changed = [f"{n}: kept {a}, now {b}" for n, a, b in zip(names, kept[0], now) if a != b]
        raise ContractError("the frozen split does not fit: " + "; ".join(changed))
    return spark.read.schema("gpsno string, label int, part string, fold int").parquet(f"{folder}/split")


def stratified_split(reference: DataFrame, seed: int = 2026, folds: int = 5, holdout: float = 0.2) -> DataFrame:
    """Holdout = first ``holdout`` share of each class in md5 order, then fold = position mod k."""
    if folds < 2 or not 0 < holdout < 0.5:
        raise ValueError("need at least two folds and a holdout share in (0, 0.5)")
    keyed = reference.select("gpsno", "label").withColumn("_hex", seeded_hex(seed, "gpsno"))
    sizes = keyed.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    rows = number_by_hash(keyed, ["label"], "_hex", "_no").join(sizes, "label")
    held = F.floor(F.col("_n") * F.lit(float(holdout)) + 0.5)
    is_held = F.col("_no") <= held
    return rows.select("gpsno", "label", F.when(is_held, "holdout").otherwise("development").alias("part"),
                       F.when(~is_held, (F.col("_no") - held - 1) % folds).cast("int").alias("fold"))


def audit_split(reference: DataFrame, split: DataFrame, folds: int) -> DataFrame:
    """Rule table (rule, violations): disjoint, complete, both classes in every fold."""
    per_id = split.groupBy("gpsno").agg(F.count(F.lit(1)).alias("n"))
    joined = (reference.select("gpsno", F.col("label").alias("label_now"))
              .join(split.select("gpsno", "label", "part", "fold"), "gpsno", "full"))
    one = joined.agg(
        F.count_if(F.col("part").isNull()).alias("unassigned"),
        F.count_if(F.col("label_now").isNull()).alias("unknown_entity"),
        F.count_if(F.col("label_now") != F.col("label")).alias("label_changed"),
        F.count_if((F.col("part") == "development") & F.col("fold").isNull()).alias("development_without_fold"),
        F.count_if((F.col("part") == "holdout") & F.col("fold").isNotNull()).alias("holdout_in_fold"))
    twice = per_id.agg(F.count_if(F.col("n") > 1).alias("assigned_twice"))
    classes = (split.where("fold is not null").groupBy("fold").agg(F.countDistinct("label").alias("k"))
               .agg((F.lit(folds) - F.count_if(F.col("k") == 2)).alias("fold_missing_class")))
    parts = [rule_rows(one, one.columns), rule_rows(twice, twice.columns), rule_rows(classes, classes.columns)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rule_rows(row: DataFrame, names: list[str]) -> DataFrame:
    items = [F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n).cast("long"), F.lit(0)).alias("violations")) for n in names]
    return row.select(F.explode(F.array(*items)).alias("_x")).select("_x.*")
