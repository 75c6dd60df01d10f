"""Connected components, stable group labels and what is built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import rank_key
from ..storage import discard, stage


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` of every node of ``links(a, b)``; the root is the smallest node.

    Large-star and small-star steps in turn (Kiveris et al., "Connected components in
    MapReduce and beyond"): partial minima and equi-joins that AQE can split at a hub. Each
    round is written to the shared folder, so plans and lineage stay short.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = stage(e, name), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        last, e = e, stage(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        discard(last)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def group_labels(keys: DataFrame, links: DataFrame, prefix: str, digits: int = 24) -> DataFrame:
    """``(key, root, label)``: the label is a digest of the group's sorted members, so it
    does not depend on the order of links; a key without links is its own group."""
    found = components(links)
    rooted = keys.select("key").distinct().join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    members = F.sha2(F.array_join(F.array_sort(F.collect_list("key")), "\n"), 256)
    labels = rooted.groupBy("root").agg(F.concat(F.lit(prefix), F.substring(members, 1, digits)).alias("label"))
    return rooted.join(labels, "root").select("key", "root", "label")


def shared_value_links(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Links that join all keys with an equal value in any of the columns: a star at the
    smallest key of each value, so a value with many keys gives as many links, not pairs."""
    parts = []
    for v in values:
        some = rows.where(F.col(v).isNotNull()).select(F.col(key).alias("b"), F.col(v).cast("string").alias("v"))
        hub = some.groupBy("v").agg(F.min("b").alias("a"))
        parts.append(some.join(hub, "v").where("a <> b").select("a", "b"))
    return reduce(DataFrame.union, parts).distinct()


def representatives(labels: DataFrame, seed: str = "260905") -> DataFrame:
    """The member of each group with the smallest rank key."""
    first = Window.partitionBy("label").orderBy(rank_key("key", seed))
    return labels.withColumn("_r", F.row_number().over(first)).withColumn("representative", F.col("_r") == 1).drop("_r")


def exposed_by_owner(rows: DataFrame, alias: str, owner: str, exposed: DataFrame) -> DataFrame:
    """Rows with whether their alias is exposed, or any alias of the same owner is."""
    flagged = rows.join(exposed.select(F.col("alias").alias("_x")).distinct().withColumn("_hit", F.lit(True)), F.col(alias) == F.col("_x"), "left").drop("_x")
    direct = F.coalesce("_hit", F.lit(False))
    owners = flagged.where(direct & F.col(owner).isNotNull()).select(F.col(owner).alias("_o")).distinct().withColumn("_own", F.lit(True))
    out = flagged.join(owners, F.col(owner) == F.col("_o"), "left").drop("_o")
    return out.withColumn("exposed", direct | F.coalesce("_own", F.lit(False))).drop("_hit", "_own")


def strata(entries: DataFrame, cluster: str, cell: str) -> DataFrame:
    """``(cell, stratum)``: cells that share a cluster, directly or through others."""
    pairs = entries.select(F.col(cluster).alias("c"), F.col(cell).cast("string").alias("b")).distinct()
    hub = pairs.groupBy("c").agg(F.min("b").alias("a"))
    links = pairs.join(hub, "c").where("a <> b").select("a", "b").distinct()
    found = components(links)
    cells = pairs.select(F.col("b").alias("cell")).distinct()
    return cells.join(found.withColumnRenamed("node", "cell"), "cell", "left").select("cell", F.coalesce("root", "cell").alias("stratum"))


def ancestors(links: DataFrame, targets: DataFrame, name: str = "ancestors") -> DataFrame:
    """``(node)``: the targets and everything that leads to them over ``links(a, b)``, in rounds that
    each take one step back from what was new."""
    new = stage(targets.select("node").distinct(), name)
    found = new
    while not new.isEmpty():
        back = links.join(new.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node")).distinct()
        new = stage(back.join(found, "node", "left_anti"), name)
        found = found.union(new)
    return found
