"""Graphs of entities and relations: rollups, components, and searches around places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralace.sources.tables import written


def entity_rollup(links: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """One row per entity: counts by status, sums, first and last time, and the last ten sessions.

    ``links``: entity_id, status, confidence, seen_at, session_id. A status outside the list counts in
    observation_count only. Sessions are ordered by their last time at the entity; the ten are kept by an aggregation
    of (entity, session) rows, so a hot entity is not collected row by row.
    """
    by_session = links.groupBy("entity_id", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("conf"), F.min("seen_at").alias("first"), F.max("seen_at").alias("last"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
    )
    sums = by_session.groupBy("entity_id").agg(
        F.sum("n").alias("observation_count"), F.round(F.sum("conf"), 4).alias("confidence_sum"), F.min("first").alias("first_seen"),
        F.max("last").alias("last_seen"), F.count_distinct("session_id").alias("n_sessions"), *[F.sum(s).alias(f"n_{s}") for s in statuses],
    )
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("last"), "session_id"))
    recent = by_session.where("session_id IS NOT NULL").withColumn("place", place).where("place <= 10").groupBy("entity_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "session_id"))), lambda x: x["session_id"]), ",").alias("last_sessions")
    )
    return sums.join(recent, "entity_id", "left")


def undirected(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Undirected edges with summed weights: a < b; loops and null ends are dropped."""
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return ends.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(weight).alias("weight"))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of edges (a, b): node, component (the smallest node of the component).

    Alternates large-star and small-star steps, which need a number of rounds that grows with the logarithm of the
    longest path, until every component is a star. Each round is written to the shared folder. Repeated edges and loops are fine;
    edges with a null end are dropped. No edge gives an empty result.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    nodes = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    pairs = written(both.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(limit):
        # large star: the larger neighbours of a node go to the smallest of its neighbourhood
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        large = written(large, "large-star")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.withColumnRenamed("m", "v"))
        pairs = written(small.where("u <> v").distinct(), "small-star")
        # done when all components are stars: every node has one centre, and no centre has one itself
        twice = pairs.groupBy("u").count().where("count > 1")
        chained = pairs.join(pairs.select(F.col("v").alias("u")), "u", "left_semi")
        if twice.isEmpty() and chained.isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {limit} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def community_rollup(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Per component: members, entity types, and total of their observation counts."""
    joined = members.join(entities, members["node"] == entities["id"], "left")
    return joined.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("entity_type") == "asset").alias("n_assets"),
        F.count_if(F.col("entity_type") == "location").alias("n_locations"), F.sum("observation_count").alias("n_observations"),
    )


def overlapping_communities(members: DataFrame, local: DataFrame, k: int = 5) -> DataFrame:
    """Communities by overlap with a local set of nodes: component, overlap, n_members; the first ``k``."""
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"))
    shared = members.join(local.select("node").distinct(), "node").groupBy("component").agg(F.count(F.lit(1)).alias("overlap"))
    return shared.join(size, "component").orderBy(F.desc("overlap"), F.desc("n_members"), "component").limit(k)


def extract(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of links: two compact tables, the same whatever order the links come in.

    ``links``: session_id, place (a cell), slug (a class in lower case), status, confidence, seen_at. Entities: id,
    entity_type, observation_count, confidence_sum, first_seen, last_seen; every link belongs to its place (``loc:``)
    and to its class there (``asset:``). Relations: source_id, target_id, relation_type, n, confidence_sum:
    ``found_at`` from asset to place, with a link each, and ``co_occurred_with`` between two assets of one place, once
    with the smaller id first, with the sessions they were both seen in. A null place has neither; a null session is in
    no joint sighting.
    """
    rows = links.where("place IS NOT NULL").withColumns(
        {"loc": F.concat(F.lit("loc:"), "place"), "asset": F.concat(F.lit("asset:"), "slug", F.lit(":"), "place")}
    )
    both = F.explode(F.array(F.struct(F.col("loc").alias("id"), F.lit("location").alias("entity_type")), F.struct(F.col("asset").alias("id"), F.lit("asset").alias("entity_type")))).alias("e")
    entities = rows.select(both, "confidence", "seen_at").groupBy("e.id", "e.entity_type").agg(
        F.count(F.lit(1)).alias("observation_count"), F.sum("confidence").alias("confidence_sum"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )
    found = rows.groupBy(F.col("asset").alias("source_id"), F.col("loc").alias("target_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence_sum"))
    seen = rows.where("session_id IS NOT NULL").select("session_id", "place", "asset").distinct()
    other = seen.withColumnRenamed("asset", "asset_b")
    # the assets of one session at one place are as few as classes
    joint = seen.join(other, ["session_id", "place"]).where("asset < asset_b").groupBy(F.col("asset").alias("source_id"), F.col("asset_b").alias("target_id"))
    joint = joint.agg(F.count(F.lit(1)).alias("n")).withColumn("confidence_sum", F.lit(None).cast("double"))
    relations = found.withColumn("relation_type", F.lit("found_at")).unionByName(joint.withColumn("relation_type", F.lit("co_occurred_with")))
    return entities, relations


def relation_rollup(relations: DataFrame) -> DataFrame:
    """One row per source, target and type: n added up, first and last time, and the set of locations in order.

    ``relations``: source_id, target_id, kind, n, created_at, updated_at, locations (array). Null ends are kept.
    """
    places = relations.select("source_id", "target_id", "kind", F.explode_outer("locations").alias("place")).groupBy("source_id", "target_id", "kind")
    places = places.agg(F.array_sort(F.collect_set("place")).alias("locations"))  # distinct places before they are gathered
    sums = relations.groupBy("source_id", "target_id", "kind").agg(F.sum("n").alias("n"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    keys = ["source_id", "target_id", "kind"]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return sums.alias("a").join(places.alias("b"), same[0] & same[1] & same[2]).select(*[f"a.{k}" for k in keys], "n", "created_at", "updated_at", "locations")


def community_profile(members: DataFrame, entities: DataFrame, top: int = 4) -> DataFrame:
    """Per component: its commonest classes as a label, how many cells it lies in, and the sum of observations.

    ``members``: node, component; ``entities``: id, object_class, cell, observation_count. A class counts with its
    observations, an entity without a count with one. Ties go to the class that comes first.
    """
    rows = members.join(entities, members["node"] == entities["id"]).select("component", "object_class", "cell", "observation_count")
    counts = rows.groupBy("component", "object_class").agg(F.sum(F.coalesce("observation_count", F.lit(1))).alias("n"))
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "object_class"))
    best = counts.where("object_class IS NOT NULL").withColumn("place", place).where(F.col("place") <= top)
    part = F.concat("object_class", F.lit("("), F.col("n").cast("string"), F.lit(")"))
    labels = best.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]), ", ").alias("label"))
    sums = rows.groupBy("component").agg(F.count_distinct("cell").alias("n_cells"), F.sum(F.coalesce("observation_count", F.lit(0))).alias("n_observations"))
    return sums.join(labels, "component", "left")


def context(near: DataFrame, key: str, cap: int = 12, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """What is known around places, as two tables: the most observed entities of each, and its class totals.

    ``near``: ``key``, id, object_class, observation_count, of the entities near each place. First: key, place (rank), id,
    object_class, observation_count, the ``cap`` most observed. Second: key, object_class, n_entities, total, the ``top``
    classes by total. Ties go to the smaller id or class.
    """
    rows = near.withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
    order = Window.partitionBy(key).orderBy(F.desc("observation_count"), "id")
    listed = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select(key, "place", "id", "object_class", "observation_count")
    totals = rows.groupBy(key, "object_class").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("observation_count").alias("total"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("total"), "object_class"))
    return listed, totals.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


class GraphIndex:
    """A graph kept in a folder: entities and relations by key, indexed batch by batch.

    Every batch of links is written as a part of its own; what is read adds the parts up, so a batch that is indexed
    again under its name takes the place of its earlier rows, and no batch rewrites another.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def index(self, links: DataFrame, batch: str) -> None:
        """Add the links of a batch, or put them in the place of the batch of that name."""
        for name, rows in zip(("entities", "relations"), extract(links)):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def reindex(self, batches: dict[str, DataFrame]) -> None:
        """Start again from these batches."""
        self.clear()
        for batch, links in batches.items():
            self.index(links, batch)

    def entities(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/entities")
        return rows.groupBy("id", "entity_type").agg(
            F.sum("observation_count").alias("observation_count"), F.sum("confidence_sum").alias("confidence_sum"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
        )

    def relations(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/relations")
        return rows.groupBy("source_id", "target_id", "relation_type").agg(F.sum("n").alias("n"), F.sum("confidence_sum").alias("confidence_sum"))

    def stats(self) -> DataFrame:
        """How many entities and relations there are of each type: kind, n, total."""
        e = self.entities().groupBy(F.col("entity_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("observation_count").alias("total"))
        return e.unionByName(self.relations().groupBy(F.col("relation_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")))

    def clear(self) -> None:
        """Remove all batches."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
