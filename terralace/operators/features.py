"""Feature tables: one row per entity from a long list of events.

Events are first aggregated by entity and event type to a compact long table (with map-side combine, so a hot entity
is a handful of rows before any shuffle), then pivoted with an explicit list of types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place_key(lat: Column, lon: Column) -> Column:
    """``LAT,LON`` with two decimals each."""
    return F.concat(F.format_string("%.2f", lat), F.lit(","), F.format_string("%.2f", lon))


def class_slug(name: Column) -> Column:
    """A class as part of an entity id: trimmed, lower case, blanks as underscores."""
    return F.translate(F.lower(F.trim(name)), " ", "_")


def event_totals(events: DataFrame, entities: Sequence[str], event_type: str, time: str) -> DataFrame:
    """The compact long table: entity_id, event_type, n, first_time, last_time.

    ``entities`` are the columns that hold the entities an event belongs to; a null entity takes no part. A null event
    type becomes ``unknown``. Null times count as events but not for first and last. No event gives an empty table.
    """
    owner = F.explode(F.array_compact(F.array(*[F.col(c) for c in entities]))).alias("entity_id")
    return (
        events.select(owner, F.coalesce(F.col(event_type), F.lit("unknown")).alias("event_type"), F.col(time).alias("t"))
        .groupBy("entity_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_time"), F.max("t").alias("last_time"))
    )


#: Column of the wide table, while it is made, for the types that are not listed.
UNLISTED = "(types not listed)"


def entity_features(totals: DataFrame, types: Sequence[str], as_of: Column | None = None) -> DataFrame:
    """Pivot the long table: entity_id, n_links, first_time, last_time, recency_days, and a total per type.

    The types are an explicit list, so no pass is spent on finding them; n_links is the sum over the wide row, in which
    the types not listed share a column that is not kept. A type without events is 0. ``as_of`` is the time that
    recency is measured from; null times give a null recency. A null entity or an empty table has no row.
    """
    listed = list(dict.fromkeys(types))
    # one shuffle of the compact table by entity serves the pivot, the times and their join; a hot entity has as many
    # rows as types
    by_entity = totals.where("entity_id IS NOT NULL").repartition("entity_id")
    times = by_entity.groupBy("entity_id").agg(F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))
    if as_of is not None:
        days = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_time").cast("timestamp"))
        times = times.withColumn("recency_days", F.round(days / 86_400_000_000, 4))
    kind = F.when(F.col("event_type").isin(listed), F.col("event_type")).otherwise(UNLISTED).alias("kind")
    wide = by_entity.select("entity_id", kind, "n").groupBy("entity_id").pivot("kind", [*listed, UNLISTED]).agg(F.sum("n"))
    named = [f"`{t.replace('`', '``')}`" for t in (*listed, UNLISTED)]
    # one expression each: hundreds of single column objects cost seconds on the driver
    n_links = f"aggregate(array({', '.join(named)}), 0L, (s, n) -> s + coalesce(n, 0L)) AS n_links"
    wide = wide.selectExpr("entity_id", n_links, *[f"coalesce({c}, 0L) AS {c}" for c in named[:-1]])
    return wide.join(times, "entity_id").selectExpr("entity_id", "n_links", *times.columns[1:], *named[:-1])


def disagreements(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows of ``stored`` (id, observation_count, first_seen) that differ from ``computed`` (entity_features).

    Result: entity_id, feature. A null differs from a value, two nulls agree; an entity without events has the count 0
    and no first time. Repeated rows of one id are reported once per feature.
    """
    both = stored.select(F.col("id").alias("entity_id"), "observation_count", "first_seen").join(
        computed.select("entity_id", "n_links", "first_time"), "entity_id", "left"
    )
    wrong = F.array_compact(
        F.array(
            F.when(~F.col("observation_count").eqNullSafe(F.coalesce(F.col("n_links"), F.lit(0))), F.lit("observation_count")),
            F.when(~F.col("first_seen").eqNullSafe(F.col("first_time")), F.lit("first_seen")),
        )
    )
    return both.select("entity_id", F.explode(wrong).alias("feature")).distinct()
