"""Mixed timestamp notations and zones, made into unambiguous instants.

Each text is read under every notation, date order, unit and occurrence of its wall time that it fits: its readings.
Which kinds of reading a source writes is a latent mixture per source, fitted by expectation-maximisation: every text
gives each of its readings a share of its likelihood, the shares make the source's weights, and the posterior of a text
chooses its reading or marks it as ambiguous. What is known beforehand enters as the prior of a reading: a declared date
order leaves nothing to the other orders, an instant outside the years of the data is impossible, and of a wall time
that occurs twice the earlier instant is meant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralace.functions.instants import ORDERS, read
from terralace.sources.tables import small_enough, written

ITERATIONS, SETTLED = 200, 1e-9
#: Readings of a kind that every source is taken to have written beforehand.
PSEUDO_COUNT = 1e-3
#: Years before and after those seen in texts with a date that a bare number may fall into.
YEAR_MARGIN = 1


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        got = [read(t, z) for t, z in zip(batch["raw"], batch["time_zone"])]
        out = batch[["rec_table", "rec_id", "source", "declared"]].copy()
        out["notation"] = [name for name, _ in got]
        out["kinds"] = [[k for k, _ in found] for _, found in got]
        out["instants"] = [[us for _, us in found] for _, found in got]
        yield out


def readings(records: DataFrame) -> DataFrame:
    """Read each text under all notations. ``records``: rec_table, rec_id, source, raw, time_zone, declared.

    Adds notation and, side by side, kinds and instants (see ``terralace.functions.instants.read``). Null, empty and
    unreadable texts have no notation and empty lists. Other columns are left out.
    """
    columns = ["rec_table", "rec_id", "source", "declared", "raw", "time_zone"]
    schema = "rec_table string, rec_id string, source string, declared string, notation string, kinds array<string>, instants array<long>"
    return records.select(*[F.col(c).cast("string") for c in columns]).mapInPandas(_read_batches, schema)


def years_seen(read_texts: DataFrame) -> tuple[int, int] | None:
    """First and last year of the texts with one reading that is a date; null if there is none."""
    dated = read_texts.where("size(instants) = 1 AND notation <> 'number'")
    year = F.year(F.timestamp_micros(F.get("instants", F.lit(0))))
    low, high = dated.agg(F.min(year), F.max(year)).first()
    return None if low is None else (low, high)


def with_priors(read_texts: DataFrame, years: tuple[int, int] | None, earlier: bool) -> DataFrame:
    """Add ``found``: the readings as (kind, us, prior). ``years``: what bare numbers may fall into, both included."""
    order = F.upper("declared")

    def prior(kind: Column, us: Column) -> Column:
        other = kind.startswith("numeric:") & F.coalesce(F.split_part(kind, F.lit(":"), F.lit(2)) != order, F.lit(False))
        year = F.year(F.timestamp_micros(us))
        outside = kind.startswith("number:") & (~year.between(*years) if years else F.lit(False))
        second = kind.endswith(":later") & F.lit(earlier)
        return F.when(other | outside | second, 0.0).otherwise(1.0)

    both = F.zip_with("kinds", "instants", lambda k, u: F.struct(k.alias("kind"), u.alias("us"), prior(k, u).alias("prior")))
    return read_texts.withColumn("found", both)


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """The mixture of one source; ``group`` has a row per set of readings that its texts have, with their number."""
    sets = [([c["kind"] for c in found if c["prior"] > 0], [c["prior"] for c in found if c["prior"] > 0], int(n)) for found, n in zip(group["found"], group["n"])]
    kinds = sorted({k for ks, _, _ in sets for k in ks})
    weights = dict.fromkeys(kinds, 1 / max(1, len(kinds)))
    for _ in range(ITERATIONS):
        mass = dict.fromkeys(kinds, PSEUDO_COUNT)
        for ks, priors, n in sets:
            shares = [weights[k] * p for k, p in zip(ks, priors)]
            total = sum(shares)
            for k, s in zip(ks, shares):
                mass[k] += n * s / total if total else 0
        whole = sum(mass.values())
        new = {k: m / whole for k, m in mass.items()}
        moved = max((abs(new[k] - weights[k]) for k in kinds), default=0.0)
        weights = new
        if moved <= SETTLED:
            break
    return pd.DataFrame({"source": group["source"].iloc[0], "kind": kinds, "weight": [weights[k] for k in kinds]})


def mixtures(found: DataFrame) -> DataFrame:
    """Fit the mixture of every source over the texts of ``with_priors``: source, kind, weight (sums to 1).

    Texts enter as counts per source and set of readings (kinds with their priors), of which there are as many as
    notations allow, so the size of a source doesn't matter. Texts without a source are in no mixture.
    """
    sets = F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["prior"].alias("prior")))
    counts = found.where("source IS NOT NULL AND size(found) > 0").groupBy("source", sets.alias("found")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").applyInPandas(_fit, "source string, kind string, weight double")


def normalise(
    records: DataFrame, sure: float = 0.9, years: tuple[int, int] | None = None, earlier: bool = True
) -> DataFrame:
    """Choose the reading of each text of ``records`` (see ``readings``): rec_table, rec_id, notation, utc_us, posterior, outcome.

    outcome is ``plain`` (one reading), ``declared`` (an all-number date of a source that declares its order),
    ``inferred`` (several readings, one with a posterior of at least ``sure``), ``ambiguous`` (several, none sure; utc_us
    is null) or ``refused`` (no reading that is possible). ``posterior`` is that of the best instant, null if refused.
    ``years``: the years that bare numbers may fall into; by default those of the dates in the table and one more
    on either side. ``earlier``: a wall time that occurs twice means the earlier instant; else it is left to
    the mixture. Repeated rows each have their row; an empty table gives an empty result.
    """
    read_texts = written(readings(records), "readings")  # the texts are parsed once
    if years is None:
        seen = years_seen(read_texts)
        years = seen and (seen[0] - YEAR_MARGIN, seen[1] + YEAR_MARGIN)
    found = with_priors(read_texts, years, earlier)
    weights = written(mixtures(found), "mixtures")
    by_source = weights.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("kind", "weight"))).alias("weights"))
    by_source = F.broadcast(by_source) if small_enough(weights) else by_source
    rows = found.join(by_source, "source", "left")
    weight = lambda kind: F.coalesce(F.element_at("weights", kind), F.lit(1.0))
    shares = F.transform("found", lambda c: F.struct(c["us"].alias("us"), (c["prior"] * weight(c["kind"])).alias("share")))
    rows = rows.withColumn("shares", F.filter(shares, lambda c: c["share"] > 0))
    total = F.aggregate("shares", F.lit(0.0), lambda s, c: s + c["share"])
    of = lambda us: F.aggregate("shares", F.lit(0.0), lambda s, c: s + F.when(c["us"] == us, c["share"]).otherwise(0.0))
    # the same instant under several kinds (05/05/2024) is no ambiguity: their shares add up
    instants = F.array_distinct(F.transform("shares", lambda c: c["us"]))
    best = F.array_max(F.transform(instants, lambda us: F.struct(of(us).alias("share"), us.alias("us"))))
    rows = rows.select("rec_table", "rec_id", "notation", "declared", F.size("found").alias("n"), best.alias("best"), total.alias("total"))
    posterior = F.least(F.try_divide("best.share", "total"), F.lit(1.0))
    outcome = (
        F.when(F.col("best").isNull(), "refused")
        .when((F.col("notation") == "numeric") & F.upper("declared").isin(*ORDERS), "declared")
        .when(F.col("n") == 1, "plain").when(posterior >= sure, "inferred").otherwise("ambiguous")
    )
    return rows.select(
        "rec_table", "rec_id", "notation", outcome.alias("outcome"), posterior.alias("posterior"), F.when(posterior >= sure, F.col("best.us")).alias("utc_us"),
    )
