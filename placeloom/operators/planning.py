"""Itineraries from ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_upper

#: Time slots (fixed values).
RELAXED = ("10:00-12:00", "14:00-15:30", "16:00-17:30", "19:00-20:30")
COMPACT = ("09:00-10:30", "11:00-12:30", "14:00-15:30", "16:00-17:30")
#: What is assumed where a traveller says nothing (fixed values).
DEFAULTS = {"city": "Unknown city", "duration": "1 day", "budget": "medium", "pace": "relaxed"}


#: What a stop's reason says, with and without a matching interest (fixed values).
MATCHES, CHOSEN = "Matches user interest in ", "Selected from visual search candidates and user preferences."


def preferences(df: DataFrame) -> DataFrame:
    """``df`` with all preferences; null and absent ones get the default."""
    absent = lambda c: F.col(c) if c in df.columns else F.lit(None)
    out = {c: F.coalesce(absent(c).cast("string"), F.lit(v)) for c, v in DEFAULTS.items()}
    return df.withColumns(out | {"interests": F.coalesce(absent("interests").cast("array<string>"), F.array().cast("array<string>"))})


def slot(index: Column, pace: Column) -> Column:
    """The time of the candidate at ``index`` (from 0); slots repeat after four."""
    at = F.pmod(index, F.lit(4)).cast("int")
    return F.when(pace == "relaxed", F.get(F.array(*map(F.lit, RELAXED)), at)).otherwise(F.get(F.array(*map(F.lit, COMPACT)), at))


def reason(category: Column, interests: Column) -> Column:
    kind = F.lower(category)
    wanted = F.exists(interests, lambda x: F.lower(x) == kind)
    return F.when((kind != "") & wanted, F.concat(F.lit(MATCHES), kind, F.lit("."))).otherwise(CHOSEN)


def summary(pace: Column, duration: Column, city: Column) -> Column:
    return F.concat(first_upper(pace), F.lit(" "), duration, F.lit(" itinerary for "), city, F.lit("."))


def itineraries(candidates: DataFrame, trips: DataFrame, order: str = "ord") -> DataFrame:
    """One row per trip: itinerary (array of stops in order), summary, assumptions, confidence.

    ``candidates`` has trip_id, name, category and an order; ``trips`` trip_id and preferences. A
    trip without candidates has an empty itinerary.
    """
    wanted = preferences(trips)
    w = Window.partitionBy("trip_id").orderBy(order)
    stops = candidates.withColumn("_i", F.row_number().over(w) - 1).join(wanted.select("trip_id", "pace", "interests"), "trip_id")
    stop = F.struct("_i", slot(F.col("_i"), F.col("pace")).alias("time"), F.coalesce("name", F.lit("Unknown POI")).alias("poi_name"), F.coalesce("category", F.lit("POI")).alias("poi_type"), reason(F.coalesce("category", F.lit("")), F.col("interests")).alias("reason"))
    packed = stops.groupBy("trip_id").agg(F.array_sort(F.collect_list(stop)).alias("_s"))
    plain = F.transform("_s", lambda s: s.dropFields("_i"))
    out = wanted.join(packed, "trip_id", "left")
    return out.select(
        "trip_id", F.coalesce(plain, F.array().cast("array<struct<time:string,poi_name:string,poi_type:string,reason:string>>")).alias("itinerary"), summary(F.col("pace"), F.col("duration"), F.col("city")).alias("summary"),
        F.array(F.lit("Stops come from the catalog that was searched.")).alias("assumptions"), F.when(F.col("_s").isNotNull(), 0.72).otherwise(0.3).alias("confidence"),
    )
