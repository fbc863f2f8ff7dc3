"""Rental bookings and trip fares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import mean_or
from ..operators.hotkeys import join_dimension

DEFAULT_FARE = 99.0


def revenue_by_destination(
    bookings: DataFrame, properties: DataFrame, destinations: DataFrame, reviews: DataFrame, dedupe: bool = False
) -> DataFrame:
    """Bookings, revenue and average rating per destination.

    As asked for by default, a booking with n reviews adds its amount n times. The reviews are
    reduced to a count and a sum per booking, so that multiplication happens without repeating rows.
    `dedupe` adds each booking once.
    """
    per_booking = reviews.groupBy("booking_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("stars"), F.count("rating").alias("rated")
    )
    named = destinations.select("destination_id", "destination", "country")
    places = join_dimension(properties.select("property_id", "destination_id"), named, ["destination_id"])
    times = F.lit(1) if dedupe else F.coalesce("n", F.lit(1))
    return (
        bookings.select("booking_id", "property_id", "total_amount")
        .join(per_booking, "booking_id", "left")
        .join(places, "property_id")
        .groupBy("destination", "country")
        .agg(
            F.countDistinct("booking_id").alias("total_bookings"),
            F.round(F.sum(F.col("total_amount") * times), 2).alias("total_revenue"),
            F.round(F.try_divide(F.sum("stars"), F.sum("rated")), 1).alias("avg_rating"),
        )
    )


def top_destinations(revenue: DataFrame, n: int) -> DataFrame:
    """The n destinations with the most revenue."""
    return revenue.orderBy(F.col("total_revenue").desc(), "destination", "country").limit(int(n))


def booking_detail(bookings: DataFrame, users: DataFrame, properties: DataFrame, destinations: DataFrame, booking_id=None) -> DataFrame:
    """Bookings with guest, property and destination names (one booking, or all)."""
    rows = bookings if booking_id is None else bookings.where(F.col("booking_id") == booking_id)
    guests = users.select("user_id", F.col("name").alias("guest_name"), F.col("email").alias("guest_email"))
    homes = properties.select("property_id", F.col("title").alias("property_title"), "destination_id")
    homes = join_dimension(homes, destinations.select("destination_id", "destination"), ["destination_id"])
    return (
        rows.join(guests, "user_id")
        .join(homes, "property_id")
        .select(
            "booking_id", "status", "check_in", "check_out", "guests_count", "total_amount",
            "guest_name", "guest_email", "property_title", "destination",
        )
    )


def expected_fares(trips: DataFrame, pairs: DataFrame, default: float = DEFAULT_FARE) -> DataFrame:
    """Mean fare per requested (pickup_zip, dropoff_zip), the default where no trip exists."""
    means = trips.groupBy("pickup_zip", "dropoff_zip").agg(F.avg("fare_amount").alias("mean"))
    joined = pairs.join(means, ["pickup_zip", "dropoff_zip"], "left")
    return joined.select("pickup_zip", "dropoff_zip", F.coalesce("mean", F.lit(default)).alias("fare"))


def expected_fare(trips: DataFrame, pickup: int, dropoff: int, default: float = DEFAULT_FARE) -> DataFrame:
    """One row with the mean fare of a pair, or the default."""
    rows = trips.where((F.col("pickup_zip") == pickup) & (F.col("dropoff_zip") == dropoff))
    return rows.agg(mean_or(F.col("fare_amount"), default).alias("fare"))


# Month, number, revenue, expenses, customers of the sample table.
MONTHS = [
    ("January", 1, 65000, 45000, 850),
    ("February", 2, 72000, 48000, 920),
    ("March", 3, 78000, 52000, 1050),
    ("April", 4, 85000, 55000, 1180),
    ("May", 5, 92000, 58000, 1320),
    ("June", 6, 88000, 54000, 1250),
    ("July", 7, 95000, 60000, 1380),
    ("August", 8, 89000, 56000, 1290),
    ("September", 9, 82000, 53000, 1150),
    ("October", 10, 87000, 55000, 1220),
    ("November", 11, 93000, 59000, 1340),
    ("December", 12, 98000, 62000, 1420),
]


def sample_months(spark: SparkSession) -> DataFrame:
    """The literal monthly table."""
    return spark.createDataFrame(MONTHS, "month string, month_num int, revenue int, expenses int, customers int")


def months_until(months: DataFrame, last_month: int) -> DataFrame:
    """Months up to a parameter bound by name."""
    return months.sparkSession.sql(
        "SELECT * FROM {months} WHERE month_num <= :last_month ORDER BY month_num", args={"last_month": int(last_month)}, months=months
    )
