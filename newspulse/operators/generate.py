"""Synthetic customer tables: every value is a function of (row, column, seed), not of partitioning."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newspulse.functions import columns as C

FIRST_NAMES = "Anna Emma Ida Freja Clara Karen Mette Lars Peter Jens Søren Niels Oscar Noah Emil Viggo".split()
LAST_NAMES = "Jensen Nielsen Hansen Pedersen Andersen Larsen Madsen Kjær Holm Dahl Lund Bach".split()
STREETS = "Nørregade Søndergade Skolevej Kirkevej Møllevej Bakkevej Engvej Skovvej Havnegade".split()
CITIES = [  # city, latitude, longitude
    ("København", 55.68, 12.57), ("Aarhus", 56.16, 10.20), ("Odense", 55.40, 10.39), ("Aalborg", 57.05, 9.92),
    ("Esbjerg", 55.47, 8.45), ("Randers", 56.46, 10.04), ("Kolding", 55.49, 9.47), ("Roskilde", 55.64, 12.08),
]

UNIT = 1 << 53


def _uniform(name: str, seed: int) -> Column:
    """Uniform in [0, 1) from the row number, the column name and the seed."""
    h = F.xxhash64(F.col("_row"), F.lit(name), F.lit(seed))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(UNIT))


def _integer(name: str, seed: int, n: int | Column) -> Column:
    return F.floor(_uniform(name, seed) * n)


def _pick(pool: list[str], name: str, seed: int) -> Column:
    values = F.array(*[F.lit(v) for v in pool])
    return F.element_at(values, (_integer(name, seed, len(pool)) + 1).cast("int"))


def _normal(name: str, seed: int, mean: float, sd: float) -> Column:
    radius = F.sqrt(-2 * F.log(F.lit(1.0) - _uniform(f"{name}/r", seed)))
    return F.lit(mean) + F.lit(sd) * radius * F.cos(_uniform(f"{name}/a", seed) * (2 * math.pi))


def customers(
    spark: SparkSession,
    competitors: list[str],
    n: int = 5000,
    today: date | None = None,
    min_age: int = 18,
    max_age: int = 115,
    company_start: date = date(2010, 1, 1),
    churn_rate: int = 25,
    seed: int = 0,
) -> DataFrame:
    """``n`` customers before clean-up: start and churn date are drawn independently of each other."""
    now = F.lit(today) if today else F.current_date()
    start = F.lit(company_start)
    youngest = F.add_months(now, -12 * min_age)
    age_days = F.datediff(youngest, F.add_months(now, -12 * max_age))
    open_days = F.datediff(now, start) + 1
    city = F.element_at(
        F.array(*[F.struct(F.lit(c).alias("city"), F.lit(la).alias("lat"), F.lit(lo).alias("lng")) for c, la, lo in CITIES]),
        (_integer("city", seed, len(CITIES)) + 1).cast("int"),
    )
    first, last = _pick(FIRST_NAMES, "first", seed), _pick(LAST_NAMES, "last", seed)
    number = lambda name, size: _integer(name, seed, size).cast("long")
    post_code = F.lpad((number("post", 9000) + 1000).cast("string"), 4, "0")
    return (
        spark.range(n)
        .select(F.col("id").alias("_row"))
        .select(
            number("id", 100_000).alias("id"),
            F.concat_ws(" ", first, last).alias("name"),
            F.concat_ws(" ", _pick(STREETS, "street", seed), (number("house", 200) + 1).cast("string")).alias("address"),
            city["city"].alias("city"),
            post_code.alias("post_code"),
            F.struct(city["lat"].alias("lat"), city["lng"].alias("lng"), city["city"].alias("place")).alias("location"),
            F.concat(F.lower(F.translate(first, "ø", "o")), number("mail", 10_000).cast("string"), F.lit("@example.com")).alias("email"),
            F.concat(F.lit("+45 "), F.lpad((number("phone", 80_000_000) + 20_000_000).cast("string"), 8, "0")).alias("phone"),
            F.date_sub(youngest, _integer("birth", seed, age_days).cast("int")).alias("birth_date"),
            F.date_add(start, _integer("start", seed, open_days).cast("int")).alias("start_date"),
            (_uniform("churn", seed) < churn_rate / 100).alias("churn"),
            F.date_add(start, _integer("churn_date", seed, open_days).cast("int")).alias("churn_date"),
            _uniform("churn_probability", seed).alias("churn_probability"),
            _pick(competitors, "competitor", seed).alias("competitor"),
            _normal("customer_value", seed, 25_000.0, 10_000.0).alias("customer_value"),
        )
    )


def clean_up(df: DataFrame, today: Column | None = None) -> DataFrame:
    """No churn date for customers who stay; age in whole years."""
    now = today if today is not None else F.current_date()
    return df.withColumn("churn_date", C.keep_when("churn", "churn_date")).withColumn(
        "age", C.age_years("birth_date", now)
    )
