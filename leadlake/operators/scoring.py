"""Rule scores: credit risk, qualification, ideal-customer fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import clamp, half_up, present

YEAR_MICROS = 31_557_600_000_000  # 365.25 days


def band(value: Column, steps: list[tuple[int, int]]) -> Column:
    """Points of the first threshold reached; 0 below all of them."""
    out = None
    for low, points in steps:
        out = F.when(value >= low, points) if out is None else out.when(value >= low, points)
    return out.otherwise(0)


def credit_risk_score(prospects: DataFrame, as_of: str, phones: str = "has_phone") -> DataFrame:
    """Score 0-100, level, factor list and company age at ``as_of``.

    ``phones`` is a boolean column or an array column.
    """
    has_phone = F.size(phones) > 0 if dict(prospects.dtypes)[phones].startswith("array") else F.coalesce(phones, F.lit(False))
    now = F.unix_micros(F.lit(as_of).cast("timestamp"))
    age = now - F.unix_micros(F.col("cnpj_opened_at").cast("timestamp"))
    years = F.when(age.isNotNull(), F.greatest(F.lit(0), age))
    y = YEAR_MICROS
    age_points = F.when(age.isNull() | (age < 0), 0).otherwise(band(age, [(10 * y, 30), (5 * y, 24), (2 * y, 16), (y, 8), (0, 2)]))
    staff, revenue = F.coalesce("employees", F.lit(0)), F.coalesce("revenue_estimate", F.lit(0))
    email = present("cnpj_email").isNotNull()
    verified = F.coalesce(F.col("enrichment_status") == "enriched", F.lit(False))
    potential = F.expr("(coalesce(opportunity_score, 0) * 35 + 50) div 100")
    score = (F.lit(50) + potential + band(staff, [(500, 15), (100, 12), (20, 8), (5, 4)])
             + band(revenue, [(5_000_000, 20), (1_000_000, 15), (250_000, 10), (50_000, 5)]) + age_points
             + F.when(verified, 10).otherwise(0) + F.when(email, 5).otherwise(0) + F.when(has_phone, 5).otherwise(0))
    factors = F.array_compact(F.array(
        F.when(years.isNull(), "company_age_unknown").when(years >= 10 * y, "company_longevity")
         .when(years >= 2 * y, "company_age").otherwise("company_recent"),
        F.when(email, "corporate_email_present"), F.when(has_phone, "phone_present"),
        F.when(verified, "officially_enriched"), F.when(staff >= 100, "company_size"),
        F.when(revenue >= 1_000_000, "revenue_potential")))
    tenths = half_up(years.cast("double") * 10 / F.lit(float(y))).cast("long")
    return prospects.withColumn("risk_score", clamp(score, 0, 100).cast("int")).withColumns({
        "risk_level": F.when(F.col("risk_score") >= 70, "low").when(F.col("risk_score") >= 40, "medium").otherwise("high"),
        "factors": F.when(F.size(factors) > 0, factors).otherwise(F.array(F.lit("insufficient_data"))),
        "age_tenths": F.when(years > 0, tenths),
    })


def lead_qualify(prospects: DataFrame) -> DataFrame:
    """Level from the stored score and confidence from how complete the record is."""
    score = clamp(F.coalesce("opportunity_score", F.lit(0)), 0, 100)
    known = present("cnpj_email").isNotNull() | present("cnpj_legal_nature").isNotNull()
    return prospects.withColumns({
        "score": score,
        "level": F.when(score >= 70, "qualified").when(score >= 40, "prospect").otherwise("lead"),
        "confidence": F.when(F.col("enrichment_status") == "enriched", "0.90").when(known, "0.65").otherwise("0.50"),
    })


def icp_qualify(prospects: DataFrame) -> DataFrame:
    """Fit from segment, staff and revenue; the level looks at the uncapped sum."""
    def points(cond, n):
        return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)

    raw = (F.lit(50) + points(F.col("industry").isin(fixed.TECH_SEGMENTS), 20)
           + points(F.col("employees") >= 100, 15) + points(F.col("employees") >= 500, 10)
           + points(F.col("revenue_estimate") >= 1_000_000, 15) + points(F.col("revenue_estimate") >= 5_000_000, 10))
    return prospects.withColumns({
        "icp_score": F.least(F.lit(100), raw),
        "icp_level": F.when(raw >= 75, "qualified").when(raw >= 50, "prospect").otherwise("lead"),
    })
