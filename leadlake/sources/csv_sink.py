"""CSV exports. Quoting doubles embedded quotes; nulls are empty fields; no byte-order mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import lookup, present

OPTIONS = {"header": "true", "escape": '"', "quote": '"', "nullValue": "", "emptyValue": ""}
PROSPECT_COLUMNS = [
    "cnpj", "company_name", "trade_name", "status", "industry", "city", "state", "cnpj_email", "employees",
    "revenue_estimate", "opportunity_score", "created_at",
]


def write_csv(df: DataFrame, path: str) -> None:
    """One file per partition under a folder; a global sort keeps files in listing order."""
    df.write.mode("errorifexists").options(**OPTIONS).csv(path)


def read_csv(spark, path: str, ddl: str) -> DataFrame:
    return spark.read.options(**OPTIONS).schema(ddl).csv(path)


def prospect_rows(prospects: DataFrame, orgs: DataFrame) -> DataFrame:
    """Fixed export columns of premium tenants, newest first."""
    premium = orgs.filter(F.col("plan") == "premium").select(F.col("id").alias("org_id"))
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return (prospects.join(premium, "org_id", "left_semi")
            .orderBy("org_id", F.col("created_at").desc_nulls_first(), "id")
            .select("org_id", *PROSPECT_COLUMNS[:-1], stamp.alias("created_at")))


def export_prospects(prospects: DataFrame, orgs: DataFrame, path: str) -> str:
    """One sub-folder per tenant, each a download of that tenant's leads."""
    prospect_rows(prospects, orgs).write.mode("errorifexists").options(**OPTIONS).partitionBy("org_id").csv(path)
    return path


def contact_rows(contacts: DataFrame) -> DataFrame:
    """Phones and partners joined with a bar; missing names and roles read N/A."""
    na = F.lit("N/A")
    partner = F.transform("partners", lambda p: F.concat(
        F.coalesce(present(p["name"]), na), F.lit(" ("), F.coalesce(present(p["qualification"]), na), F.lit(")")))
    return contacts.select(
        "cnpj", "company_name", F.coalesce("email", F.lit("")).alias("email"),
        F.array_join("phones", " | ").alias("phones"), F.array_join(partner, " | ").alias("partners"),
        "enrichment_status", F.date_format("enriched_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("enriched_at"))


def export_contacts(contacts: DataFrame, path: str) -> str:
    write_csv(contact_rows(contacts), path)
    return path


def opportunity_rows(filtered: DataFrame) -> DataFrame:
    return filtered.select(
        F.col("company_name").alias("lead"),
        F.coalesce(present("industry"), F.lit(fixed.UNCLASSIFIED)).alias("segment"),
        F.coalesce("employees", F.lit(0)).alias("employees"),
        F.col("opportunity_score").alias("score"),
        lookup(fixed.EXPORT_STAGE_LABELS, "status", F.col("status")).alias("stage"))


def export_opportunities(filtered: DataFrame, path: str) -> str:
    write_csv(opportunity_rows(filtered), path)
    return path
