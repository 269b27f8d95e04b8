"""Tenant-scoped listings, filters and redaction."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.plans.balance import top_k, with_totals

LIST_COLUMNS = [
    "id", "cnpj", "company_name", "status", "opportunity_score", "revenue_estimate", "employees", "industry", "city",
    "state", "trade_name", "cnpj_email", "cnpj_phones", "cnpj_partners", "cnpj_opened_at", "cnpj_legal_nature",
    "enrichment_status", "enrichment_source", "enrichment_error", "enrichment_version", "enrichment_summary",
    "enriched_at", "created_at", "updated_at", "org_id",
]
SCORE_COLUMNS = [
    "id", "cnpj", "company_name", "status", "opportunity_score", "revenue_estimate", "employees", "industry",
    "created_at",
]


def _have(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def list_recent(df: DataFrame, org_col: str, ts_col: str, cols: list[str], id_col: str = "id") -> DataFrame:
    """Newest first inside each tenant, with the tenant's row count.

    The range sort keys include the row id, so a crowded tenant spreads over many partitions.
    """
    counted = with_totals(df.select(*dict.fromkeys([org_col, *cols, ts_col, id_col])), [org_col],
                          total=F.count(F.lit(1)))
    return counted.orderBy(org_col, F.col(ts_col).desc_nulls_first(), id_col)


def prospect_list(prospects: DataFrame) -> DataFrame:
    return list_recent(prospects, "org_id", "created_at", _have(prospects, LIST_COLUMNS))


def prospect_list_by_score(prospects: DataFrame) -> DataFrame:
    cols = _have(prospects, SCORE_COLUMNS)
    return prospects.select("org_id", *cols).orderBy("org_id", F.col("opportunity_score").desc_nulls_first(), "id")


def plan_redact(df: DataFrame, orgs: DataFrame, org_col: str = "org_id") -> DataFrame:
    """Null the withheld fields of rows whose tenant is not premium, and say so."""
    # A plain join: Spark sends a small list of tenants to every task by its size, and splits crowded tenants otherwise.
    plans = orgs.filter(F.col("plan") == "premium").select(F.col("id").alias(org_col), F.lit(True).alias("__plan"))
    premium = F.coalesce("__plan", F.lit(False))
    hidden = {c: F.when(F.col("__premium"), F.col(c)) for c in fixed.RESTRICTED_FIELDS if c in df.columns}
    return (df.join(plans, org_col, "left").withColumn("__premium", premium)
            .withColumns({**hidden, "data_restricted": ~F.col("__premium")})
            .drop("__plan", "__premium"))


def _bound(text: str, last: bool) -> Column:
    """Date-only bounds cover the whole UTC day."""
    if len(text) == 10:
        day = datetime.fromisoformat(text)
        if last:
            day = day + timedelta(days=1) - timedelta(milliseconds=1)
        text = day.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def _between(c: str, frm: str | None, to: str | None) -> Column:
    cond = F.lit(True)
    if frm:
        cond = cond & (F.col(c) >= _bound(frm, False))
    if to:
        cond = cond & (F.col(c) <= _bound(to, True))
    return cond


def enriched_contact_list(prospects: DataFrame, frm: str | None = None, to: str | None = None,
                          status: str | None = None) -> DataFrame:
    """Contact projection of leads enriched in a date range, newest first."""
    rows = prospects.filter(_between("enriched_at", frm, to))
    if status and status != "all":
        rows = rows.filter(F.col("enrichment_status") == status)
    names = {"cnpj_email": "email", "cnpj_phones": "phones", "cnpj_partners": "partners",
             "cnpj_opened_at": "opened_at", "cnpj_legal_nature": "legal_nature"}
    cols = ["org_id", "id", "cnpj", "company_name", "trade_name", "industry", "status", "opportunity_score",
            "cnpj_email", "cnpj_phones", "cnpj_partners", "cnpj_opened_at", "cnpj_legal_nature", "enrichment_status",
            "enrichment_source", "enrichment_error", "enriched_at", "created_at"]
    return (rows.select(*[F.col(c).alias(names.get(c, c)) for c in _have(rows, cols)])
            .orderBy(F.col("enriched_at").desc_nulls_first(), "id"))


def enrichment_backlog(prospects: DataFrame, frm: str | None = None, to: str | None = None, refresh: bool = False,
                       limit: int | None = None) -> DataFrame:
    """Newest leads per tenant that still need enrichment; ``limit`` bounds each tenant's rows, none does by default."""
    rows = prospects.filter(_between("created_at", frm, to))
    if not refresh:
        rows = rows.filter(F.col("enrichment_status").isin("pending", "error", "unavailable") | F.col("enriched_at").isNull())
    if limit is None:
        return rows
    if limit < 1:
        raise ValueError("limit must be positive")
    return top_k(rows, ["org_id"], [F.col("created_at").desc_nulls_first(), F.col("id")], limit, spread=True)


def prospect_facets(prospects: DataFrame, as_of: str, text: str = "", status: str = "all", industry: str = "all",
                    location: str = "", size: str = "all", age: str = "all", situation: str = "all",
                    use_opened: bool = False) -> DataFrame:
    """AND of the directory facets; plain predicates that reach the scan where they can."""
    q, place = text.strip().lower(), location.strip().lower()
    cond = F.lit(situation in ("all", "active"))
    if status != "all":
        cond = cond & (F.col("status") == status)
    if industry != "all":
        cond = cond & (F.col("industry") == industry)
    if q:
        cond = cond & F.lower(F.concat_ws(" ", "company_name", "industry", "trade_name")).contains(q)
    if place:
        cond = cond & F.lower(F.concat_ws(" ", "city", "state")).contains(place)
    staff = F.coalesce("employees", F.lit(0))
    sizes = {"small": staff <= 50, "medium": (staff > 50) & (staff <= 250), "large": staff > 250}
    if size != "all":
        cond = cond & sizes[size]
    year = int(as_of[:4])
    since = F.coalesce(F.year("cnpj_opened_at" if use_opened else "created_at"), F.lit(year))
    years = F.greatest(F.lit(0), F.lit(year) - since)
    ages = {"new": years <= 2, "growing": (years > 2) & (years <= 10), "established": years > 10}
    if age != "all":
        cond = cond & ages[age]
    return prospects.filter(cond)


def contact_search(contacts: DataFrame, q: str) -> DataFrame:
    """Leads whose name, key, e-mail or any partner name contains the text."""
    q = q.lower().strip()
    if not q:
        return contacts
    return contacts.filter(
        F.lower("company_name").contains(q) | F.col("cnpj").contains(q)
        | F.lower(F.coalesce("email", F.lit(""))).contains(q)
        | F.exists("partners", lambda p: F.lower(F.coalesce(p["name"], F.lit(""))).contains(q)))
