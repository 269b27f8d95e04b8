"""Pipeline, funnel, forecast and portfolio figures. All are partial aggregations by tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import half_up, present
from leadlake.plans.balance import top_k, with_totals

TICKET = 15_000


def pipeline_summary(prospects: DataFrame) -> DataFrame:
    """Counts per tenant and two rates, plain and in whole hundredths."""
    def stage(s):
        return F.count_if(F.col("status") == s)

    out = prospects.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total"), stage("qualified").alias("qualified"),
        stage("prospect").alias("prospects"), stage("lead").alias("leads"))
    rate = F.coalesce(F.try_divide(F.col("qualified").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    hundredths = F.expr("(200 * qualified + total) div (2 * total)")
    closure = F.expr("(17000 * qualified + 100 * total) div (200 * total)")
    return out.withColumns({
        "qualification_rate": rate, "qualification_pct": hundredths, "closure_pct": closure})


def status_counts(prospects: DataFrame) -> DataFrame:
    """One column per stage, zero where empty; stages outside the list count as other."""
    stages = list(fixed.STAGES)
    aggs = [F.count_if(F.col("status") == s).alias(s) for s in stages]
    other = F.count_if(~F.coalesce(F.col("status").isin(stages), F.lit(False)))
    return prospects.groupBy("org_id").agg(*aggs, other.alias("other"), F.count(F.lit(1)).alias("total"))


def status_breakdown(prospects: DataFrame) -> DataFrame:
    """Count and rounded mean score per stage; leads without a score do not weigh in."""
    out = prospects.groupBy("org_id", "status").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col("opportunity_score").cast("long")).alias("s"),
        F.count("opportunity_score").alias("n"))
    mean = F.expr("CASE WHEN n > 0 THEN floor(s / CAST(n AS DOUBLE) + 0.5D) ELSE 0 END")
    return out.withColumn("avg_score", F.coalesce(mean, F.lit(0)).cast("long")).drop("s", "n")


def revenue_forecast(prospects: DataFrame, compounded: bool = False) -> DataFrame:
    """This month from qualified leads, next month +15 %, quarter x 2.5 of this (or of next)."""
    out = prospects.groupBy("org_id").agg(F.count_if(F.col("status") == "qualified").alias("qualified"))
    out = out.withColumn("this_month", F.col("qualified") * F.lit(TICKET).cast("long"))
    out = out.withColumn("next_month", F.expr("(this_month * 115 + 50) div 100"))
    base = "next_month" if compounded else "this_month"
    return out.withColumn("quarter", F.expr(f"({base} * 25 + 5) div 10"))


def revenue_forecast_compounded(prospects: DataFrame) -> DataFrame:
    return revenue_forecast(prospects, compounded=True)


def plan_usage(orgs: DataFrame, prospects: DataFrame) -> DataFrame:
    """Plan, lead count and remaining quota of every tenant seen in either table."""
    counts = prospects.groupBy("org_id").agg(F.count(F.lit(1)).alias("leads"))
    known = orgs.select(F.col("id").alias("org_id"), F.col("plan").alias("__plan"))
    premium = F.coalesce(F.col("__plan") == "premium", F.lit(False))
    limit = F.when(~premium, F.lit(fixed.TRIAL_LEAD_LIMIT))
    leads = F.coalesce("leads", F.lit(0)).cast("long")
    return known.join(counts, "org_id", "full").select(
        "org_id", F.when(premium, "premium").otherwise("trial").alias("plan"), leads.alias("leads"),
        limit.alias("lead_limit"), F.when(~premium, F.greatest(F.lit(0), limit - leads)).cast("long").alias("remaining"),
        F.coalesce(leads >= limit, F.lit(False)).alias("at_limit"), premium.alias("can_export"))


def deal_value_impute(prospects: DataFrame) -> DataFrame:
    """Deal value: stated revenue if positive, else a score-weighted share of the forecast.

    The quarter forecast is zero only when all forecasts are, so it is the pool. Pool and weight
    sum are one tenant aggregation joined back, not a window over the tenant.
    """
    weight = F.greatest(F.lit(1), F.coalesce(F.col("opportunity_score"), F.lit(0))).cast("long")
    weighted = with_totals(prospects.withColumn("weight", weight), ["org_id"], weight_sum=F.sum("weight"),
                           qualified=F.count_if(F.col("status") == "qualified"))
    pool = F.expr(f"(qualified * {TICKET} * 25 + 5) div 10")
    share = pool.cast("double") * F.col("weight").cast("double") / F.col("weight_sum").cast("double")
    return (weighted.withColumn("is_stated", F.coalesce(F.col("revenue_estimate") > 0, F.lit(False)))
            .withColumn("deal_value", F.when(F.col("is_stated"), F.col("revenue_estimate").cast("double")).otherwise(share))
            .drop("weight", "weight_sum", "qualified"))


def deal_mix(prospects: DataFrame) -> DataFrame:
    """Deal figures by tenant, stage and segment in one pass over the leads.

    Imputed values are shares of the tenant's forecast in proportion to the score weight, so
    group values follow from sums of weights; no lead has to be joined with its tenant's total.
    Values are whole cents.
    """
    weight = F.greatest(F.lit(1), F.coalesce(F.col("opportunity_score"), F.lit(0))).cast("long")
    stated = F.coalesce(F.col("revenue_estimate") > 0, F.lit(False))
    mix = prospects.groupBy("org_id", "status", F.coalesce(present("industry"), F.lit(fixed.UNCLASSIFIED)).alias("industry")).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(stated, F.col("revenue_estimate")).otherwise(0).cast("decimal(28,0)")).alias("__stated"),
        F.sum(F.when(~stated, weight).otherwise(0)).alias("__open"), F.sum(weight).alias("__weight"),
        F.count_if(F.col("opportunity_score") >= 75).alias("high_intent"))
    # A window here sees the distinct (stage, segment) pairs of a tenant, not its leads, and
    # spares a second pass over the leads.
    tenant = Window.partitionBy("org_id")
    qualified = F.sum(F.when(F.col("status") == "qualified", F.col("count")).otherwise(0)).over(tenant).cast("long")
    mix = mix.withColumns({"__qualified": qualified, "__all": F.sum("__weight").over(tenant)})
    pool = F.expr(f"(__qualified * {TICKET} * 25 + 5) div 10")
    share = pool.cast("double") * F.col("__open").cast("double") / F.col("__all").cast("double")
    cents = F.col("__stated") * 100 + half_up(share * 100).cast("decimal(28,0)")
    return (mix.withColumn("value_cents", cents.cast("decimal(38,0)"))
            .drop("__stated", "__open", "__weight", "__qualified", "__all"))


def industry_breakdown(mix: DataFrame, k: int = 4) -> DataFrame:
    """Largest segments per tenant: count and value in cents."""
    per = mix.groupBy("org_id", "industry").agg(
        F.sum("count").alias("count"), F.sum("value_cents").cast("long").alias("value_cents"))
    return top_k(per, ["org_id"], [F.col("count").desc(), F.col("industry")], k)


def pipeline_stages(mix: DataFrame) -> DataFrame:
    """Funnel rows: label, count, value and whole percent; empty extra stages are hidden.

    One aggregation per tenant with a pair of columns per stage, then an unpivot.
    """
    def of(s, c):
        return F.sum(F.when(F.col("status") == s, F.col(c)).otherwise(0))

    wide = mix.groupBy("org_id").agg(
        F.sum("count").alias("__all"), *[of(s, "count").alias(f"n_{s}") for s in fixed.STAGES],
        *[of(s, "value_cents").cast("long").alias(f"v_{s}") for s in fixed.STAGES])
    rows = F.array(*[
        F.struct(F.lit(s).alias("status"), F.lit(label).alias("label"), F.col(f"n_{s}").cast("long").alias("count"),
                 F.col(f"v_{s}").alias("value_cents"), F.expr(f"(200 * n_{s} + __all) div (2 * __all)").alias("pct"))
        for s, (label, _) in fixed.STAGES.items()])
    return wide.select("org_id", F.inline(rows)).filter((F.col("count") > 0) | F.col("status").isin(fixed.BASE_STAGES))


def portfolio_kpis(mix: DataFrame) -> DataFrame:
    """Totals per tenant; values in cents, weighted pipeline in hundredths of a cent."""
    weight = None
    for s, (_, w) in fixed.STAGES.items():
        weight = F.when(F.col("status") == s, w) if weight is None else weight.when(F.col("status") == s, w)
    weight = weight.otherwise(fixed.UNKNOWN_STAGE_WEIGHT)
    per = mix.groupBy("org_id").agg(
        F.sum("count").alias("deals"), F.sum("value_cents").cast("long").alias("total_cents"),
        F.sum(F.col("value_cents") * weight).cast("long").alias("weighted"), F.sum("high_intent").alias("high_intent"),
        F.sum(F.when(F.col("status") == "qualified", F.col("count")).otherwise(0)).cast("long").alias("__q"))
    rate = F.expr("(200 * __q + deals) div (2 * deals)")
    return per.select(
        "org_id", "deals", "total_cents",
        (F.col("total_cents").cast("double") / F.col("deals").cast("double")).alias("avg_ticket_cents"),
        "weighted", "high_intent", F.least(F.lit(100).cast("long"), rate).alias("target_progress"), rate.alias("rate_pct"))


def revenue_series(mix: DataFrame) -> DataFrame:
    """Four labelled points per tenant with their deal counts, from the same one pass."""
    def n(s):
        return F.sum(F.when(F.col("status") == s, F.col("count")).otherwise(0)).cast("long").alias(s)

    j = mix.groupBy("org_id").agg(F.sum("count").alias("deals"), F.sum("value_cents").cast("long").alias("total_cents"),
                                  n("qualified"), n("prospect"), n("lead"))
    j = j.withColumn("this_month", F.col("qualified") * F.lit(TICKET).cast("long"))
    j = j.withColumns({"next_month": F.expr("(this_month * 115 + 50) div 100"), "quarter": F.expr("(this_month * 25 + 5) div 10")})
    one, c = F.lit(1).cast("long"), F.col

    def point(i, label, cents, deals):
        return F.struct(F.lit(i).alias("pos"), F.lit(label).alias("label"), cents.alias("value_cents"), deals.alias("deals"))

    series = F.array(
        point(0, "Hoje", c("total_cents"), c("deals")),
        point(1, "Mês atual", c("this_month") * 100, F.greatest(c("qualified"), one)),
        point(2, "Próx. mês", c("next_month") * 100, F.greatest(c("qualified") + c("prospect"), one)),
        point(3, "Q3", c("quarter") * 100, F.greatest(c("deals") + c("lead"), one)))
    return j.select("org_id", F.inline(series))


def kanban_totals(prospects: DataFrame) -> DataFrame:
    """Count and revenue of the four board columns, empty ones included."""
    def of(s, e):
        return F.sum(F.when(F.col("status") == s, e).otherwise(0)).cast("long")

    revenue = F.coalesce(F.col("revenue_estimate"), F.lit(0)).cast("long")
    wide = prospects.groupBy("org_id").agg(
        *[of(s, F.lit(1)).alias(f"n_{s}") for s in fixed.KANBAN_COLUMNS], *[of(s, revenue).alias(f"v_{s}") for s in fixed.KANBAN_COLUMNS])
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"n_{s}").alias("count"), F.col(f"v_{s}").alias("revenue"))
                     for s in fixed.KANBAN_COLUMNS])
    return wide.select("org_id", F.inline(rows))


def contact_coverage(contacts: DataFrame, phones: DataFrame, partners: DataFrame) -> DataFrame:
    """Per tenant: partners, leads with an e-mail, phones. Children are counted before joining."""
    def per_lead(df, name):
        return df.groupBy("prospect_id").agg(F.count(F.lit(1)).alias(name))

    j = (contacts.select("org_id", F.col("id").alias("prospect_id"), "email")
         .join(per_lead(partners, "__partners"), "prospect_id", "left")
         .join(per_lead(phones, "__phones"), "prospect_id", "left"))
    zero = F.lit(0).cast("long")
    return j.groupBy("org_id").agg(
        F.coalesce(F.sum("__partners"), zero).alias("partners"),
        F.count_if(present("email").isNotNull()).alias("with_email"),
        F.coalesce(F.sum("__phones"), zero).alias("phones"))


def industry_distinct(prospects: DataFrame) -> DataFrame:
    return prospects.select("org_id", "industry").filter(present("industry").isNotNull()).distinct()


def top_leads(prospects: DataFrame, k: int = 5) -> DataFrame:
    order = [F.coalesce("opportunity_score", F.lit(0)).desc(), F.col("id")]
    return top_k(prospects, ["org_id"], order, k)


def priority_tasks(prospects: DataFrame) -> DataFrame:
    """The three best leads of a tenant as tasks worded by rank."""
    def by_rank(first, second, third):
        return F.when(F.col("rank") == 1, first).when(F.col("rank") == 2, second).otherwise(third)

    title = by_rank(F.lit("Retomar conversa com "), F.lit("Preparar proposta para "), F.lit("Confirmar informações de "))
    return top_leads(prospects, 3).select(
        "org_id", "rank", F.col("id").alias("prospect_id"), F.concat(title, "company_name").alias("title"),
        F.concat(F.coalesce(present("industry"), F.lit("Lead")), F.lit(" · Potencial "),
                 F.coalesce(F.col("opportunity_score").cast("string"), F.lit("0")), F.lit("/100")).alias("subtitle"),
        by_rank(F.lit("Alta"), F.lit("Média"), F.lit("Baixa")).alias("priority"),
        by_rank(F.lit("Hoje"), F.lit("Amanhã"), F.lit("Esta semana")).alias("due"))
