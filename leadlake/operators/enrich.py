"""Joins with the company registry and versioned enrichment results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import cnpj_valid, digits, first_present, lookup, name_uuid, present
from leadlake.operators.fold import Fold
from leadlake.plans.balance import attach_rows, first_row, join_hot, previous_value
from leadlake.plans.textmatch import substring_pairs

SOURCE = "brasilapi.cnpj.v1"
HOUR = 3_600_000_000
REGISTRY_FIELDS = ["legal_name", "trade_name", "cnae_description", "city", "state", "email"]


def _own_key(prospects: DataFrame) -> Column:
    """The lead's 14-digit key; a lead without one gets a key of its own, which nothing else has."""
    own = F.concat(F.lit("!"), F.xxhash64("id" if "id" in prospects.columns else "company_name").cast("string"))
    return F.when(cnpj_valid("cnpj"), digits("cnpj")).otherwise(own)


def _with_registry(prospects: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join on the 14-digit key; registry columns get an ``r_`` prefix.

    Registry rows without a whole key match nothing, and of several rows of one key the first in column
    order counts. Leads without a whole key get keys of their own, so they do not meet in one task.
    """
    cols = [c for c in registry.columns if c != "cnpj"]
    r = (registry.filter(cnpj_valid("cnpj")).groupBy(digits("cnpj").alias("__key"))
         .agg(F.min(F.struct(*cols)).alias("__r"))
         .select("__key", F.lit(True).alias("__found"), *[F.col(f"__r.{c}").alias(f"r_{c}") for c in cols]))
    return prospects.withColumn("__key", _own_key(prospects)).join(r, "__key", "left")


def _clean(df: DataFrame) -> DataFrame:
    return df.drop("__key", "__found", *[c for c in df.columns if c.startswith("r_")])


def _non_empty(c: str) -> Column:
    return F.when(F.size(c) > 0, F.col(c))


def enrich_from_registry(prospects: DataFrame, registry: DataFrame, now: str) -> DataFrame:
    """Registry values win where present; the outcome is recorded on the lead."""
    j = _with_registry(prospects, registry)
    valid, found = cnpj_valid("cnpj"), F.coalesce("__found", F.lit(False))
    out = {
        "company_name": first_present("r_legal_name", "r_trade_name", "company_name"),
        "trade_name": first_present("r_trade_name", "trade_name"),
        "industry": first_present("r_cnae_description", "industry"),
        "cnpj_email": first_present("r_email", "cnpj_email"),
        "enrichment_status": F.when(~valid, "error").when(found, "enriched").otherwise("unavailable"),
        "enrichment_error": F.when(~valid, "Invalid CNPJ. Expected 14 digits.").when(~found, "CNPJ not found in registry"),
        "enrichment_source": F.lit(SOURCE),
        "enriched_at": F.lit(now).cast("timestamp_ntz"),
    }
    for c in ("cnpj_phones", "cnpj_partners"):
        if f"r_{c}" in j.columns:
            out[c] = F.coalesce(_non_empty(f"r_{c}"), F.col(c))
    for c in ("cnpj_opened_at", "cnpj_legal_nature"):
        if f"r_{c}" in j.columns:
            out[c] = F.coalesce(F.col(f"r_{c}"), F.col(c))
    return _clean(j.withColumns(out))


def hydrate_firmographics(prospects: DataFrame, registry: DataFrame) -> DataFrame:
    """Fill only what is missing; status and score stay as they are."""
    j = _with_registry(prospects, registry)
    pairs = {"company_name": ["r_legal_name", "r_trade_name"], "trade_name": ["r_trade_name"],
             "industry": ["r_cnae_description"], "city": ["r_city"], "state": ["r_state"], "cnpj_email": ["r_email"]}
    out = {c: first_present(c, *news) for c, news in pairs.items()}
    for c in ("cnpj_phones", "cnpj_partners"):
        if f"r_{c}" in j.columns:
            out[c] = F.coalesce(_non_empty(c), F.col(f"r_{c}"))
    return _clean(j.withColumns(out))


def enrich_registry_overwrite(prospects: DataFrame, registry: DataFrame, now: str) -> DataFrame:
    """Registry replaces six fields of matched leads and marks them enriched."""
    j = _with_registry(prospects, registry)
    hit = F.coalesce("__found", F.lit(False))
    pairs = {"company_name": "r_legal_name", "trade_name": "r_trade_name", "industry": "r_cnae_description",
             "city": "r_city", "state": "r_state", "cnpj_email": "r_email"}
    out = {old: F.coalesce(present(new), F.col(old)) for old, new in pairs.items()}
    out["enrichment_status"] = F.when(hit, "enriched").otherwise(F.col("enrichment_status"))
    out["enriched_at"] = F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("enriched_at"))
    return _clean(j.withColumns(out))


def registry_filter(registry: DataFrame, state: str | None = None, city: str | None = None, status: str | None = None,
                    cnae: str | None = None, name: str | None = None, is_active: bool | None = None,
                    limit: int | None = None) -> DataFrame:
    """Structured company filter, ordered by key; ``limit`` bounds the rows, nothing does by default."""
    rows = registry
    if state:
        rows = rows.filter(F.col("state") == state)
    if city:
        rows = rows.filter(F.col("city") == city)
    if status:
        wanted = fixed.REGISTRATION_STATUS.get(status.upper(), status.upper())
        reg = F.upper("registration_status")
        rows = rows.filter(lookup(fixed.REGISTRATION_STATUS, reg, reg) == wanted)
    if cnae:
        rows = rows.filter(F.col("cnae") == cnae)
    if name:
        rows = rows.filter(F.lower("legal_name").contains(name.lower()))
    if is_active is not None:
        reg_active = F.upper(F.coalesce("registration_status", F.lit(""))).isin(fixed.ACTIVE_REGISTRATIONS)
        rows = rows.filter(F.coalesce("is_active", reg_active) == F.lit(is_active))
    rows = rows.orderBy("cnpj")
    return rows if limit is None else rows.limit(limit)


def registry_lookup(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested keys, each with its company where the registry has one.

    A key without 14 digits has none. Registry rows without a whole key match nothing, and of several rows
    of one key the first in column order counts.
    """
    cols = [c for c in registry.columns if c != "cnpj"]
    r = (registry.filter(cnpj_valid("cnpj")).groupBy(digits("cnpj").alias("cnpj_digits")).agg(F.min(F.struct(*cols)).alias("__r"))
         .select("cnpj_digits", "__r.*"))
    return keys.select(digits("cnpj").alias("cnpj_digits")).distinct().join(r, "cnpj_digits", "left")


STATS = ["state", "status", "cnae"]
#: Registers of a distinct-count sketch, as a power of two: its estimates have a relative standard error of about 1.04 / 2 ** 6 = 1.6 %.
SKETCH_BITS = 12


def _stats_rows(registry: DataFrame) -> DataFrame:
    reg = F.upper(F.coalesce("registration_status", F.lit("")))
    return registry.select("state", lookup(fixed.REGISTRATION_STATUS, reg, reg).alias("status"), "cnae", "city")


def registry_stats(registry: DataFrame, exact: bool = False) -> DataFrame:
    """Companies by state, status and activity with subtotals, and distinct cities: counted, or estimated from sketches."""
    if not exact:
        return registry_stats_report(registry_stats_leaves(registry))
    return _stats_rows(registry).rollup(*STATS).agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("companies"), F.countDistinct("city").alias("cities"))


def registry_stats_leaves(registry: DataFrame) -> DataFrame:
    """One row per state, status and activity to be stored: companies and a mergeable sketch of their cities (null: none known)."""
    return _stats_rows(registry).groupBy(*STATS).agg(F.count(F.lit(1)).alias("companies"), F.hll_sketch_agg("city", SKETCH_BITS).alias("cities"))


def registry_stats_merge(stored: DataFrame, increment: DataFrame) -> DataFrame:
    """Stored leaves and those of new companies; the registry itself is not read again."""
    return stored.unionByName(increment).groupBy(*STATS).agg(F.sum("companies").alias("companies"), F.hll_union_agg("cities").alias("cities"))


def registry_stats_report(leaves: DataFrame) -> DataFrame:
    """Subtotals by union of the sketches; distinct cities within the error of SKETCH_BITS."""
    return leaves.rollup(*STATS).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("companies").alias("companies"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("cities")), F.lit(0)).cast("long").alias("cities"))


def company_name_resolve(names: DataFrame, prospects: DataFrame) -> DataFrame:
    """Typed names -> the tenant's lead: equal name first, else a name containing it.

    ``names``: name_id, org_id, name. Each distinct name is resolved once.
    """
    key = F.lower(F.trim("name"))
    asked = names.withColumn("key", key).filter(F.col("key") != "")
    wanted = asked.select("org_id", "key").distinct()
    equal = wanted.join(prospects.select("org_id", "id", F.lower("company_name").alias("key")), ["org_id", "key"])
    rest = wanted.join(equal.select("org_id", "key").distinct(), ["org_id", "key"], "left_anti")
    texts = prospects.select("org_id", "id", F.explode(F.array_compact(F.array(
        F.lower("company_name"), F.lower("trade_name")))).alias("text"))
    parts = substring_pairs(rest, "key", texts, "text", ["org_id"], ["id"]).withColumn("tier", F.lit(1))
    equal = equal.withColumn("tier", F.lit(0))
    best = (equal.unionByName(parts).groupBy("org_id", "key")
            .agg(F.min(F.struct("tier", "id")).alias("m"))
            .select("org_id", "key", F.col("m.tier").alias("tier"), F.col("m.id").alias("prospect_id")))
    return join_hot(asked, best, ["org_id", "key"]).select("name_id", "org_id", "prospect_id", "tier")


def _kept_results(results: DataFrame) -> DataFrame:
    """One result per (company, version): a completed one if any, else the first to arrive."""
    order = [(F.col("status") == "COMPLETED").desc(), F.col("event_ts"), F.col("event_id")]
    return first_row(results, ["cnpj", "enrichment_version"], order)


def enrichment_latest(results: DataFrame) -> DataFrame:
    """Highest version per company that is not discarded."""
    kept = _kept_results(results).filter(F.col("status") != "DISCARDED")
    return first_row(kept, ["cnpj"], [F.col("enrichment_version").desc()])


def enrichment_history(prospects: DataFrame, results: DataFrame) -> DataFrame:
    """Every lead with its results, newest version first; one row per result."""
    p = prospects.select(F.col("id").alias("prospect_id"), "org_id", _own_key(prospects).alias("__key"), digits("cnpj").alias("cnpj"))
    r = results.select(F.col("cnpj").alias("__key"), "enrichment_version", F.col("status").alias("result_status"), "commercial_potential",
                       "event_ts", "event_id")
    return attach_rows(p, r, ["__key"]).drop("__key").orderBy(
        "org_id", "prospect_id", F.col("enrichment_version").desc_nulls_last(), F.col("event_ts").desc_nulls_last(), "event_id")


def _outcome(kept: DataFrame, by: list[str]) -> DataFrame:
    """The version and status to apply, and the score to take over."""
    usable = F.col("status").isin("COMPLETED", "PARTIAL") & F.col("commercial_potential").isNotNull()
    return kept.groupBy(*by).agg(
        F.max("enrichment_version").alias("new_version"),
        F.max_by("status", "enrichment_version").alias("new_status"),
        F.max_by("commercial_potential", F.when(usable, F.col("enrichment_version"))).alias("new_score"))


def enrichment_apply(prospects: DataFrame, results: DataFrame) -> DataFrame:
    """Leads after all results: highest version decides status, every tracking tenant is updated.

    Results up to the version a lead already has are left out before anything is chosen.
    """
    seen = F.coalesce(F.col("enrichment_version"), F.lit(0)) if "enrichment_version" in prospects.columns else F.lit(0)
    p = prospects.withColumns({"__key": _own_key(prospects), "__seen": seen.cast("long")})
    kept = _kept_results(results).filter(F.col("status") != "DISCARDED").withColumnRenamed("cnpj", "__key")
    due = kept.join(p.select("__key", "__seen").distinct(), "__key").filter(F.col("enrichment_version") > F.col("__seen"))
    j = p.join(_outcome(due, ["__key", "__seen"]), ["__key", "__seen"], "left")
    newer = F.col("new_version").isNotNull()
    status = (F.when(F.col("new_status") == "COMPLETED", "enriched").when(F.col("new_status") == "PARTIAL", "partial")
              .when(F.col("new_status") == "FAILED", "error"))
    return j.withColumns({
        "enrichment_status": F.when(newer & status.isNotNull(), status).otherwise(F.col("enrichment_status")),
        "opportunity_score": F.when(newer, F.coalesce("new_score", "opportunity_score")).otherwise(F.col("opportunity_score")),
        "enrichment_version": F.when(newer, F.col("new_version")).otherwise(seen),
    }).drop("__key", "__seen", "new_version", "new_status", "new_score")


def stage_entry(changes: DataFrame, stage: str = "prospect") -> DataFrame:
    """Changes by which a lead enters a stage it was not in just before."""
    block = F.floor(F.unix_micros(F.col("changed_at").cast("timestamp")) / F.lit(HOUR))
    with_prev = previous_value(changes, ["prospect_id"], ["changed_at", "change_id"], "status", "previous", block)
    return with_prev.filter((F.col("status") == stage) & (F.coalesce("previous", F.lit("")) != stage))


def enrichment_requests(entries: DataFrame, leads: DataFrame) -> DataFrame:
    """Stage entries of known leads -> request events with the lead's own key and names, and a company id named by the key.

    An unusable key is sent on as it is (its digits), for the worker to refuse.
    """
    p = leads.select(F.col("id").alias("prospect_id"), F.coalesce(digits("cnpj"), F.lit("")).alias("cnpj"), present("company_name").alias("company_name"),
                     present("trade_name").alias("trade_name"))
    return join_hot(entries, p, ["prospect_id"], "inner").select(
        F.col("change_id").alias("event_id"), "prospect_id", "cnpj", name_uuid("cnpj").alias("company_id"), "company_name", "trade_name",
        F.col("changed_at").alias("requested_at"))


def result_fold() -> Fold:
    """The kept result per (company, version) as one minimum: completed first, then arrival."""
    late = (F.col("status") != "COMPLETED").cast("int")
    return Fold(("cnpj", "enrichment_version"),
                {"kept": F.struct(late.alias("late"), "event_ts", "event_id", "status", "commercial_potential")}, {})


def unfold_results(folded: DataFrame) -> DataFrame:
    return folded.select("cnpj", "enrichment_version", "kept.event_ts", "kept.event_id", "kept.status", "kept.commercial_potential")
