"""Identifiers, phones, addresses, profiles and the intake of new leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import (
    chat_id, clamp, cnpj_format, cnpj_valid, digits, name_uuid, phone_normalise, phone_of_chat, present, short_key,
    trimmed,
)
from leadlake.plans.balance import first_row, join_hot, top_k, with_totals


def org_scope(df: DataFrame, orgs: DataFrame, org_col: str = "org_id") -> DataFrame:
    """Rows of the given tenants."""
    wanted = orgs.select(F.col(orgs.columns[0]).alias(org_col)).distinct()
    return df.join(wanted, org_col, "left_semi")


def owned_ids_check(requests: DataFrame, prospects: DataFrame) -> DataFrame:
    """Per request: distinct ids asked for, how many the tenant owns, and whether all are."""
    owned = prospects.select("org_id", F.col("id").alias("prospect_id"), F.lit(1).alias("__own"))
    asked = requests.select("request_id", "org_id", "prospect_id").distinct()
    return (asked.join(owned, ["org_id", "prospect_id"], "left")
            .groupBy("request_id", "org_id")
            .agg(F.count(F.lit(1)).alias("requested"), F.count("__own").alias("owned"))
            .withColumn("valid", F.col("requested") == F.col("owned")))


def cnpj_standardise(df: DataFrame, c: str = "cnpj") -> DataFrame:
    d = digits(c)
    return df.withColumns({
        "cnpj_digits": d,
        "cnpj_valid": cnpj_valid(c),
        "cnpj_formatted": cnpj_format(c),
        "is_headquarters": cnpj_format(d).contains("/0001-"),
    })


def phone_standardise(phones: DataFrame) -> DataFrame:
    """One row per lead and distinct normalised phone, at its first position."""
    phone = phone_normalise("raw_phone")
    raw = digits("raw_phone")
    strict = F.length(raw).between(10, 11) | (F.length(raw).between(12, 13) & raw.startswith("55"))
    return (phones.withColumns({"phone": phone, "is_strict": strict})
            .filter(F.col("phone").isNotNull())
            .groupBy("org_id", "prospect_id", "phone")
            .agg(F.min("pos").alias("pos"), F.max("is_strict").alias("is_strict"))
            .withColumn("chat_id", chat_id("phone"))
            .withColumn("phone_back", phone_of_chat("chat_id")))


def email_domain_gate(df: DataFrame, email: str = "email", free: list[str] | None = None,
                      allowed: list[str] | None = None) -> DataFrame:
    """Domain after the last @ and a verdict: malformed, free, not_allowed or corporate."""
    e = F.lower(F.trim(F.coalesce(F.col(email), F.lit(""))))
    domain = F.substring_index(e, "@", -1)
    malformed = (domain == "") | (F.length(domain) + 1 >= F.length(e))
    verdict = F.when(malformed, "malformed").when(domain.isin(free or fixed.FREE_EMAIL_DOMAINS), "free")
    if allowed:
        verdict = verdict.when(~domain.isin([a.lower() for a in allowed]), "not_allowed")
    return df.withColumns({"domain": F.when(~malformed, domain), "verdict": verdict.otherwise("corporate")})


def location_parse(df: DataFrame, c: str = "location") -> DataFrame:
    """``City (UF)``, ``City, UF``, ``City`` or a bare ``UF`` -> city and state."""
    raw = F.trim(F.coalesce(F.col(c), F.lit("")))
    in_parens = F.regexp_extract(raw, r"\(([A-Za-z]{2})\)", 1)
    after_comma = F.regexp_extract(raw, r",\s*([A-Za-z]{2})\s*$", 1)
    bare = raw.rlike("^[A-Za-z]{2}$")
    state = F.when(bare, raw).when(in_parens != "", in_parens).when(after_comma != "", after_comma)
    city = (F.when(bare, F.lit(""))
            .when(in_parens != "", F.trim(F.regexp_replace(raw, r"\([A-Za-z]{2}\)", "")))
            .when(after_comma != "", F.trim(F.regexp_replace(raw, r",\s*[A-Za-z]{2}\s*$", "")))
            .otherwise(raw))
    return df.withColumns({"city": F.when(city != "", city), "state": F.upper(state)})


def tags(c: str):
    """Comma list -> trimmed non-empty tags, in order."""
    parts = F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def profile_normalise(raw: DataFrame) -> DataFrame:
    """Typed-in profile text -> clean profile columns."""
    lists = [c for c in ("target_segments", "target_cnaes", "target_locations", "target_sizes", "age_ranges")
             if c in raw.columns]
    texts = [c for c in ("company_name", "sales_team_size", "sales_cycle", "value_proposition") if c in raw.columns]
    out = {c: tags(c) for c in lists}
    out.update({c: trimmed(c) for c in texts})
    out["company_statuses"] = F.when(F.size(tags("company_statuses")) > 0, tags("company_statuses")).otherwise(
        F.array(F.lit("active")))
    step = F.col("onboarding_step").cast("string").try_cast("double")
    out["onboarding_step"] = F.coalesce(clamp(F.floor(step), 0, 4), F.lit(0)).cast("int")
    if "average_ticket" in raw.columns:
        out["average_ticket"] = F.nullif(F.col("average_ticket").cast("string").try_cast("double"), F.lit(0.0))
    return raw.withColumns(out)


def profile_view(orgs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every tenant with its profile, defaults where none is stored."""
    empty = F.array().cast("array<string>")
    p = orgs.select(F.col("id").alias("org_id"), F.col("name").alias("__org_name")).join(profiles, "org_id", "left")
    out = {
        "company_name": F.coalesce(present("company_name"), F.col("__org_name"), F.lit("")),
        "company_statuses": F.when(F.size("company_statuses") > 0, F.col("company_statuses")).otherwise(
            F.array(F.lit("active"))),
        "onboarding_step": F.coalesce("onboarding_step", F.lit(0)),
    }
    for c in ("target_segments", "target_cnaes", "target_locations", "target_sizes", "age_ranges"):
        if c in profiles.columns:
            out[c] = F.coalesce(c, empty)
    return p.withColumns(out).drop("__org_name")


def tag_merge(profiles: DataFrame, drafts: DataFrame) -> DataFrame:
    """Stored tags followed by newly typed ones, case-insensitive copies dropped.

    One row per tenant and tag; order by (source, draft_id, pos). ``profiles`` has org_id and an
    array ``tags``; ``drafts`` has org_id, draft_id and comma text ``draft``.
    """
    stored = profiles.select("org_id", F.lit(0).alias("source"), F.lit(0).cast("long").alias("draft_id"),
                             F.posexplode("tags").alias("pos", "tag"))
    typed = drafts.select("org_id", F.lit(1).alias("source"), F.col("draft_id").cast("long").alias("draft_id"),
                          F.posexplode(tags("draft")).alias("pos", "tag"))
    return (stored.unionByName(typed)
            .groupBy("org_id", F.lower("tag").alias("tag_key"))
            .agg(F.min(F.struct("source", "draft_id", "pos", "tag")).alias("f"))
            .select("org_id", "tag_key", "f.tag", "f.source", "f.draft_id", "f.pos"))


def profile_readiness(profiles: DataFrame) -> DataFrame:
    """Percent of four checks, the first unfinished step and where to resume."""
    name = F.lower(F.trim(F.coalesce(F.col("company_name"), F.lit(""))))
    market = (F.size("target_segments") > 0) | (F.size("target_cnaes") > 0)
    places = F.size("target_locations") > 0
    checks = [name != "", market, places, F.size("company_statuses") > 0]
    placeholder = name.isin("", "organização principal", "organizacao principal")
    first = F.when(placeholder, 0).when(~market, 1).when(~places, 2).otherwise(3)
    stored = clamp(F.col("onboarding_step"), 0, 4)
    return profiles.withColumns({
        "readiness": sum((c.cast("int") for c in checks[1:]), checks[0].cast("int")) * 25,
        "first_incomplete": first,
        "resume_step": F.when(stored > 0, stored).otherwise(first),
    })


def idempotency_keys(df: DataFrame, parts: list[str], session: str, cnpj: str) -> DataFrame:
    return df.withColumns({
        "step_key": short_key(*parts),
        "session_key": short_key(session, size=16),
        "company_id": name_uuid(cnpj),
    })


def lead_intake(incoming: DataFrame, prospects: DataFrame, orgs: DataFrame) -> DataFrame:
    """Admit new leads with defaults, within each trial tenant's remaining quota.

    ``incoming``: org_id, arrival, cnpj, company_name, kind (manual/discovered), status,
    industry. Rows without key or name are dropped, as are keys the tenant already tracks and
    later copies of one key. Premium tenants have no quota; the others keep at most the trial
    limit, so the ranked group per tenant is bounded by it.
    """
    clean = (incoming.withColumn("cnpj", digits("cnpj"))
             .filter((F.col("cnpj") != "") & present("company_name").isNotNull()))
    fresh = first_row(clean.join(prospects.select("org_id", digits("cnpj").alias("cnpj")), ["org_id", "cnpj"], "left_anti"),
                      ["org_id", "cnpj"], [F.col("arrival"), F.col("kind")])
    used = prospects.groupBy("org_id").agg(F.count(F.lit(1)).alias("__used"))
    plans = orgs.select(F.col("id").alias("org_id"), (F.col("plan") == "premium").alias("__premium"))
    tenants = plans.join(used, "org_id", "full")
    arriving = incoming.groupBy("org_id").agg(F.count(F.lit(1)).alias("__n"))
    marked = (join_hot(fresh, tenants, ["org_id"], counts=arriving)
              .withColumn("__left", F.greatest(F.lit(0), F.lit(fixed.TRIAL_LEAD_LIMIT) - F.coalesce("__used", F.lit(0)))))
    premium = F.coalesce("__premium", F.lit(False))
    # Premium leads get a slot of their own each, so one ranking serves both plans.
    ranked = top_k(marked.withColumn("__slot", F.when(premium, F.col("cnpj")).otherwise("")), ["org_id", "__slot"],
                   [F.col("arrival"), F.col("cnpj")], fixed.TRIAL_LEAD_LIMIT, "__rank")
    admitted = ranked.filter(premium | (F.col("__rank") <= F.col("__left")))
    manual = F.col("kind") == "manual"
    return admitted.select(
        "org_id", "cnpj", "arrival", "kind", F.trim("company_name").alias("company_name"),
        F.when(manual, F.coalesce(present("status"), F.lit("prospect")))
         .otherwise(F.when(F.col("status") == "active", "prospect").otherwise("lead")).alias("status"),
        F.when(manual, F.coalesce(F.col("industry"), F.lit(""))).otherwise(present("industry")).alias("industry"),
        F.when(manual, 65).otherwise(60).alias("opportunity_score"),
        F.lit("pending").alias("enrichment_status"))


def shared_org_detect(users: DataFrame) -> DataFrame:
    return users.groupBy("org_id").agg(F.count(F.lit(1)).alias("users")).filter(F.col("users") > 1)


def org_split(users: DataFrame, default_name: str = "Organização do usuário") -> DataFrame:
    """The oldest user keeps a shared tenant; each other user gets a tenant of their own."""
    split = with_totals(users, ["org_id"], __first=F.min(F.struct("created_at", "id")))
    keeps = F.struct("created_at", "id") == F.col("__first")
    return split.select(
        F.col("id").alias("user_id"), F.col("org_id").alias("old_org_id"),
        F.when(keeps, F.col("org_id")).otherwise(F.concat(F.lit("org_"), F.col("id").cast("string"))).alias("new_org_id"),
        F.when(~keeps, F.coalesce(present("name"), present(F.substring_index("email", "@", 1)), F.lit(default_name)))
         .alias("new_org_name"))
