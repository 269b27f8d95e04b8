"""Candidate discovery from the registry, exclusion of known leads and seeded paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlake.functions import fixed
from leadlake.functions.columns import digits, place_key
from leadlake.plans.balance import first_row, top_k
from leadlake.plans.textmatch import substring_pairs

BUCKET_DIGITS = 4


def candidate_union(*pools: DataFrame) -> DataFrame:
    """First occurrence of each (org_id, cnpj) over the pools, earlier pools first."""
    merged = None
    for tier, p in enumerate(pools):
        p = p.select("org_id", "cnpj", "pos").withColumn("tier", F.lit(tier))
        merged = p if merged is None else merged.unionByName(p)
    return merged.groupBy("org_id", "cnpj").agg(F.min(F.struct("tier", "pos")).alias("f")).select(
        "org_id", "cnpj", "f.tier", "f.pos")


def exclude_existing_leads(pool: DataFrame, prospects: DataFrame) -> DataFrame:
    """Drop companies the tenant already tracks."""
    known = prospects.select("org_id", digits("cnpj").alias("__d"))
    return pool.withColumn("__d", digits("cnpj")).join(known, ["org_id", "__d"], "left_anti").drop("__d")


def _criteria(profiles: DataFrame, most_terms: int | None) -> DataFrame:
    """One row per tenant and search term; locations parsed to (state, city) pairs."""
    terms = F.when(F.size("target_cnaes") > 0, F.col("target_cnaes")).otherwise(F.col("target_segments"))

    def place(text):
        in_parens = F.regexp_extract(text, r"\(([A-Za-z]{2})\)", 1)
        after_comma = F.regexp_extract(text, r",\s*([A-Za-z]{2})\s*$", 1)
        bare = text.rlike("^[A-Za-z]{2}$")
        state = F.when(bare, text).when(in_parens != "", in_parens).when(after_comma != "", after_comma)
        city = F.when(~bare, F.trim(F.regexp_replace(text, r"\([A-Za-z]{2}\)|,\s*[A-Za-z]{2}\s*$", "")))
        return F.named_struct(F.lit("state"), place_key(state), F.lit("city"), place_key(city))

    return profiles.select(
        "org_id", F.array_contains("company_statuses", "active").alias("active_only"),
        F.transform("target_locations", place).alias("places"),
        F.posexplode(terms if most_terms is None else F.slice(terms, 1, most_terms)).alias("pos", "term"))


def _fits(df: DataFrame) -> DataFrame:
    """Companies at one of the profile's places and active where asked."""
    here = F.exists("places", lambda p: ((p["state"] == "") | (p["state"] == F.col("__state")))
                    & ((p["city"] == "") | (p["city"] == F.col("__city"))))
    return df.filter(((F.size("places") == 0) | here) & (~F.col("active_only") | F.col("__active")))


def _first(hits: DataFrame, k: int | None) -> DataFrame:
    return hits if k is None else top_k(hits, ["org_id", "pos"], [F.col("cnpj")], k, "__r", spread=True).drop("__r")


def discovery_candidates(profiles: DataFrame, registry: DataFrame, prospects: DataFrame,
                         wanted: DataFrame | None = None, most_terms: int | None = None, per_term: int | None = None,
                         per_tenant: int | None = None) -> DataFrame:
    """Companies matching each tenant's profile, new to the tenant.

    Numeric terms match the activity code; a non-numeric first term matches the activity
    description. ``wanted`` (org_id, cnpj) adds exact hits and narrows those tenants to keys that
    contain any of the given digits. Nothing is limited unless the caller asks: ``most_terms`` of a
    profile, ``per_term`` companies by key, and ``per_tenant`` results, which are counted after the
    narrowing and without leads the tenant already has.
    """
    c = _criteria(profiles, most_terms)
    active = F.coalesce("is_active", F.upper(F.coalesce("registration_status", F.lit(""))).isin(fixed.ACTIVE_REGISTRATIONS))
    firms = registry.select("cnpj", "cnae", "cnae_description", place_key("state").alias("__state"),
                            place_key("city").alias("__city"), active.alias("__active"))
    numeric = F.col("term").rlike("^[0-9]+$")
    coded = _first(_fits(c.filter(numeric).join(firms, F.col("term") == F.col("cnae"))), per_term)
    text = c.filter(~numeric & (F.col("pos") == 0)).withColumn("__t", F.lower("term"))
    kinds = firms.select("cnae_description", F.lower("cnae_description").alias("__d")).distinct()
    kind_hits = substring_pairs(text, "__t", kinds, "__d", [], ["cnae_description"])
    searched = _first(_fits(text.join(kind_hits, "__t").join(firms, "cnae_description")), per_term)
    cols = ["org_id", "cnpj", "tier", "pos"]
    hits = (coded.withColumn("tier", F.lit(0)).select(*cols)
            .unionByName(searched.withColumn("tier", F.lit(1)).select(*cols)))
    if wanted is not None:
        asked = wanted.select("org_id", digits("cnpj").alias("cnpj"))
        hits = hits.unionByName(asked.join(firms.select("cnpj"), "cnpj", "left_semi")
                                .select("org_id", "cnpj", F.lit(2).alias("tier"), F.lit(0).alias("pos")))
    order = [F.col("tier"), F.col("pos"), F.col("cnpj")]
    unique = first_row(hits, ["org_id", "cnpj"], order)
    if wanted is not None:
        part = asked.select(F.col("org_id").alias("__org"), F.col("cnpj").alias("__part")).distinct()
        mine = F.col("org_id") == F.col("__org")
        unique = unique.join(part, mine & F.contains(F.col("cnpj"), F.col("__part")), "left_semi").unionByName(
            unique.join(part, mine, "left_anti"))
    fresh = exclude_existing_leads(unique, prospects)
    return fresh if per_tenant is None else top_k(fresh, ["org_id"], order, per_tenant, "__r").drop("__r")


def seeded_page(pool: DataFrame, seed: str = "default", page: int = 1, size: int = 12) -> DataFrame:
    """One page per tenant of the pool in an order fixed by the seed, with paging totals.

    The order is a hash, so its first bits are even buckets. Buckets are counted, and only rows of
    the buckets that the page touches are ranked, however deep the page or crowded the tenant.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size must be positive")
    first, last = (page - 1) * size, page * size
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce("cnpj", F.lit(""))))
    keyed = pool.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, BUCKET_DIGITS))
    buckets = keyed.groupBy("org_id", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy("org_id").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    touched = (buckets.withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0)))
               .withColumn("total", F.sum("__n").over(Window.partitionBy("org_id")))
               .filter((F.col("__before") < last) & (F.col("__before") + F.col("__n") > first)))
    inside = Window.partitionBy("org_id", "__bucket").orderBy("__key", "cnpj")
    here = (keyed.withColumnRenamed("org_id", "__org")
            .join(touched.withColumnRenamed("__bucket", "__b"), F.col("__org").eqNullSafe(F.col("org_id")) & (F.col("__bucket") == F.col("__b")))
            .drop("__org", "__b"))
    ranked = (here.withColumn("position", (F.row_number().over(inside) + F.col("__before")).cast("int"))
              .filter(F.col("position") <= last))
    pages = F.expr(f"greatest(1L, (total + {size} - 1) div {size})")
    return (ranked.filter(F.col("position") > first).drop("__key", "__bucket", "__before", "__n")
            .withColumn("total_pages", pages).withColumn("has_more", F.lit(page) < F.col("total_pages")))
