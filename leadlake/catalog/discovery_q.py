"""Discovery, paging, places and the activity classification."""

from pyspark.sql import functions as F

from leadlake.catalog.core import query
from leadlake.operators import discovery as D
from leadlake.operators import intake as I
from leadlake.operators import places as P
from leadlake.operators import taxonomy as T
from leadlake.plans.scratch import cut


def profiles(fx):
    p = fx("profile")
    lists = ["target_cnaes", "target_segments", "target_locations"]
    out = {c: I.tags(c) for c in lists}
    out["company_statuses"] = F.when(F.size(I.tags("company_statuses")) > 0, I.tags("company_statuses")).otherwise(F.array(F.lit("active")))
    # Every third tenant looks at all companies, whatever their standing.
    out["company_statuses"] = F.when(F.col("onboarding_step") % 3 == 0, F.array(F.lit("any"))).otherwise(out["company_statuses"])
    return p.withColumns(out)


LIST = "[trim(x) FOR x IN string_split({0}, ',') IF trim(x) <> '']"
CANDIDATES = f"""
prof AS (SELECT org_id, onboarding_step % 3 <> 0 AS active_only, {LIST.format('target_cnaes')} AS codes, {LIST.format('target_segments')} AS segs,
  lower(regexp_extract(target_locations, '\\(([A-Za-z]{{2}})\\)', 1)) AS st, lower(trim(regexp_replace(target_locations, '\\([A-Za-z]{{2}}\\)', ''))) AS ct, target_locations
  FROM {{fx_profile}} p),
terms AS (SELECT *, i - 1 AS pos, l[i] AS term FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, CASE WHEN len(codes) > 0 THEN codes ELSE segs END AS l FROM prof))),
firm AS (SELECT *, coalesce(is_active, upper(registration_status) IN ('ATIVA', 'ATIVO', 'ACTIVE')) AS act FROM {{fx_registry}} r),
hit AS (SELECT t.org_id, t.pos, f.cnpj, regexp_matches(t.term, '^[0-9]+$') AS num FROM terms t JOIN firm f ON
  ((regexp_matches(t.term, '^[0-9]+$') AND f.cnae = t.term) OR (NOT regexp_matches(t.term, '^[0-9]+$') AND t.pos = 0 AND contains(lower(f.cnae_description), lower(t.term))))
  AND (t.target_locations = '' OR ((t.st = '' OR t.st = lower(f.state)) AND (t.ct = '' OR t.ct = lower(f.city)))) AND (NOT t.active_only OR f.act)),
tiers AS (SELECT *, CASE WHEN num THEN 0 ELSE 1 END AS tier FROM hit),
uniq AS (SELECT org_id, cnpj, tier, pos FROM (SELECT *, row_number() OVER (PARTITION BY org_id, cnpj ORDER BY tier, pos) AS d FROM tiers) WHERE d = 1)
"""
NEW = "SELECT u.* FROM uniq u WHERE NOT EXISTS (SELECT 1 FROM {fx_prospect} p WHERE p.org_id = u.org_id AND p.cnpj = u.cnpj)"


@query("discovery_candidates", f"WITH {CANDIDATES} SELECT org_id, cnpj, tier, cast(pos AS int) AS pos FROM ({NEW})")
def _(fx):
    return D.discovery_candidates(profiles(fx), fx("registry"), fx("prospect"))


PAGED = """SELECT org_id, cnpj, position, total, (total + 11) // 12 AS total_pages, 2 < (total + 11) // 12 AS has_more
FROM (SELECT *, cast(row_number() OVER (PARTITION BY org_id ORDER BY md5('s7:' || cnpj), cnpj) AS int) AS position, count(*) OVER (PARTITION BY org_id) AS total
  FROM (@)) WHERE position BETWEEN 13 AND 24"""


@query("seeded_page", PAGED.replace("@", "SELECT org_id, cnpj FROM {fx_prospect} p"))
def _(fx):
    return D.seeded_page(fx("prospect").select("org_id", "cnpj"), "s7", 2, 12)


POOLS = [f"SELECT concat('org_', cast(o_custkey % 20 AS string)) AS org_id, lpad(cast(o_custkey + {i} AS string), 14, '0') AS cnpj, cast(o_orderkey AS int) AS pos FROM {{orders}} WHERE o_orderstatus = '{s}'"
         for i, s in enumerate("FOP")]


@query("candidate_union", "SELECT org_id, cnpj, tier, pos FROM (SELECT *, row_number() OVER (PARTITION BY org_id, cnpj ORDER BY tier, pos) AS rn FROM ("
       + " UNION ALL ".join(f"SELECT *, {i} AS tier FROM ({p})" for i, p in enumerate(POOLS)) + ")) WHERE rn = 1")
def _(fx):
    return D.candidate_union(*[fx.sql(p) for p in POOLS])


POOL = """
SELECT concat('org_', cast(o_custkey % 20 AS string)) AS org_id, concat(CASE WHEN o_orderstatus = 'O' THEN '0' ELSE '6' END, lpad(cast(o_custkey + o_orderkey % 2 AS string), 13, '0')) AS cnpj,
  cast(o_orderkey AS int) AS pos FROM {orders}
"""


@query("exclude_existing_leads", f"""
SELECT x.* FROM ({POOL}) x WHERE NOT EXISTS (SELECT 1 FROM {{fx_prospect}} p WHERE p.org_id = x.org_id AND p.cnpj = x.cnpj)""")
def _(fx):
    return D.exclude_existing_leads(fx.sql(POOL), fx("prospect"))


# --- places ---------------------------------------------------------------------------------

LABELS = """
SELECT c_custkey AS label_id, CASE c_custkey % 4 WHEN 0 THEN concat(' NÁTION ', cast(c_nationkey AS string), ', R', cast(n_regionkey AS string))
  WHEN 1 THEN cast(c_nationkey AS string) WHEN 2 THEN n_name ELSE concat('Nation ', cast(c_nationkey AS string), ', r', cast(n_regionkey AS string)) END AS label
FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""


@query("location_resolve", f"""
SELECT l.*, g.code FROM ({LABELS}) l LEFT JOIN {{fx_place}} g
  ON trim(lower(strip_accents(l.label))) = g.n || ', ' || g.uf OR trim(l.label) = cast(g.code AS string)""")
def _(fx):
    return P.location_resolve(fx.sql(LABELS), fx("place"))


@query("location_fuzzy", """
WITH qs AS (SELECT qid, q, trim(lower(strip_accents(q))) AS k FROM {fx_place_query} x), dq AS (SELECT DISTINCT k, regexp_split_to_array(k, '\\s+') AS t FROM qs),
g AS (SELECT *, n || ' ' || lower(uf) AS s FROM {fx_place} y),
pre AS (SELECT dq.k, g.code, importance + CASE WHEN n = k THEN 100000 WHEN starts_with(s, k) THEN 20000 WHEN starts_with(n, k) THEN 10000 ELSE 0 END
    + CASE WHEN list_contains(t, lower(uf)) AND length(uf) = 2 THEN 2000 ELSE 0 END - length(n) AS score, 0 AS distance
  FROM dq JOIN g ON starts_with(s, substr(t[1], 1, 3))
  WHERE len([x FOR x IN t IF NOT (starts_with(s, x) OR len([w FOR w IN string_split(s, ' ') IF starts_with(w, x)]) > 0)]) = 0),
fz AS (SELECT k, code, importance + 10000 - 1000 * d - length(n) AS score, d AS distance FROM (
  SELECT dq.k, g.*, least(levenshtein(n, k), levenshtein(s, k)) AS d FROM dq CROSS JOIN g WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.k = dq.k))
  WHERE d <= CASE WHEN length(k) <= 4 THEN 1 WHEN length(k) <= 8 THEN 2 ELSE 3 END),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY distance > 0, score DESC, code) AS rank FROM (SELECT * FROM pre UNION ALL SELECT * FROM fz))
SELECT qs.qid, qs.q, r.code, cast(r.score AS int) AS score, cast(r.distance AS int) AS distance, cast(r.rank AS int) AS rank FROM qs JOIN r ON r.k = qs.k WHERE rank <= 8""")
def _(fx):
    return P.location_fuzzy(fx("place_query"), fx("place"))


# --- taxonomy -------------------------------------------------------------------------------

@query("taxonomy_flatten", "SELECT * FROM {fx_flat} f")
def _(fx):
    return T.taxonomy_flatten(fx("tree"))


@query("taxonomy_counts", """
SELECT section, count(DISTINCT code) AS codes, count(DISTINCT division) AS divisions FROM {fx_flat} f GROUP BY ROLLUP (section)""")
def _(fx):
    return T.taxonomy_counts(T.taxonomy_flatten(fx("tree")))


@query("taxonomy_search", """
WITH qs AS (SELECT DISTINCT lower(trim(q)) AS q FROM {fx_tax_query} x), f AS (SELECT * FROM {fx_flat} y),
m AS (SELECT qs.q, f.*, contains(lower(section_name), qs.q) OR contains(lower(section_official), qs.q) OR lower(section) = qs.q AS sm,
  contains(lower(division_name), qs.q) OR division = qs.q AS dm,
  contains(lower(activity), qs.q) OR contains(dotted, qs.q) OR contains(code, qs.q) AS am FROM qs CROSS JOIN f),
w AS (SELECT *, bool_or(sm) OVER (PARTITION BY q, section) AS s_any FROM m)
SELECT q, section, division, code FROM w WHERE s_any OR (NOT s_any AND (dm OR am))""")
def _(fx):
    return T.taxonomy_search(fx("tax_query"), cut(T.taxonomy_flatten(fx("tree")), "taxonomy"))


@query("taxonomy_match", """
WITH qs AS (SELECT DISTINCT lower(trim(q)) AS q FROM {fx_tax_query} x), f AS (SELECT * FROM {fx_flat} y),
n AS (SELECT section, division, code, row_number() OVER (ORDER BY section, division, code) AS place FROM (SELECT DISTINCT section, division, code FROM f)),
s AS (SELECT section, min(place) AS low, max(place) AS high FROM n GROUP BY 1), d AS (SELECT section, division, min(place) AS low, max(place) AS high FROM n GROUP BY 1, 2),
m AS (SELECT qs.q, f.section, f.division, f.code, contains(lower(section_name), qs.q) OR contains(lower(section_official), qs.q) OR lower(section) = qs.q AS sm,
  contains(lower(division_name), qs.q) OR division = qs.q AS dm, contains(lower(activity), qs.q) OR contains(dotted, qs.q) OR contains(code, qs.q) AS am FROM qs CROSS JOIN f),
w AS (SELECT *, bool_or(sm) OVER (PARTITION BY q, section) AS s_any, bool_or(dm) OVER (PARTITION BY q, section, division) AS d_any FROM m)
SELECT DISTINCT q, 'section' AS level, section, NULL AS division, NULL AS code, low, high FROM w JOIN s USING (section) WHERE s_any
UNION ALL SELECT DISTINCT q, 'division', section, division, NULL, low, high FROM w JOIN d USING (section, division) WHERE d_any AND NOT s_any
UNION ALL SELECT DISTINCT q, 'activity', section, division, code, place, place FROM w JOIN n USING (section, division, code) WHERE am AND NOT s_any AND NOT d_any""")
def _(fx):
    return T.taxonomy_match(fx("tax_query"), cut(T.taxonomy_flatten(fx("tree")), "taxonomy"))
