"""Catalog: model registry data, TOP6, SET4-5, JON9, JON11, SCL13."""

from __future__ import annotations

from pyspark.sql import functions as F

from looplake.functions import scalars as S
from looplake.operators import registry as R
from looplake.plans.catalog_scope import blank_null_sql, strip_sql
from looplake.plans.registry import query

ORDER_SQL = "contains(version, '_') DESC, version DESC"


@query("version_order", f"""
SELECT clinic_id, version, row_number() OVER (PARTITION BY clinic_id ORDER BY {ORDER_SQL}) AS rank
FROM (SELECT DISTINCT clinic_id, version FROM fx_registry_d)""")
def _version_order(fx):
    return R.version_order(fx.registry_d.select("clinic_id", "version"), ["clinic_id"])


MERGE_SQL = f"""
mv_u AS (SELECT clinic_id, version FROM fx_registry_d WHERE clinic_id IS NOT NULL
         UNION SELECT t.clinic_id, g.version FROM (SELECT DISTINCT clinic_id FROM fx_registry_d WHERE clinic_id IS NOT NULL) t
               CROSS JOIN (SELECT DISTINCT version FROM fx_registry_d WHERE clinic_id IS NULL) g),
merged AS (SELECT clinic_id, version, row_number() OVER (PARTITION BY clinic_id ORDER BY {ORDER_SQL}) AS rank FROM mv_u)"""


@query("merge_versions", f"WITH {MERGE_SQL} SELECT * FROM merged")
def _merge_versions(fx):
    return R.merge_versions(fx.registry_d)


EFFECTIVE_SQL = f"""
scopes AS (SELECT DISTINCT clinic_id FROM fx_registry_d),
newest AS (SELECT version AS nv FROM (SELECT DISTINCT version FROM fx_registry_d WHERE clinic_id IS NULL)
           ORDER BY {ORDER_SQL} LIMIT 1),
gpin AS (SELECT version AS gv FROM fx_pin_d WHERE clinic_id IS NULL),
eff0 AS (SELECT s.clinic_id,
                CASE WHEN s.clinic_id IS NOT NULL AND p.version IS NOT NULL THEN p.version
                     ELSE COALESCE(gpin.gv, newest.nv) END AS version,
                CASE WHEN s.clinic_id IS NOT NULL AND p.version IS NOT NULL THEN 'clinic_pin' ELSE 'global_default' END
                  AS source
         FROM scopes s LEFT JOIN fx_pin_d p ON s.clinic_id IS NOT DISTINCT FROM p.clinic_id
         LEFT JOIN gpin ON TRUE LEFT JOIN newest ON TRUE),
eff AS (SELECT e.clinic_id, e.version, e.source,
               CASE WHEN COALESCE(r.has_model AND r.has_tab AND r.has_symptoms, FALSE) THEN 'clinic' ELSE 'global' END
                 AS storage_scope
        FROM eff0 e LEFT JOIN fx_registry_d r
          ON r.clinic_id IS NOT NULL AND {blank_null_sql('e.clinic_id')} = r.clinic_id AND e.version = r.version)"""


def _effective(fx):
    return R.effective_model(fx.registry_d, fx.pin_d)


@query("effective_model", f"WITH {EFFECTIVE_SQL} SELECT * FROM eff")
def _effective_model(fx):
    return _effective(fx)


@query("registry_versions", f"""
WITH {EFFECTIVE_SQL},
tenants AS (SELECT DISTINCT clinic_id FROM fx_registry_d WHERE clinic_id IS NOT NULL),
own AS (SELECT clinic_id, version, 'clinic' AS storage_scope, version AS label,
               row_number() OVER (PARTITION BY clinic_id ORDER BY {ORDER_SQL}) AS r, 0 AS grp
        FROM (SELECT DISTINCT clinic_id, version FROM fx_registry_d WHERE clinic_id IS NOT NULL)),
gv AS (SELECT version, row_number() OVER (ORDER BY {ORDER_SQL}) AS r
         FROM (SELECT DISTINCT version FROM fx_registry_d WHERE clinic_id IS NULL)),
g AS (SELECT t.clinic_id, gv.version, 'global' AS storage_scope,
             CASE WHEN NOT ends_with(gv.version, ' - global') THEN gv.version || ' - global' ELSE gv.version END
               AS label, gv.r, 1 AS grp FROM tenants t CROSS JOIN gv),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY clinic_id ORDER BY grp, r) AS position
          FROM (SELECT * FROM own UNION ALL SELECT * FROM g))
SELECT r.clinic_id, r.position, r.version, r.storage_scope, r.label,
       COALESCE(r.version = e.version AND r.storage_scope = e.storage_scope, FALSE) AS is_active
FROM rows_ r LEFT JOIN eff e ON r.clinic_id = e.clinic_id""")
def _registry_versions(fx):
    return R.registry_versions(fx.registry_d, _effective(fx))


@query("resolve_scope", f"""
WITH {MERGE_SQL}
SELECT m.clinic_id, m.version,
       CASE WHEN COALESCE(r.has_model AND r.has_tab AND r.has_symptoms, FALSE) THEN 'clinic' ELSE 'global' END
         AS storage_scope
FROM merged m LEFT JOIN fx_registry_d r
  ON r.clinic_id IS NOT NULL AND {blank_null_sql('m.clinic_id')} = r.clinic_id AND m.version = r.version""")
def _resolve_scope(fx):
    req = R.merge_versions(fx.registry_d).select("clinic_id", "version")
    return R.resolve_scope(req, fx.registry_d)


@query("registry_status", """
SELECT clinic_id, status, array_to_string(list_sort(list(DISTINCT version), 'DESC'), ',') AS versions, count(*) AS n
FROM fx_registry_d GROUP BY clinic_id, status""")
def _registry_status(fx):
    return R.registry_status(fx.registry_d, ["clinic_id"])


@query("next_version", """
WITH ok AS (SELECT clinic_id, CAST(split_part(substr(version, 2), '.', 1) AS BIGINT) AS maj,
                   CAST(split_part(substr(version, 2), '.', 2) AS BIGINT) AS mnr
            FROM fx_registry_d
            WHERE starts_with(version, 'v') AND regexp_matches(replace(substr(version, 2), '.', ''), '^[0-9]+$')
              AND contains(substr(version, 2), '.')),
m AS (SELECT clinic_id, max({'maj': maj, 'mnr': mnr}) AS m FROM ok GROUP BY clinic_id),
s AS (SELECT DISTINCT clinic_id FROM fx_registry_d)
SELECT s.clinic_id, CASE WHEN m.m IS NULL THEN 'v1.0' ELSE 'v' || m.m.maj || '.' || (m.m.mnr + 1) END AS next_version
FROM s LEFT JOIN m ON s.clinic_id IS NOT DISTINCT FROM m.clinic_id""")
def _next_version(fx):
    return R.next_version(fx.registry_d)


@query("promotion_state", """
WITH lst AS (SELECT version, arg_max(action, seq) AS last_action, arg_max(event_at, seq) AS last_at,
                     max(CASE WHEN action IN ('approve', 'rollback') THEN seq END) AS promo_seq
              FROM fx_approval_d GROUP BY version),
cur AS (SELECT arg_max(version, seq) AS prod FROM fx_approval_d WHERE action IN ('approve', 'rollback'))
SELECT version, last_action,
       CASE WHEN version = cur.prod THEN 'production' WHEN last_action = 'reject' THEN 'rejected'
            WHEN promo_seq IS NOT NULL THEN 'archived' ELSE 'staging' END AS status,
       CASE WHEN last_action = 'reject' THEN last_at + INTERVAL 7 DAY END AS cleanup_at
FROM lst, cur""")
def _promotion_state(fx):
    return R.promotion_state(fx.approval_d)


_CATALOG_SQL = f"""
cat AS (SELECT priority, CASE WHEN {strip_sql('CAST(id AS VARCHAR)')} = ''
                              OR lower({strip_sql('CAST(id AS VARCHAR)')}) IN ('null', 'none') THEN NULL
                              ELSE {strip_sql('CAST(id AS VARCHAR)')} END AS id, name FROM fx_catalog_d),
merged_cat AS (SELECT id, CASE WHEN name IS NOT NULL AND name <> '' THEN name ELSE 'Clinic ' || id END AS name
               FROM (SELECT id, arg_min(name, priority) AS name FROM cat WHERE id IS NOT NULL GROUP BY id))"""


@query("merge_catalogs", f"WITH {_CATALOG_SQL} SELECT * FROM merged_cat")
def _merge_catalogs(fx):
    return R.merge_catalogs(fx.catalog_d)


@query("clinic_identifier_resolve", f"""
WITH {_CATALOG_SQL},
inp AS (SELECT user_text, {strip_sql('user_text')} AS t FROM fx_clinic_inputs_d),
byid AS (SELECT lower(id) AS lid, id FROM merged_cat),
byname AS (SELECT lower({strip_sql('name')}) AS lname, min(id) AS id FROM merged_cat WHERE name IS NOT NULL GROUP BY 1)
SELECT inp.user_text,
       CASE WHEN t IS NULL OR t = '' THEN NULL
            WHEN regexp_matches(t, '{R.UUID_PATTERN}') THEN t
            ELSE COALESCE(least(byid.id, byname.id), t) END AS clinic_id
FROM inp LEFT JOIN byid ON lower(inp.t) = byid.lid LEFT JOIN byname ON lower(inp.t) = byname.lname""")
def _clinic_identifier_resolve(fx):
    return R.clinic_identifier_resolve(fx.clinic_inputs_d, R.merge_catalogs(fx.catalog_d))


@query("effective_model_join", f"""
WITH {EFFECTIVE_SQL},
tenants AS (SELECT DISTINCT {blank_null_sql('clinic_id')} AS clinic_id FROM fx_prediction_log
            WHERE {blank_null_sql('clinic_id')} IS NOT NULL),
g AS (SELECT version AS gv FROM eff WHERE clinic_id IS NULL)
SELECT t.clinic_id, COALESCE(e.version, g.gv) AS version, COALESCE(e.source, 'global_default') AS source
FROM tenants t LEFT JOIN eff e ON t.clinic_id = e.clinic_id LEFT JOIN g ON TRUE""")
def _effective_model_join(fx):
    eff = _effective(fx)
    g = eff.where(F.col("clinic_id").isNull()).select(F.col("version").alias("_gv"))
    tenants = (fx.prediction_log.select(S.normalize_clinic_key("clinic_id").alias("clinic_id"))
               .where(F.col("clinic_id").isNotNull()).distinct())
    j = (tenants.join(eff.where(F.col("clinic_id").isNotNull()), "clinic_id", "left")
         .join(F.broadcast(g), F.lit(True), "left"))
    return j.select("clinic_id", F.coalesce("version", "_gv").alias("version"),
                    F.coalesce("source", F.lit("global_default")).alias("source"))


@query("display_label", """
SELECT DISTINCT version, CASE WHEN NOT ends_with(version, ' - global') THEN version || ' - global' ELSE version END AS label
FROM (SELECT version FROM fx_registry_d WHERE clinic_id IS NULL
      UNION ALL SELECT version || ' - global' FROM fx_registry_d WHERE clinic_id IS NULL)""")
def _display_label(fx):
    g = fx.registry_d.where(F.col("clinic_id").isNull()).select("version")
    v = g.unionByName(g.select(F.concat("version", F.lit(" - global")).alias("version")))
    return v.select("version", S.display_label(F.col("version"), F.lit(True)).alias("label")).distinct()
