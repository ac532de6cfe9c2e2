"""Model-registry data as tables: version order, listings, effective model, promotion state,
clinic catalog merge and identifier resolution.  (Artifacts themselves are Spark ML
``save``/``load`` folders; only their metadata is relational.)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from looplake.functions import scalars as S

# Fixed value: UUID text pattern passed through unchanged by identifier resolution.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def version_order_key(v: str = "version") -> list[Column]:
    """Names with '_' (timestamped) first, then the others; each group in descending text order."""
    return [F.col(v).contains("_").desc(), F.col(v).desc()]


def version_order(versions: DataFrame, by: list | None = None, v: str = "version") -> DataFrame:
    by = list(by or [])
    d = versions.select(*by, v).distinct()
    w = Window.partitionBy(*by).orderBy(*version_order_key(v)) if by else Window.orderBy(*version_order_key(v))
    return d.withColumn("rank", F.row_number().over(w))


def merge_versions(registry: DataFrame) -> DataFrame:
    """Per tenant: its own versions ∪ global versions, deduplicated, in version order."""
    glob = registry.where(F.col("clinic_id").isNull()).select("version").distinct()
    tenants = registry.where(F.col("clinic_id").isNotNull()).select("clinic_id").distinct()
    own = registry.where(F.col("clinic_id").isNotNull()).select("clinic_id", "version")
    u = own.unionByName(tenants.crossJoin(glob))
    return version_order(u, ["clinic_id"])


def registry_versions(registry: DataFrame, effective: DataFrame) -> DataFrame:
    """Per tenant listing: own versions first (version order), then every global version labelled
    ' - global'; ``is_active`` marks the tenant's effective model."""
    tenants = registry.where(F.col("clinic_id").isNotNull()).select("clinic_id").distinct()
    own = version_order(registry.where(F.col("clinic_id").isNotNull()).select("clinic_id", "version"), ["clinic_id"])
    own = own.select("clinic_id", "version", F.lit("clinic").alias("storage_scope"), F.col("version").alias("label"),
                     F.col("rank").alias("_r"), F.lit(0).alias("_grp"))
    glob = version_order(registry.where(F.col("clinic_id").isNull()).select("version"))
    g = tenants.crossJoin(glob).select(
        "clinic_id", "version", F.lit("global").alias("storage_scope"),
        S.display_label(F.col("version"), F.lit(True)).alias("label"), F.col("rank").alias("_r"), F.lit(1).alias("_grp"))
    rows = own.unionByName(g)
    w = Window.partitionBy("clinic_id").orderBy("_grp", "_r")
    eff = effective.select(F.col("clinic_id").alias("_ec"), F.col("version").alias("_ev"),
                           F.col("storage_scope").alias("_es"))
    out = rows.withColumn("position", F.row_number().over(w))
    j = out.join(eff, (out["clinic_id"] == eff["_ec"]), "left")
    return j.select("clinic_id", "position", "version", "storage_scope", "label",
                    F.coalesce((F.col("version") == F.col("_ev")) & (F.col("storage_scope") == F.col("_es")),
                               F.lit(False)).alias("is_active"))


def resolve_scope(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """A tenant's own copy of a version is used only when all three artifacts exist; else global."""
    own = registry.where(F.col("clinic_id").isNotNull()).select(
        F.col("clinic_id").alias("_c"), F.col("version").alias("_v"),
        (F.col("has_model") & F.col("has_tab") & F.col("has_symptoms")).alias("_complete"))
    j = requests.join(own, (S.normalize_clinic_key(requests["clinic_id"]) == F.col("_c"))
                      & (requests["version"] == F.col("_v")), "left")
    return j.select(*[requests[c] for c in requests.columns],
                    F.when(F.coalesce(F.col("_complete"), F.lit(False)), F.lit("clinic")).otherwise(F.lit("global"))
                    .alias("storage_scope"))


def effective_model(registry: DataFrame, pins: DataFrame) -> DataFrame:
    """Per scope (each tenant and global NULL): the tenant pin, else the global pin, else the newest
    global version in version order.  ``source`` tells which rule applied."""
    scopes = registry.select("clinic_id").distinct()
    p = pins.select(F.col("clinic_id").alias("_pc"), F.col("version").alias("_pv"))
    gpin = pins.where(F.col("clinic_id").isNull()).select(F.col("version").alias("_gv"))
    newest = (version_order(registry.where(F.col("clinic_id").isNull()).select("version"))
              .where(F.col("rank") == 1).select(F.col("version").alias("_nv")))
    j = scopes.join(p, scopes["clinic_id"].eqNullSafe(F.col("_pc")), "left")
    # one global pin and one newest version: single-row sides
    j = j.join(F.broadcast(gpin), F.lit(True), "left").join(F.broadcast(newest), F.lit(True), "left")
    tenant_pin = F.col("clinic_id").isNotNull() & F.col("_pv").isNotNull()
    version = F.when(tenant_pin, F.col("_pv")).otherwise(F.coalesce(F.col("_gv"), F.col("_nv")))
    source = F.when(tenant_pin, F.lit("clinic_pin")).otherwise(F.lit("global_default"))
    out = j.select("clinic_id", version.alias("version"), source.alias("source"))
    scoped = resolve_scope(out, registry)
    return scoped


def registry_status(registry: DataFrame, by: list | None = None) -> DataFrame:
    """Versions per status, newest name first."""
    by = list(by or [])
    return registry.groupBy(*by, "status").agg(
        F.array_join(F.sort_array(F.collect_set("version"), asc=False), ",").alias("versions"),
        F.count(F.lit(1)).alias("n"))


def next_version(registry: DataFrame) -> DataFrame:
    """Per scope: numeric max of vMAJOR.MINOR (by integer parts) with MINOR + 1; none -> v1.0."""
    body = F.expr("substring(version, 2)")
    ok = F.col("version").startswith("v") & F.regexp_replace(body, r"\.", "").rlike("^[0-9]+$") & body.contains(".")
    parts = F.split(body, r"\.")
    c = registry.where(ok).select("clinic_id", F.element_at(parts, 1).cast("bigint").alias("_maj"),
                                  F.element_at(parts, 2).cast("bigint").alias("_min"))
    latest = c.groupBy("clinic_id").agg(F.max(F.struct("_maj", "_min")).alias("_m"))
    scopes = registry.select("clinic_id").distinct()
    j = scopes.join(latest, scopes["clinic_id"].eqNullSafe(latest["clinic_id"]), "left").select(scopes["clinic_id"], "_m")
    return j.select("clinic_id", F.when(F.col("_m").isNull(), F.lit("v1.0")).otherwise(
        F.concat(F.lit("v"), F.col("_m._maj").cast("string"), F.lit("."), (F.col("_m._min") + 1).cast("string")))
        .alias("next_version"))


def promotion_state(events: DataFrame, cleanup_days: int = 7) -> DataFrame:
    """Fold approval events (seq, version, action, event_at) into each version's state.  The production
    version is the one with the latest approve/rollback; earlier promoted versions are archived;
    a version whose last action is a reject is rejected with a cleanup date."""
    last = events.groupBy("version").agg(F.max_by(F.struct("action", "event_at"), "seq").alias("_l"),
                                         F.max(F.when(F.col("action").isin("approve", "rollback"), F.col("seq")))
                                         .alias("_promo_seq"))
    cur = (events.where(F.col("action").isin("approve", "rollback"))
           .agg(F.max_by("version", "seq").alias("_prod")))
    j = last.crossJoin(F.broadcast(cur))
    status = (F.when(F.col("version") == F.col("_prod"), F.lit("production"))
              .when(F.col("_l.action") == "reject", F.lit("rejected"))
              .when(F.col("_promo_seq").isNotNull(), F.lit("archived"))
              .otherwise(F.lit("staging")))
    return j.select("version", F.col("_l.action").alias("last_action"), status.alias("status"),
                    F.when(F.col("_l.action") == "reject",
                           F.col("_l.event_at") + F.make_dt_interval(F.lit(cleanup_days))).alias("cleanup_at"))


def coerce_catalog_id(c) -> Column:
    t = S.strip(S.col(c).cast("string"))
    return F.when(t.isNull() | (t == "") | F.lower(t).isin("null", "none"), F.lit(None).cast("string")).otherwise(t)


def merge_catalogs(catalog: DataFrame) -> DataFrame:
    """Sources by priority (lower first); first valid id wins; missing name -> 'Clinic <id>'."""
    c = catalog.select("priority", coerce_catalog_id("id").alias("id"), F.col("name")).where(F.col("id").isNotNull())
    first = c.groupBy("id").agg(F.min_by(F.col("name"), F.col("priority")).alias("name"))
    return first.select("id", F.when(F.col("name").isNotNull() & (F.col("name") != ""), F.col("name"))
                        .otherwise(F.concat(F.lit("Clinic "), F.col("id"))).alias("name"))


def clinic_identifier_resolve(inputs: DataFrame, catalog: DataFrame, text_col: str = "user_text") -> DataFrame:
    """UUID text passes; else the first catalog row (id order) whose id or name matches
    case-insensitively; else the text unchanged."""
    t = S.strip(F.col(text_col))
    by_id = catalog.select(F.lower("id").alias("_lid"), F.col("id").alias("_id_hit"))
    by_name = (catalog.where(F.col("name").isNotNull())
               .groupBy(F.lower(S.strip("name")).alias("_lname")).agg(F.min("id").alias("_name_hit")))
    j = (inputs.withColumn("_t", t)
         .join(by_id, F.lower(F.col("_t")) == F.col("_lid"), "left")
         .join(by_name, F.lower(F.col("_t")) == F.col("_lname"), "left"))
    res = (F.when(F.col("_t").isNull() | (F.col("_t") == ""), F.lit(None).cast("string"))
           .when(F.col("_t").rlike(UUID_PATTERN), F.col("_t"))
           .otherwise(F.coalesce(F.least(F.col("_id_hit"), F.col("_name_hit")), F.col("_t"))))
    return j.select(F.col(text_col), res.alias("clinic_id"))
