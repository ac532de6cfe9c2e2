"""Scalar column expressions (JVM-side built-ins only, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from looplake.config import DEFAULT, Config

# The whitespace set stripped by Python's ``str.strip`` for ASCII text.
WHITESPACE = " \t\n\r\x0b\x0c"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()`` (all ASCII whitespace, unlike SQL TRIM)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def blank_to_null(c) -> Column:
    s = strip(c)
    return F.when(s == "", F.lit(None).cast("string")).otherwise(s)


def normalize_clinic_key(c) -> Column:
    """null / blank -> NULL (global scope), else the stripped text."""
    return blank_to_null(col(c).cast("string"))


def normalize_label(c) -> Column:
    return strip(col(c).cast("string"))


def parse_symptoms(c) -> Column:
    """Comma list -> stripped, lower-cased tokens without blanks; null -> []."""
    toks = F.transform(F.split(F.coalesce(col(c).cast("string"), F.lit("")), ","),
                       lambda x: F.lower(strip(x)))
    return F.filter(toks, lambda x: x != "")


# Words accepted for booleans in uploaded CSV files.
TRUE_WORDS = ("true", "1", "yes", "y", "accept", "accepted")
FALSE_WORDS = ("false", "0", "no", "n", "reject", "rejected")


def parse_bool_words(c) -> Column:
    """true/1/yes/y/accept/accepted -> TRUE, false/0/no/n/reject/rejected -> FALSE, else NULL."""
    w = F.lower(strip(col(c).cast("string")))
    return (F.when(w.isin(*TRUE_WORDS), F.lit(True))
            .when(w.isin(*FALSE_WORDS), F.lit(False))
            .otherwise(F.lit(None).cast("boolean")))


# Fixed value: characters kept in a clinic folder slug.
SLUG_UNSAFE = r"[^a-zA-Z0-9_.-]+"


def clinic_slug(c) -> Column:
    """Folder-safe slug: empty/null -> 'global'; unsafe runs -> '_'; whole text; empty result -> 'clinic'."""
    raw = col(c).cast("string")
    slug = F.regexp_replace(strip(raw), SLUG_UNSAFE, "_")
    return (F.when(raw.isNull() | (raw == ""), F.lit("global"))
            .when(slug == "", F.lit("clinic"))
            .otherwise(slug))


def feedback_weights(quality, rating, cfg: Config = DEFAULT) -> tuple[Column, Column]:
    """(positive weight, negative weight) of one feedback row."""
    r = F.coalesce(F.least(F.greatest(col(rating).cast("double"), F.lit(0.0)), F.lit(5.0)), F.lit(0.0))
    q = F.coalesce(col(quality).cast("double"), F.lit(1.0))
    d_pos = r / 5.0 * cfg.feedback_delta_max * cfg.feedback_accept_strength
    d_neg = (F.lit(5.0) - r) / 5.0 * cfg.feedback_delta_max * cfg.feedback_reject_strength
    pos = F.least(F.lit(cfg.feedback_positive_max_weight), q + d_pos)
    neg = F.greatest(F.lit(cfg.feedback_negative_min_weight), q - d_neg)
    return pos, neg


def to_utc_timestamp_any(c) -> Column:
    """Timestamp column passes; text parses (naive text is UTC); bad text -> NULL."""
    return F.coalesce(F.try_to_timestamp(col(c).cast("string")),
                      F.try_to_timestamp(col(c).cast("string"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))


def feedback_timestamp(feedback_ts, prediction_ts) -> Column:
    """Feedback time, else the prediction's time; unparseable -> NULL."""
    return F.coalesce(to_utc_timestamp_any(feedback_ts), to_utc_timestamp_any(prediction_ts))


def batch_idempotency_key(ids) -> Column:
    """sha256 hex of the compact JSON list of the sorted ids (``[1,2,10]``)."""
    return F.sha2(F.to_json(F.array_sort(col(ids))), 256)


def seed_from_text(text) -> Column:
    """First 4 bytes of sha256(text), big endian, masked to 31 bits."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(2147483647))


def adaptive_split_ratio(n, cfg: Config = DEFAULT) -> Column:
    n = col(n)
    return (F.when(n < cfg.tier_tiny, 0.1).when(n < cfg.tier_small, 0.15)
            .when(n < cfg.tier_medium, 0.2).otherwise(0.25))


def cooldown_seconds(failures, cfg: Config = DEFAULT) -> Column:
    """least(cap, base * 2^least(n, max_exp)) seconds."""
    n = col(failures).cast("int")
    return F.least(F.lit(cfg.cooldown_cap_seconds),
                   (F.lit(cfg.cooldown_base_seconds) * F.pow(F.lit(2), F.least(n, F.lit(cfg.cooldown_max_exponent)))
                    ).cast("int"))


def display_label(version, is_global_for_tenant) -> Column:
    suffix = " - global"
    v = col(version)
    return F.when(col(is_global_for_tenant) & ~v.endswith(suffix), F.concat(v, F.lit(suffix))).otherwise(v)


def iso_hour_key(ts) -> Column:
    """Timestamp (or ISO text with Z) -> 'yyyy-MM-dd HH:00'."""
    t = col(ts)
    return F.date_format(F.date_trunc("hour", t), "yyyy-MM-dd HH:00")


def recommendation(gain, f1, min_gain: float = 0.01, min_f1: float = 0.85) -> Column:
    """APPROVE when gain > 0.01 and f1 >= 0.85; CONSIDER when f1 >= 0.85; else REJECT (fixed values)."""
    return (F.when((col(gain) > min_gain) & (col(f1) >= min_f1), F.lit("APPROVE"))
            .when(col(f1) >= min_f1, F.lit("CONSIDER"))
            .otherwise(F.lit("REJECT")))


def json_text(json_col, path: str) -> Column:
    """Stripped text at a JSON path; blank -> NULL."""
    return blank_to_null(F.get_json_object(col(json_col), path))


def stored_diagnosis(prediction_output, top_k_predictions) -> Column:
    """output.diagnosis -> output.top_k[0].label -> top_k_predictions[0].label; blanks skipped."""
    return F.coalesce(json_text(prediction_output, "$.diagnosis"),
                      json_text(prediction_output, "$.top_k[0].label"),
                      json_text(top_k_predictions, "$[0].label"))


def resolve_clinic(row_clinic, prediction_input) -> Column:
    """row.clinic_id -> input.clinic_id -> input.clinicId -> NULL (each normalized)."""
    return F.coalesce(normalize_clinic_key(row_clinic),
                      json_text(prediction_input, "$.clinic_id"),
                      json_text(prediction_input, "$.clinicId"))


def scope_key(pool, clinic) -> Column:
    """'global:GLOBAL' or 'clinic:<key>:CLINIC_ONLY' (unknown key -> 'unknown')."""
    p = F.upper(strip(F.coalesce(col(pool), F.lit("CLINIC_ONLY"))))
    return F.when(p == "GLOBAL", F.lit("global:GLOBAL")).otherwise(
        F.concat(F.lit("clinic:"), F.coalesce(normalize_clinic_key(clinic), F.lit("unknown")), F.lit(":CLINIC_ONLY")))


def py_fixed(x, decimals: int) -> Column:
    """Text of ``x`` with ``decimals`` places, rounded like Python's ``f"{x:.Nf}"``.

    Python rounds the exact binary value (ties to even); Java's formatter
    rounds the shortest decimal form half-up, so 0.015 would print 0.02 there
    and 0.01 in Python.  The exact product x·10^d is recovered as p + err with
    Dekker's error-free multiplication, which decides the side of a tie.
    """
    v = col(x).cast("double")
    a = F.abs(v)
    scale = float(10 ** decimals)
    p = a * scale
    t = a * 134217729.0
    hi = t - (t - a)
    lo = a - hi
    err = (hi * scale - p) + lo * scale
    fl = F.floor(p)
    frac = p - fl
    up = (F.when(frac > 0.5, 1).when(frac < 0.5, 0)
          .when(err > 0, 1).when(err < 0, 0)
          .when(fl % 2 == 0, 0).otherwise(1))
    n = (fl + up).cast("long")
    ip = (n / F.lit(10 ** decimals).cast("long")).cast("long") if decimals else n
    text = (F.concat(ip.cast("string"), F.lit("."), F.lpad((n % (10 ** decimals)).cast("string"), decimals, "0"))
            if decimals else ip.cast("string"))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), text))
