"""Label, identifier and text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import as_col

# The shape of a machine identifier, prefixes of injected turns, slug shape, digit folding.
MACHINE_IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:/@+~-]*\z"
INJECTED_PREFIXES = ("<system-reminder", "<command-", "Caveat:")
SLUG = r"^[a-z0-9](?:[a-z0-9-]{0,30}[a-z0-9])?\z"
FOLD_FROM = "0134578@$"
FOLD_TO = "oieastbas"
REGION_PREFIXES = ("us", "eu", "au", "jp", "apac", "global", "anthropic", "amazon", "meta", "openai", "google",
                   "vertex", "azure", "mistral")


def strip(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(as_col(text), F.lit("")), r"^\s+|\s+$", "")


def machine_label(text: Column | str, kind: str, max_length: int) -> Column:
    """The trimmed label when it looks like an identifier, else ``kind-`` plus a 12-digit digest."""
    trimmed = strip(text)
    digest = F.substring(F.sha2(F.concat(F.lit(kind + "\0"), trimmed), 256), 1, 12)
    keep = (F.length(trimmed) <= max_length) & trimmed.rlike(MACHINE_IDENTIFIER)
    return F.when(keep, trimmed).otherwise(F.concat(F.lit(kind + "-"), digest))


def session_pseudonym(session_id: Column | str) -> Column:
    raw = F.coalesce(as_col(session_id).cast("string"), F.lit(""))
    return F.concat(F.lit("local-"), F.substring(F.sha2(F.concat(F.lit("session\0"), raw), 256), 1, 24))


def request_hash(key: Column | str) -> Column:
    return F.substring(F.sha2(as_col(key), 256), 1, 32)


def is_human_text(text: Column) -> Column:
    """Real typed text: not blank and not an injected turn."""
    trimmed = strip(text)
    verdict = F.length(trimmed) > 0
    for prefix in INJECTED_PREFIXES:
        verdict = verdict & ~trimmed.startswith(prefix)
    return F.coalesce(verdict, F.lit(False))


def model_key(model: Column | str) -> Column:
    """Model id in the key space of the price table: lower case, no path, region or revision parts."""
    key = F.lower(strip(model))
    key = F.regexp_replace(key, r"^(?s:.*)/", "")
    vendors = "|".join(REGION_PREFIXES)
    key = F.regexp_replace(key, rf"^(?:{vendors})\.(?:[a-z0-9_-]+\.)*([a-z])", "$1")
    return F.regexp_replace(F.regexp_replace(key, r":\d+$", ""), r":latest$", "")


def dateless_key(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key, r"[-@]20\d{6}$", ""), r"-20\d{2}-\d{2}-\d{2}$", "")


def key_candidates(model: Column | str) -> Column:
    """Price keys to try, best first: exact, without date, without ``-latest``, then up to three tail trims."""
    exact = model_key(model)
    dateless = dateless_key(exact)
    words = F.split(dateless, "-")

    def trim(n: int) -> Column:
        kept = F.size(words) - n
        return F.when(kept >= 2, F.array_join(F.slice(words, 1, F.greatest(kept, F.lit(1))), "-"))

    latest = F.when(exact.endswith("-latest"), F.regexp_replace(exact, r"-latest$", ""))
    options = F.array(exact, F.when(dateless != exact, dateless), latest, trim(1), trim(2), trim(3))
    return F.filter(options, lambda c: c.isNotNull())


def session_label(project_folder: Column | str) -> Column:
    """Last two non-empty parts of a dash-joined project folder name."""
    folder = as_col(project_folder)
    parts = F.filter(F.split(folder, "-"), lambda p: p != "")
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.when(F.size(parts) > 0, F.array_join(tail, "/")).otherwise(folder)


def clean_control(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), r"[\x00-\x1f\x7f]", "")


def session_name(session_id: Column | str, label: Column | str | None = None) -> Column:
    """The mapped label (64 characters at most) or the last path segment of the id (24 at most)."""
    raw = as_col(session_id)
    segments = F.filter(F.split(raw, "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), raw)
    fallback = F.coalesce(F.nullif(F.substring(clean_control(last), 1, 24), F.lit("")), F.lit("session"))
    if label is None:
        return fallback
    named = F.nullif(as_col(label), F.lit(""))
    shown = F.coalesce(F.nullif(F.substring(clean_control(named), 1, 64), F.lit("")), F.lit("session"))
    return F.when(named.isNotNull(), shown).otherwise(fallback)


def fold_word(word: Column) -> Column:
    """A lower-case word with digits folded to letters and anything else removed."""
    return F.regexp_replace(F.translate(word, FOLD_FROM, FOLD_TO), r"[^a-z]", "")


def screen_registry(names: DataFrame, reserved: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Slugs with ``valid_slug`` and ``clean_text`` flags.

    ``names(slug)``, ``reserved(word)``, ``blocklist(word)``; the two word tables are the caller's.
    """
    shaped = names.withColumn(
        "shape_ok",
        F.length("slug").between(2, 32) & F.col("slug").rlike(SLUG) & ~F.col("slug").contains("--"),
    )
    checked = shaped.join(reserved.select(F.col("word").alias("slug"), F.lit(True).alias("is_reserved")).distinct(),
                          "slug", "left")
    dirty = (
        names.select("slug", F.explode(F.split(F.lower("slug"), r"[^a-z0-9@$]+")).alias("run"))
        .select("slug", fold_word(F.col("run")).alias("word"))
        .filter("word <> ''")
        .join(blocklist.select("word").distinct(), "word", "left_semi")
        .select("slug", F.lit(True).alias("is_dirty"))
        .distinct()
    )
    return checked.join(dirty, "slug", "left").select(
        "slug",
        (F.col("shape_ok") & F.col("is_reserved").isNull()).alias("valid_slug"),
        F.col("is_dirty").isNull().alias("clean_text"),
    )
