"""String functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    """Lower case, blanks as "_", other marks dropped; "_" trimmed at the ends, doubled ones halved once."""
    kept = F.regexp_replace(F.lower(F.replace(text, F.lit(" "), F.lit("_"))), "[^a-z0-9_]", "")
    return F.replace(F.trim(kept, F.lit("_")), F.lit("__"), F.lit("_"))


def track_display_name(sequence_id: Column) -> Column:
    """What follows the first "-"; the whole without one; empty for null."""
    return F.coalesce(F.regexp_replace(sequence_id, "^[^-]*-", ""), F.lit(""))


def last_path_part(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def track_id(day: Column, root: Column) -> Column:
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-SEQ-"), root.cast("string"))


def absolute_path(base: Column, path: Column) -> Column:
    """`path` under `base`, unless it holds `base` already; null for null or empty paths."""
    inside = F.contains(path, base)
    return F.when(path.isNull() | (path == ""), F.lit(None)).when(inside, path).otherwise(F.concat_ws("/", F.rtrim(base, F.lit("/")), path))


def split_label(label: Column) -> Column:
    return F.replace(label, F.lit(" "), F.lit("\n"))


def model_key(key: Column, name: Column) -> Column:
    return F.coalesce(key, slugify(name))


def service_name(name: Column, host: Column) -> Column:
    return F.concat(name, F.lit(" ("), host, F.lit(")"))


def crop_name(source_id: Column, box: Column, stamp: Column) -> Column:
    """File name of a crop; the clock is given."""
    return F.concat_ws("-", slugify(source_id), F.array_join(F.transform(box, lambda x: x.cast("int").cast("string")), "_"), stamp)


def url_basename(url: Column) -> Column:
    """Last segment of a URL's path."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    return F.element_at(F.split(path, "/"), -1)


def strip_data_uri(text: Column) -> Column:
    return F.regexp_replace(text, r"^data:[^,]*,", "")


def decode_base64(text: Column) -> Column:
    """Bytes of base64 text, with or without a data URI before it; an error where it is neither."""
    return F.unbase64(strip_data_uri(text))


def integer_label(name: Column) -> Column:
    """The label as a number, null where it isn't one."""
    return name.try_cast("long")
