"""Column functions on ids, paths and header text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: names of volume files.
VOLUME_NAME = r"^[\w.-]+\.nii(\.gz)?$"


def swap_suffix(path: Column, new: str) -> Column:
    return F.regexp_replace(path, r"\.nii\.gz$", new)


def short_id(name: Column, length: int = 14) -> Column:
    return F.when(F.length(name) > length, F.concat(F.substring(name, 1, length - 1), F.lit("…"))).otherwise(name)


def safe_id(name: Column) -> Column:
    return F.translate(name, "/\\:", "___")


def is_volume_name(name: Column) -> Column:
    return name.rlike(VOLUME_NAME)


def header_text(field: Column) -> Column:
    """Latin-1 text of a binary header field up to its first NUL, trimmed."""
    return F.trim(F.substring_index(F.decode(field, "ISO-8859-1"), "\u0000", 1))


def stable_seed(base: int | str, name: Column) -> Column:
    """The first 8 hex digits of sha256("base:name") as a number."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{base}:"), name), 256), 1, 8), 16, 10).cast("long")


def hash_order(base: int | str, name: Column) -> Column:
    """A seeded shuffle key."""
    return F.sha2(F.concat(F.lit(f"{base}:"), name), 256)


def fingerprint(path: Column, size: Column, modified: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", path, size.cast("string"), modified.cast("string"))), 1, 16)


def percent_label(z: Column, lo: Column, hi: Column) -> Column:
    """Rounded half to even."""
    return F.rint((z - lo) / F.greatest(hi - lo, F.lit(1)) * 100).cast("int")


def human_bytes(size: Column) -> Column:
    """1536 -> 1.5 KB; one digit, rounded half to even."""
    one = lambda i, name: F.concat(F.bround(size / 1024.0**i, 1).cast("string"), F.lit(f" {name}"))
    out = one(4, "TB")
    for i, name in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(size < 1024.0 ** (i + 1), one(i, name)).otherwise(out)
    return out
