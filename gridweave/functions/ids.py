"""Column functions over ids, hashes, names and sizes; all are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the digits of the base-32 form.
DIGITS = "0123456789abcdfghijklmnpqrsvwxyz"
#: What joins hashed fields: these three characters.
JOINER = "x00"


def canonical_params(names: list[str]) -> Column:
    """Compact JSON of the named columns, keys sorted, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"}) if names else F.lit("{}")


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def base32(hex_digest: Column, keep: int = 52) -> Column:
    """The first ``keep`` of 52 base-32 digits of a SHA-256, most significant first.

    The digest is a number whose last byte is the highest: its bytes are reversed, and every ten hex digits of its 65
    (the first is 0) are eight of base 32.
    """
    groups = -(-keep // 8)
    need = min(64, 10 * groups - 1)  # hex digits behind the 0
    nibbles = F.reverse(F.substring(hex_digest, 64 - 2 * (-(-need // 2)) + 1, 2 * (-(-need // 2))))
    number = F.concat(F.lit("0"), F.regexp_replace(nibbles, "(.)(.)", "$2$1"))
    size = [min(10, 65 - 10 * i) for i in range(groups)]
    parts = [F.lpad(F.conv(F.substring(number, 10 * i + 1, k), 16, 32), 8 * k // 10, "0") for i, k in enumerate(size)]
    return F.substring(F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", DIGITS), 1, keep)


def content_id(*fields: Column) -> Column:
    """32 base-32 digits of the SHA-256 of the joined fields."""
    return base32(sha256_hex(F.concat_ws(JOINER, *fields)), 32)


def short_id(c: Column) -> Column:
    """The first 12 characters of an id's hash, if it has that many."""
    return F.regexp_replace(c, "^([^-]{12})[^-]*-", "$1-")


def stage_of(c: Column) -> Column:
    """The stage name of ``<hash>-<name>-<version>``; null where the last part is no dotted or numeric version."""
    name = F.regexp_extract(c, r"^[^-]*-(.+)-(\d+|[^-]*\.[^-]*)$", 1)
    return F.when(name != "", name)


def root_hash(name: Column, kind: Column) -> Column:
    """auto: what follows the time stamp (or the fourth part, or ???); pinned: the name without the metadata suffix."""
    parts = F.split(name, "_")
    auto = F.when(F.length(name) > 20, F.substring(name, F.lit(21), F.length(name))).when(F.size(parts) >= 4, parts[3]).otherwise("???")
    return F.when(kind == "auto", auto).otherwise(F.regexp_replace(name, "-lab-metadata\\.json$", ""))


def mem_to_bytes(c: Column) -> Column:
    """Bytes of 4G, 512M, 16K, 2T or a plain number; null for anything else."""
    up = F.upper(F.trim(c))
    number = F.expr("1") * F.regexp_extract(up, r"^(\d+)([TGMK]?)$", 1).try_cast("bigint")
    unit = F.regexp_extract(up, r"^(\d+)([TGMK]?)$", 2)
    power = F.when(unit == "T", 2**40).when(unit == "G", 2**30).when(unit == "M", 2**20).when(unit == "K", 2**10).otherwise(1)
    return number * power


def get_path(json: Column, path: str) -> Column:
    """A dotted lookup in JSON text; null when absent or not an object."""
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path.split(".")))


def literal(text: str) -> str:
    """A regular expression that matches just this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def glob_to_regex(pattern: Column) -> Column:
    """An anchored regular expression for a glob of ``*`` and ``?``."""
    quoted = F.regexp_replace(pattern, r"([.\\+^$|(){}\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
