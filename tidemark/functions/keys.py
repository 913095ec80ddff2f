"""Functions of keys, sequence numbers and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 7
L0_TRIGGER = 4
MEM_MAX_LEVEL = 2
TARGET_FILE_BYTES = 2 * 1024 * 1024
#: The kinds of files, as they are named in a store's folder.
FILE_FORMATS = {"log": "%s/%06d.log", "table": "%s/%06d.ldb", "descriptor": "%s/MANIFEST-%06d", "temp": "%s/%06d.dbtmp"}
SINGLE_FILES = {"current": "CURRENT", "lock": "LOCK", "info": "LOG", "old_info": "LOG.old"}


def packed_order(seq: Column, rtype: Column) -> Column:
    """One long that sorts as (seq, rtype); for sequence numbers under two to the power of 61."""
    return seq * 4 + rtype


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two keys share."""
    n = F.least(F.length(a), F.length(b))
    at = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), False)
    return F.when(n == 0, 0).when(at == 0, n).otherwise(at - 1).cast("int")


def separator(a: Column, b: Column) -> Column:
    """A short key k with a <= k < b, for keys a < b: one character more than what they share if that is below b, else a."""
    k = F.substr(b, F.lit(1), common_prefix(a, b) + 1)
    return F.when((a <= k) & (k < b), k).otherwise(a)


def level_budget(level: Column) -> Column:
    """Bytes that a level may hold: 10 MiB for the levels 0 and 1, ten times more for each further one."""
    return F.lit(10.0 * 1024 * 1024) * F.pow(F.lit(10.0), F.greatest(level - 1, F.lit(0)))


def file_name(kind: str, folder: Column, number: Column) -> Column:
    """The name of a file of a kind."""
    if kind in SINGLE_FILES:
        return F.concat(folder, F.lit(f"/{SINGLE_FILES[kind]}"))
    return F.format_string(FILE_FORMATS[kind], folder, number)


def parsed_name(name: Column) -> tuple[Column, Column]:
    """Number (-1 if none is known, 0 for single files) and kind (null if unknown) of a file name, by its last part."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    digits = F.regexp_extract(base, r"^(?:MANIFEST-)?(\d+)", 1)
    suffix = F.regexp_extract(base, r"^\d+\.(\w+)$", 1)
    kind = F.when(base.rlike(r"^MANIFEST-\d+$"), "descriptor").when(base == "CURRENT", "current").when(base == "LOCK", "lock").when(base == "LOG", "info").when(base == "LOG.old", "old_info")
    kind = kind.when(suffix == "log", "log").when(suffix == "ldb", "table").when(suffix == "dbtmp", "temp")
    number = F.when(kind.isNull(), -1).when(digits == "", 0).otherwise(digits.cast("long"))
    return number.cast("long"), kind


def bloom_hashes(bits_per_key: int) -> int:
    """How many bits each key sets: 0.69 for each of its bits, from 1 to 30."""
    return min(30, max(1, int(bits_per_key * 0.69)))


def bloom_positions(key: Column, bits: Column, hashes: int) -> Column:
    """The bits that a key sets in a filter of ``bits`` bits, by double hashing from its CRC-32."""
    word = 4294967295
    h = F.crc32(key.cast("binary"))
    delta = F.shiftrightunsigned(h, 17).bitwiseOR(F.shiftleft(h, 15).bitwiseAND(F.lit(word)))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda j: (h + j * delta).bitwiseAND(F.lit(word)) % bits)
