"""Values of records: exact numbers, JSON fields and digests, versions of the protocol, ids, text blocks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

#: Versions 0.x of the protocol that are read; later minors are read with a warning.
SUPPORTED_MINORS = (1, 5)
_NUMBER = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
UNITS = ("B", "KiB", "MiB", "GiB", "TiB")


def hexed(text):
    """Lower-case hex of a text's UTF-8."""
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def unhexed(value):
    """Bytes of lower-case hex; null for anything else."""
    return F.when(value.rlike(r"\A([0-9a-f]{2})*\z"), F.unhex(value))


def integral(text):
    """The whole number that a JSON number spells exactly, whatever its form (1e3, 10.0), as a long; null for fractions, texts of another form, and numbers beyond a long."""
    number = F.when(text.rlike(_NUMBER), text).try_cast("decimal(38,9)")
    return F.when(number == F.floor(number), number).try_cast("long")


def compatibility(version):
    """`supported`, `future_minor` or `unsupported` of a protocol version 0.minor.patch, with or without a suffix."""
    shape = r"\A([0-9]+)\.([0-9]+)\.[0-9]+(?:[-+][0-9A-Za-z.-]+)?\z"
    major, minor = (F.regexp_extract(version, shape, i).try_cast("long") for i in (1, 2))
    known = minor.isin(*SUPPORTED_MINORS)
    state = F.when((major == 0) & known, "supported").when((major == 0) & (minor > SUPPORTED_MINORS[0]), "future_minor")
    return F.when(version.isNotNull(), F.coalesce(state, F.lit("unsupported")))


def id_of_digest(prefix: str, sha256):
    """An id made of a digest's first sixteen bytes, with the version and variant that ids must have."""
    h = sha256
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("7"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit(f"{prefix}_"), F.concat_ws("-", *parts))


def new_id(prefix: str):
    """A new id: the milliseconds of now, then random bits. No two rows or runs share one."""
    now = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    some = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return id_of_digest(prefix, F.concat(now, F.lit("0"), F.substring(some, 1, 19), F.lit("0" * 32)))


def human_bytes(size):
    """Bytes in the largest unit that leaves at least one, with one decimal beyond bytes."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(UNITS[1:], 1):
        out = F.when(size >= 1 << 10 * k, F.concat(F.format_string("%.1f", size.cast("double") / float(1 << 10 * k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def saturating_sum(column):
    """The sum of longs, at most the largest long."""
    return F.least(F.sum(F.col(column).cast("decimal(38,0)")), F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")).cast("long")


def policy_digest(rules: list[str], own):
    """SHA-256 over the engine's ignore rules and the text of the user's own; no own rules and an empty file of them differ."""
    engine = "\n".join(rules).encode().hex()
    framed = F.when(own.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), hexed(own)))
    return F.sha2(F.unhex(F.concat(F.lit(f"{engine}00"), framed)), 256)


def canonical_json(value) -> str:
    """Compact JSON with sorted members, on the driver."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def row_digest(*columns: str):
    """SHA-256 of a row's columns as compact JSON with members by name; nulls are members too."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def json_kind(record, pointer: str):
    """`string`, `number`, `boolean`, `array`, `object` or `null` of the JSON value at a pointer ($.a.b); null if there is none. record: a variant."""
    kind = F.schema_of_variant(F.try_variant_get(record, pointer, "variant"))
    return (
        F.when(kind.isNull(), None).when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").otherwise("number")
    )


def json_text(record, pointer: str):
    """The string at a pointer; null if there is none or it is something else."""
    return F.when(json_kind(record, pointer) == "string", F.try_variant_get(record, pointer, "string"))


def spliced(text, begin: str, end: str, block):
    """`text` with what stands between the first markers `begin` and `end` replaced; null if there isn't exactly one of each, in that order."""
    once = (F.size(F.split(text, F.lit(f"\\Q{begin}\\E"), -1)) == 2) & (F.size(F.split(text, F.lit(f"\\Q{end}\\E"), -1)) == 2)
    head, rest = F.substring_index(text, begin, 1), F.substring_index(text, begin, -1)
    return F.when(once & rest.contains(end), F.concat(head, F.lit(begin), block, F.lit(end), F.substring_index(rest, end, -1)))
