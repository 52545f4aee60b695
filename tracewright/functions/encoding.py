"""Canonical bytes of records, as built-in column expressions: what digests, keyed hashes and signatures cover."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Fixed values of the encoding: ordinals by position.
KINDS = ("file", "set", "quote", "patch", "mailDraft", "clip", "page", "form", "table", "procedure", "event")
FACES = ("syntax", "sheet", "letter", "waveform", "document")
SOURCE_TAGS = ("deed", "path", "url")
GRANT_TAGS = ("host", "path")
FRAME_MAGIC = "CapNdeed"
FRAME_REVISION = 1


def u8(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2, "0"))


def _little_endian(n: Column, size: int) -> Column:
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def le32(n: Column) -> Column:
    return _little_endian(n, 4)


def le64(n: Column) -> Column:
    return _little_endian(n, 8)


def text(c: Column) -> Column:
    """Byte length, then UTF-8; null counts as empty, which the format uses for no value."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(le32(F.octet_length(c)), c.cast("binary"))


def listing(items: Column, each: Callable[[Column], Column]) -> Column:
    """Item count, then the items. Put together as one join of hex strings, linear in their length."""
    return F.concat(le32(F.size(items)), F.unhex(F.array_join(F.transform(items, lambda x: F.hex(each(x))), "")))


def ordinal(c: Column, names: tuple[str, ...]) -> Column:
    return u8(F.array_position(F.array(*map(F.lit, names)), c) - 1)


def tagged(names: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda s: F.concat(ordinal(s["tag"], names), text(s["value"]))


@F.pandas_udf(BinaryType())
def f64(values: pd.Series) -> pd.Series:
    """Little-endian IEEE 754 bits, which no built-in function gives."""
    return values.map(lambda v: struct.pack("<d", v))


def _pairs(items: Column) -> Column:
    return listing(items, lambda f: F.concat(text(f["name"]), text(f["value"])))


def body_bytes(kind: str, b: Column) -> Column:
    """The fields of one kind's body, after its ordinal."""
    fields = {
        "file": lambda: (text(b["path"]), text(b["media_type"])),
        "set": lambda: (text(b["title"]), listing(b["members"], text)),
        "quote": lambda: (text(b["edition"]), le64(b["start"]), le64(b["end"]), text(b["excerpt"]), listing(b["urls"], text)),
        "patch": lambda: (text(b["tree"]), listing(b["diffs"], text), listing(b["functionaries"], text)),
        "mailDraft": lambda: (text(b["message_id"]), text(b["in_reply_to"]), text(b["subject"]), text(b["path"])),
        "clip": lambda: (listing(b["sources"], text), f64(b["in_point"]), f64(b["out_point"]), f64(b["duration"]), text(b["path"])),
        "page": lambda: (text(b["url"]), text(b["snapshot"])),
        "form": lambda: (text(b["blank"]), _pairs(b["fields"]), text(b["path"])),
        "table": lambda: (_pairs(b["measures"]),),
        "procedure": lambda: (listing(b["steps"], lambda s: F.concat(text(s["text"]), u8(s["done"].cast("int")))),),
        "event": lambda: (text(b["when"]), text(b["where"]), text(b["who"])),
    }
    return F.concat(u8(F.lit(KINDS.index(kind))), *fields[kind]())


def record_bytes(kind: str, body: Column) -> Column:
    """Of a row with id, name, paths, sources, produced_by, grants, face, and this kind's body struct."""
    return F.concat(
        text(F.col("id")),
        u8(F.lit(KINDS.index(kind))),
        text(F.col("name")),
        listing(F.col("paths"), text),
        listing(F.col("sources"), tagged(SOURCE_TAGS)),
        text(F.col("produced_by.agent_id")),
        text(F.col("produced_by.activity_id")),
        listing(F.col("grants"), tagged(GRANT_TAGS)),
        ordinal(F.col("face"), FACES),
        body_bytes(kind, body),
    )


def any_record_bytes(kinds: tuple[str, ...] = KINDS) -> Column:
    """record_bytes of rows of several kinds, with a body struct of a struct for each kind."""
    out = F.lit(None).cast("binary")
    for kind in kinds:
        out = F.when(F.col("kind") == kind, record_bytes(kind, F.col("body")[kind])).otherwise(out)
    return out


def framed(payload: Column) -> Column:
    return F.concat(F.lit(FRAME_MAGIC).cast("binary"), le32(F.lit(FRAME_REVISION)), le32(F.octet_length(payload)), payload)


def digest(payload: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(payload, 256))


#: Fixed value of the format: what says that a frame holds a record and its evidence.
WITH_EVIDENCE = 11


def evidence_bytes(deed_id: Column, produced_by: Column, grants: Column, unix_time: Column, signature: Column) -> Column:
    """Evidence on its own; signature: bytes."""
    return F.concat(
        text(deed_id),
        text(produced_by["agent_id"]),
        text(produced_by["activity_id"]),
        listing(grants, tagged(GRANT_TAGS)),
        le64(unix_time),
        le32(F.octet_length(signature)),
        signature,
    )


def evidence_file(payload: Column, evidence: Column) -> Column:
    """The file kept beside a record: a frame with the record's bytes and its evidence."""
    return framed(F.concat(u8(F.lit(WITH_EVIDENCE)), payload, evidence))
