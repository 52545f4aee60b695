"""What follows from a record's own fields: ids, faces, paths, checks and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .encoding import KINDS

ID_PREFIX = "deed-"
ID_PATTERN = rf"\A{ID_PREFIX}({'|'.join(KINDS)})-[a-z0-9-]+\z"
ADDRESS_PATTERN = r"\Asha256:[0-9a-f]{64}\z"
#: Fixed values of the format: the fields of each kind's body, and those of them that are doubles.
BODY_FIELDS = {
    "file": ("path", "media_type"),
    "set": ("title", "members"),
    "quote": ("edition", "start", "end", "excerpt", "urls"),
    "patch": ("tree", "diffs", "functionaries"),
    "mailDraft": ("message_id", "in_reply_to", "subject", "path"),
    "clip": ("sources", "in_point", "out_point", "duration", "path"),
    "page": ("url", "snapshot"),
    "form": ("blank", "fields", "path"),
    "table": ("measures",),
    "procedure": ("steps",),
    "event": ("when", "where", "who"),
}
NUMBERS = ("in_point", "out_point", "duration")
BLANK_ENDS = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, BLANK_ENDS, "")


def blank(c: Column) -> Column:
    return F.coalesce(trimmed(c) == "", F.lit(True))


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def slug(name: Column) -> Column:
    """Letters and digits in lower case; blanks, hyphens and underscores as single hyphens, none at the ends."""
    kept = F.lower(F.regexp_replace(name, "[^A-Za-z0-9 _-]", ""))
    made = F.regexp_replace(F.regexp_replace(kept, "[ _-]+", "-"), "^-|-$", "")
    return F.when(made == "", "item").otherwise(made)


def mint_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit(ID_PREFIX), kind, F.lit("-"), slug(name))


def is_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID_PATTERN), F.lit(False))


def is_address(c: Column) -> Column:
    """A product's write-once address."""
    return F.coalesce(c.rlike(ADDRESS_PATTERN), F.lit(False))


def is_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A(https?|file)://") & (F.octet_length(c) >= 8), F.lit(False))


def message_id(c: Column) -> Column:
    """<local@domain> without doubt about it; null if it isn't one."""
    bare = trimmed(c)
    inner = F.regexp_replace(bare, r"\A<(.*)>\z", "$1")
    local, domain = F.substring_index(inner, "@", 1), F.regexp_extract(inner, r"\A[^@]*@(.*)\z", 1)
    good = inner.contains("@") & (local != "") & (domain != "") & ~inner.rlike(r"(?U)\s") & (domain.contains(".") | (domain == "localhost"))
    return F.when(good, F.concat(F.lit("<"), local, F.lit("@"), domain, F.lit(">")))


def face_of_media(media: Column) -> Column:
    """How a file is looked at. The first rule that fits decides."""
    m = F.lower(trimmed(F.coalesce(media, F.lit(""))))
    return (
        F.when(m.rlike(r"\A(audio|video)/"), "waveform")
        .when(m.isin("message/rfc822", "message/rfc2822"), "letter")
        .when(m.startswith("image/") | (m == "application/pdf"), "document")
        .when(m.startswith("text/") | m.contains("source") | m.isin("application/javascript", "application/json", "application/x-rust") | m.endswith("+xml"), "syntax")
        .otherwise("document")
    )


def face(kind: Column, media: Column) -> Column:
    by_kind = F.when(kind == "set", "sheet").when(kind == "clip", "waveform").when(kind == "mailDraft", "letter").when(kind == "patch", "syntax")
    return by_kind.when(kind == "file", face_of_media(media)).otherwise("document")


def paths(kind: Column, body: Column) -> Column:
    """Product addresses that a record exposes."""
    none = F.array().cast("array<string>")
    return (
        F.when(kind.isin("file"), F.array(body["file"]["path"]))
        .when(kind == "set", body["set"]["members"])
        .when(kind == "patch", body["patch"]["diffs"])
        .when(kind == "mailDraft", F.array(body["mailDraft"]["path"]))
        .when(kind == "clip", F.concat(body["clip"]["sources"], F.array(body["clip"]["path"])))
        .when(kind == "page", F.array(body["page"]["snapshot"]))
        .when(kind == "form", F.array(body["form"]["path"]))
        .otherwise(none)
    )


def _first(*rules: tuple[Column, str]) -> Column:
    out = None
    for bad, why in rules:
        out = F.when(bad, why) if out is None else out.when(bad, why)
    return out


def _none(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) <= 0


def fault(kind: Column, body: Column) -> Column:
    """Why a body is refused, by the first rule of its kind that it breaks; null if it is good."""
    q, c = body["quote"], body["clip"]
    rules = {
        "file": _first((empty(body["file"]["path"]), "file: path is empty")),
        "set": _first(
            (blank(body["set"]["title"]), "set: title is blank"),
            (_none(body["set"]["members"]), "set: no members"),
            (F.exists(body["set"]["members"], empty), "set: a member is empty"),
        ),
        "quote": _first(
            (blank(q["edition"]), "quote: edition is blank"),
            (blank(q["excerpt"]), "quote: excerpt is blank"),
            (_none(q["urls"]), "quote: no urls"),
            (q["start"] > q["end"], "quote: start is after end"),
            (F.exists(q["urls"], lambda u: ~is_url(u)), "quote: a url is not one"),
        ),
        "patch": _first(
            (blank(body["patch"]["tree"]), "patch: tree is blank"),
            (_none(body["patch"]["diffs"]), "patch: no diffs"),
            (_none(body["patch"]["functionaries"]), "patch: no functionaries"),
        ),
        "mailDraft": _first((blank(body["mailDraft"]["subject"]), "mailDraft: subject is blank"), (empty(body["mailDraft"]["path"]), "mailDraft: path is empty")),
        # A number that is not one passes both comparisons; Spark puts NaN above all, so it is asked for.
        "clip": _first(
            (_none(c["sources"]), "clip: no sources"),
            (empty(c["path"]), "clip: path is empty"),
            ((c["out_point"] < c["in_point"]) & ~F.isnan(c["in_point"]), "clip: out is before in"),
            (c["duration"] < 0, "clip: duration is negative"),
        ),
        "page": _first((~is_url(body["page"]["url"]), "page: url is not one"), (empty(body["page"]["snapshot"]), "page: snapshot is empty")),
        "form": _first(
            (blank(body["form"]["blank"]), "form: blank is blank"),
            (_none(body["form"]["fields"]), "form: no fields"),
            (empty(body["form"]["path"]), "form: path is empty"),
        ),
        "table": _first((_none(body["table"]["measures"]), "table: no measures")),
        "procedure": _first((_none(body["procedure"]["steps"]), "procedure: no steps")),
        "event": _first(
            (blank(body["event"]["when"]), "event: when is blank"),
            (blank(body["event"]["where"]), "event: where is blank"),
            (blank(body["event"]["who"]), "event: who is blank"),
        ),
    }
    out = F.lit(None).cast("string")
    for name, rule in rules.items():
        out = F.when(kind == name, rule).otherwise(out)
    return out


def with_quoted_urls(sources: Column, urls: Column) -> Column:
    """sources, then a quote's urls that are not among them yet, each once."""
    named = F.transform(F.array_distinct(urls), lambda u: F.struct(F.lit("url").alias("tag"), u.alias("value")))
    return F.concat(sources, F.filter(named, lambda s: ~F.array_contains(sources, s)))


def label(kind: Column, name: Column) -> Column:
    return F.concat_ws(" · ", kind, name)


def tag_texts(items: Column) -> Column:
    return F.transform(items, lambda s: F.concat(s["tag"], F.lit(":"), s["value"]))


@F.pandas_udf(StringType())
def _shortest(x: pd.Series) -> pd.Series:
    names = {"nan": "NaN", "inf": "inf", "-inf": "-inf"}
    return pd.Series([names.get(str(v)) or np.format_float_positional(v, trim="-") for v in x], dtype="object")


def plain_number(x: Column) -> Column:
    """A double in as few digits as tell it from all others, without an exponent or a point that nothing follows."""
    return F.when(x.isNotNull(), _shortest(x))


def body_json(kind: Column, body: Column) -> Column:
    """A record's body as JSON: an object that names the kind, and in it the kind's fields by name; what is absent is null.

    A number that JSON lacks (not a number, infinite) is null. The field `where` is told as `where_`.
    """
    out = F.lit(None).cast("string")
    for k, fields in BODY_FIELDS.items():
        told = [_json_value(body[k][f], f).alias("where_" if f == "where" else f) for f in sorted(fields)]
        out = F.when(kind == k, F.to_json(F.struct(F.struct(*told).alias(k)), {"ignoreNullFields": "false"})).otherwise(out)
    return out


def _json_value(value: Column, field: str) -> Column:
    return F.when(F.abs(value) < float("inf"), value) if field in NUMBERS else value
