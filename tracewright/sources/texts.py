"""Small texts that travel with records: receipts, heads, bridges, policies."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECEIPT_KEYS = ("id", "digest", "time", "index", "size", "root")
HASH = re.compile(r"[0-9a-f]{64}")


def receipt_text(receipts: DataFrame) -> DataFrame:
    """id, text: a line key=value for each field, and a line path= for each step."""
    line = lambda k, c: F.concat(F.lit(f"{k}="), F.col(c).cast("string"), F.lit("\n"))
    fields = [line(k, c) for k, c in zip(RECEIPT_KEYS, ("id", "digest", "unix_time", "idx", "size", "root"), strict=True)]
    steps = F.array_join(F.transform("path", lambda p: F.concat(F.lit("path="), p, F.lit("\n"))), "")
    return receipts.select("id", F.concat(*fields, steps).alias("text"))


def read_receipts(texts: DataFrame) -> DataFrame:
    """id, digest, unix_time, idx, size, root, path, fault of rows with text. Every key once, no other; path may repeat."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    key = lambda x: F.substring_index(x, "=", 1)
    value = lambda x: F.regexp_extract(x, r"\A[^=]*=(.*)\z", 1)
    of = lambda k: F.get(F.transform(F.filter(lines, lambda x: key(x) == k), value), F.lit(0))
    count = lambda k: F.size(F.filter(lines, lambda x: key(x) == k))
    path = F.transform(F.filter(lines, lambda x: key(x) == "path"), value)
    known = F.array(*map(F.lit, (*RECEIPT_KEYS, "path")))
    fault = F.when(F.exists(lines, lambda x: ~F.array_contains(known, key(x))), "unknown key")
    for k in RECEIPT_KEYS:
        fault = fault.when(count(k) != 1, f"{k} is not there once")
    fault = fault.when(F.exists(path, lambda p: ~p.rlike(r"\A[0-9a-f]{64}\z")), "path").when(~of("root").rlike(r"\A[0-9a-f]{64}\z"), "root")
    number = lambda k: of(k).try_cast("long")
    fault = fault.when(number("time").isNull() | number("index").isNull() | number("size").isNull(), "number")
    return texts.select(of("id").alias("id"), of("digest").alias("digest"), number("time").alias("unix_time"), number("index").alias("idx"), number("size").alias("size"), of("root").alias("root"), path.alias("path"), fault.alias("fault"))


def log_line(id_: Column, digest: Column, unix_time: Column) -> Column:
    return F.concat_ws("\t", id_, digest, unix_time.cast("string"))


def read_log(lines: DataFrame) -> DataFrame:
    """id, digest, unix_time of rows with value; blank lines are skipped, a bad one fails the scan."""
    parts = F.split("value", "\t")
    time = F.get(parts, F.lit(2)).try_cast("long")
    good = (F.size(parts) == 3) & time.isNotNull() & (time >= 0)
    checked = F.when(good, time).otherwise(F.raise_error(F.concat(F.lit("log line: "), F.col("value"))).cast("long"))
    return lines.where("trim(value) <> ''").select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("digest"), checked.alias("unix_time"))


def kept_head(text: str) -> tuple[int, str]:
    """size, root of any text that names them; the last of each counts. A bridge isn't a head."""
    if any(line.startswith("from=") for line in text.splitlines()):
        raise ValueError("a bridge, not a head")
    size = re.findall(r"(?:^|\s)size=(\S+)", text)
    root = re.findall(r"(?:^|\s)root=(\S+)", text)
    if not size or not root or not HASH.fullmatch(root[-1]):
        raise ValueError("no head")
    return int(size[-1]), root[-1]


def bridge_text(old: tuple[int, str], new: tuple[int, str], path: list[str]) -> str:
    return "".join([f"from={old[0]} {old[1]}\n", f"to={new[0]} {new[1]}\n", *(f"path={p}\n" for p in path)])


def read_bridge(text: str) -> tuple[tuple[int, str], tuple[int, str], list[str]]:
    ends: dict[str, tuple[int, str]] = {}
    path = []
    for line in filter(None, text.splitlines()):
        key, _, value = line.partition("=")
        if key == "path" and HASH.fullmatch(value):
            path.append(value)
        elif key in ("from", "to") and key not in ends and len(parts := value.split(" ")) == 2 and HASH.fullmatch(parts[1]):
            ends[key] = (int(parts[0]), parts[1])
        else:
            raise ValueError(f"bridge line: {line}")
    if len(ends) < 2:
        raise ValueError("a bridge names two heads")
    return ends["from"], ends["to"], path


@dataclass
class Policy:
    """What a store asks of attestations."""

    required: bool = False
    signers: list[bytes] = field(default_factory=list)

    @classmethod
    def read(cls, text: str) -> Policy:
        """Lines attestation=optional|required and signer=<64 hex>; # starts a comment; other keys are ignored."""
        out = cls()
        for line in text.splitlines():
            key, _, value = line.partition("#")[0].strip().partition("=")
            key, value = key.strip(), value.strip()
            if key == "attestation":
                if value not in ("optional", "required"):
                    raise ValueError(f"attestation: {value}")
                out.required = value == "required"
            elif key == "signer":
                if not HASH.fullmatch(value):
                    raise ValueError(f"signer: {value}")
                out.signers.append(bytes.fromhex(value))
        return out
