"""Canonical JSON and the hashes made of it, on the driver and inside plans."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: object) -> str:
    """JSON with sorted keys and without spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def digest_column(payload: Column) -> Column:
    """SHA-256 of a struct's JSON; equal to ``digest`` if its fields are in alphabetical order."""
    return F.sha2(F.to_json(payload), 256)


def component_id(sources: Column, targets: Column) -> Column:
    """A stable name for a component of an identity graph, from its sorted keys on both sides."""
    return F.concat(F.lit("identity-"), F.substring(digest_column(F.struct(sources.alias("source"), targets.alias("target"))), 1, 12))


def masked(value: object, mode: str) -> object:
    """A sensitive value as evidence may show it."""
    if value is None or mode == "plain":
        return value
    if mode == "hash":
        return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()
    return "[omitted]" if mode == "omit" else "***"


def masked_column(c: Column, mode: str) -> Column:
    """``masked`` for string columns, inside a plan."""
    if mode == "plain":
        return c
    shown = F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(c.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(c.cast("string")))) - 2), 256)) if mode == "hash" else F.lit("[omitted]" if mode == "omit" else "***")
    return F.when(c.isNotNull(), shown)
