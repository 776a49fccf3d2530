"""Placement, manifest checks, canonical hashes, triage and scope rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers, hashes and relative POSIX paths of a manifest.
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
SHA_PATTERN = r"^[0-9a-f]{64}$"


def hash_mod(key: Column, n: Column) -> Column:
    """sha256(key) as a 256-bit number modulo n, folded over the hex digits."""
    digits = F.split(F.sha2(key, 256), "")
    value = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(value, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % n)


def canonical_json(names: list[str]) -> Column:
    """A JSON object with its keys in order and no spaces; nulls are kept as null."""

    def value(name: str) -> Column:
        wrapped = F.to_json(F.struct(F.col(name).alias("v")))
        return F.when(F.col(name).isNull(), F.lit("null")).otherwise(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))

    fields = [F.concat(F.lit(f'"{name}":'), value(name)) for name in sorted(names)]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    every = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, name in rules])
    return F.filter(every, lambda x: x.isNotNull())


def job_reasons(asset_id: Column, path: Column, sha: Column, size: Column) -> Column:
    """Why a manifest row is rejected; empty if it isn't."""
    parts = F.split(path, "/")
    return reasons(
        (asset_id.isNull() | ~asset_id.rlike(ID_PATTERN), "bad_asset_id"),
        (path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | F.exists(parts, lambda p: p.isin("", ".", "..")), "bad_relative_path"),
        (sha.isNull() | ~sha.rlike(SHA_PATTERN), "bad_sha256"),
        (size.isNull() | (size <= 0), "bad_size"),
    )


def scope(core: Column, core_context: Column, neighbour: Column, neighbour_context: Column, background: Column) -> Column:
    """Where a candidate lies, from the label shares of its box and its context."""
    return (
        F.when((core == 1) & (core_context == 1), "interior")
        .when((core > 0) | (core_context > 0), "boundary")
        .when((neighbour > 0) | (neighbour_context > 0), "neighbour")
        .when(background == 1, "background")
        .otherwise("unresolved")
    )


SCOPES = ("interior", "boundary", "neighbour", "background", "unresolved")
