"""Ids, keys and encodings as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier names in order of strength.
KEY_NAMES = ("REGISTRY_ENTITY_ID", "LEI", "SOURCE_ENTITY_ID", "NAME_COUNTRY")


def stable_id(prefix: str, *parts: Column, width: int = 12) -> Column:
    """``prefix_`` and the first hex digits of the SHA-1 of the parts joined by ``||``; a null part is blank.

    Numbers that may be zero go through :func:`blank_if_falsy` first.
    """
    joined = F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined), 1, width))


def blank_if_falsy(number: Column) -> Column:
    """A number or boolean as the text that ids are made of: zero and false count as blank, like null."""
    return F.when(number.cast("double") == 0, F.lit("")).otherwise(number.cast("string"))


def join_non_blank(separator: str, *parts: Column) -> Column:
    """Parts joined, without those that are null or blank."""
    return F.trim(F.concat_ws(separator, *[F.nullif(p, F.lit("")) for p in parts]))


def snapshot_label(seq: Column) -> Column:
    return F.format_string("SNAPSHOT_%03d", seq)


def key_variants(registry_id: Column, lei: Column, source_id: Column, normalized_name: Column, country: Column) -> Column:
    """Array of (prio, key_name, key_value): the non-blank identifiers by strength, then always name and country."""
    values = (registry_id, lei, source_id, F.concat_ws("|", F.coalesce(normalized_name, F.lit("")), F.coalesce(country, F.lit(""))))
    every = F.array(
        *[
            F.struct(F.lit(i).alias("prio"), F.lit(name).alias("key_name"), F.coalesce(value, F.lit("")).alias("key_value"))
            for i, (name, value) in enumerate(zip(KEY_NAMES, values, strict=True))
        ]
    )
    return F.filter(every, lambda v: (v["key_value"] != "") | (v["key_name"] == KEY_NAMES[-1]))


def strongest_key(variants: Column) -> Column:
    """``NAME:VALUE`` of the first variant."""
    return F.concat_ws(":", F.element_at(variants, 1)["key_name"], F.element_at(variants, 1)["key_value"])


def observation_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def encode_by_map(value: Column, codes: dict[str, int], default: int) -> Column:
    """Dictionary encoding with a default for the unknown."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))
