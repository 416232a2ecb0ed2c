"""Column builders shared by all operators."""

from ledgerloom.functions.columns import (
    blank_if_falsy,
    encode_by_map,
    join_non_blank,
    key_variants,
    observation_key,
    snapshot_label,
    stable_id,
    strongest_key,
)
from ledgerloom.functions.text import normalize_name, normalize_text

__all__ = [
    "blank_if_falsy",
    "encode_by_map",
    "join_non_blank",
    "key_variants",
    "normalize_name",
    "normalize_text",
    "observation_key",
    "snapshot_label",
    "stable_id",
    "strongest_key",
]
