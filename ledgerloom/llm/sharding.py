"""Sharding by fixed virtual slots.

Every record hashes, by id and text, into one of a fixed number of slots. Bytes are summed per slot, and a versioned
map, a stored table, says which shard holds which slot. Rebalancing starts from the latest stored version and edits it:
it moves single slots from the largest shard to the smallest until sizes are near equal, so a new version
differs from the last in a few slots only. Rows are placed by joining the stored version, one row for
each slot. Everything on the data path is DataFrame operations; the driver sees one number per slot.

Defined results: a null text has no bytes, so size 1 and the checksum of nothing; a null or repeated id is spread by
its texts, and rows equal in both share a virtual slot, which no map can split; each row gets a place of its own; an
empty table gives no rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.shared import materialize, path_exists, shared_path

#: Slots of the map; far more than shards, few enough for the driver.
SLOTS = 4096
#: Parts of a slot in which rows are numbered, so that a hot slot is spread over tasks.
PARTS = 16


def virtual_slot(*key: str, slots: int = SLOTS) -> Column:
    """The fixed slot of a key."""
    return F.pmod(F.xxhash64(*key, F.lit("slot")), F.lit(slots)).cast("int")


def initial_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt in turn."""
    return [slot % shards for slot in range(slots)]


def rebalance(current: list[int], sizes: dict[int, int], shards: int, tolerance: float = 0.0005) -> list[int]:
    """Edit a map until the largest and smallest shard differ by at most ``tolerance`` of the mean.

    Each step moves the slot, or swaps the pair of slots, that halves the gap between the largest and the
    smallest shard best. It stops when no step narrows the gap. Sizes are integers and ties go to the
    smaller slot, so reruns agree.
    """
    import bisect

    out = list(current)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    total = [0] * shards
    for slot, shard in enumerate(out):
        size = int(sizes.get(slot, 0))
        total[shard] += size
        bisect.insort(held[shard], (size, slot))
    mean = sum(total) / shards
    for _ in range(64 * len(out)):
        high = max(range(shards), key=lambda s: (total[s], -s))
        low = min(range(shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        if gap <= max(1, tolerance * mean):
            break
        best: tuple[int, tuple[int, int], tuple[int, int] | None] | None = None
        small = [None, *held[low]]
        for back in small if len(small) <= 256 else small[:: len(small) // 256]:
            want = gap // 2 + (back[0] if back else 0)
            at = bisect.bisect_left(held[high], (want, -1))
            for item in held[high][max(0, at - 1) : at + 1]:
                moved = item[0] - (back[0] if back else 0)
                left = abs(gap - 2 * moved)
                if moved > 0 and left < gap and (best is None or left < best[0]):
                    best = (left, item, back)
        if best is None:
            break
        _, item, back = best
        held[high].remove(item)
        bisect.insort(held[low], item)
        out[item[1]] = low
        if back:
            held[low].remove(back)
            bisect.insort(held[high], back)
            out[back[1]] = high
        moved = item[0] - (back[0] if back else 0)
        total[high] -= moved
        total[low] += moved
    return out


def grow(current: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """A map for one more shard: slots move only from old shards into the new one, each giving its share."""
    out = list(current)
    for shard in range(shards):
        own = sorted((s for s, at in enumerate(out) if at == shard), key=lambda s: (-int(sizes.get(s, 0)), s))
        give = sum(int(sizes.get(s, 0)) for s in own) / (shards + 1)
        for slot in own:
            if 0 < int(sizes.get(slot, 0)) <= give:
                out[slot] = shards
                give -= int(sizes.get(slot, 0))
    return out


def store_map(spark: SparkSession, mapping: list[int], version: int, path: str) -> None:
    """Add a version of a map to its table: (slot, shard) under version=N."""
    listed = F.split(F.lit(",".join(map(str, mapping))), ",")
    slots = spark.range(0, len(mapping), 1, 1).select(F.col("id").cast("int").alias("slot"))
    rows = slots.select("slot", F.element_at(listed, F.col("slot") + 1).cast("int").alias("shard"))
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a map: (slot, shard, version)."""
    return spark.read.schema("slot int, shard int, version int").parquet(path)


def latest_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """Number and content of the latest version; None if there is none."""
    if not path_exists(spark, path):
        return None
    table = stored_map(spark, path)
    version = table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == version).collect()  # one row per slot
    return version, [r.shard for r in sorted(rows, key=lambda r: r.slot)]


def shard_documents(
    docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None
) -> DataFrame:
    """Place every row in a shard, with sizes near equal, and number the rows of each shard.

    ``map_path``: the stored map to start from, and to add a version to where sizes ask for it; a new one if left out.
    Returns the id, size, text_crc32, virtual_slot, map_version, shard and slot (the row's place in its
    shard, from 0 without gaps).
    """
    spark = docs.sparkSession
    path = map_path or shared_path(spark, "slot-map")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumns(
        {
            "virtual_slot": virtual_slot("doc_id", "text_crc32", "size", slots=slots),
            "part": F.pmod(F.hash("text_crc32", "doc_id", F.lit("part")), F.lit(PARTS)),
        }
    )
    rows = materialize(rows, "shard-sizes")
    cells = rows.groupBy("virtual_slot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    per_slot = cells.groupBy("virtual_slot").agg(F.sum("bytes").alias("bytes")).collect()  # one row per slot at most
    known = latest_map(spark, path)
    if known is None:
        known = 0, initial_map(shards, slots)
        store_map(spark, known[1], 0, path)
    version, current = known
    if len(current) != slots or max(current) >= shards:
        raise ValueError(f"the map at {path} has {len(current)} slots and {max(current) + 1} shards, not {slots} and at most {shards}")
    mapping = rebalance(current, {r.virtual_slot: r.bytes for r in per_slot}, shards)
    if mapping != current:
        version += 1
        store_map(spark, mapping, version, path)

    placed = stored_map(spark, path).filter(F.col("version") == version).select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(F.broadcast(placed), "virtual_slot").select(  # a row per slot
        "virtual_slot", "part", "shard", "map_version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")
    )
    place = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(place) - 1)
        .join(starts, ["virtual_slot", "part"])
        .select("doc_id", "size", "text_crc32", "virtual_slot", "map_version", "shard", (F.col("place") + F.col("begin")).cast("long").alias("slot"))
    )
