"""Sharding through fixed virtual slots and a versioned slot-to-shard map (operator 4).

Rows hash into a fixed number of virtual slots that never changes. What a slot holds (bytes,
rows) is one grouped sum; shards own slots, and only the map from slots to shards is edited when
shards are added, taken away or out of balance. The map has one row a slot and version, so it is
small whatever the rows: planning it is arithmetic over a few thousand rows.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import stored

SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long"


def virtual_slot(id_column, checksum, size, slots=SLOTS):
    """The slot of a row, from md5 of its id (NULL: an empty string), checksum and size, so that rows of one id spread by their texts."""
    digest = F.md5(F.concat_ws("|", F.coalesce(id_column.cast("string"), F.lit("")), checksum.cast("string"), size.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % slots).cast("int")


def record_size(text):
    """UTF-8 bytes of the text (NULL: none) plus 16 of header."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def slotted(docs: DataFrame, slots=SLOTS) -> DataFrame:
    """Stored: doc_id, size, text_crc32, virtual_slot and ``deal``, a number that tells equal rows apart."""
    sized = docs.select("doc_id", record_size(F.col("text")).alias("size"), F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long").alias("text_crc32"))
    slot = virtual_slot(F.col("doc_id"), F.col("text_crc32"), F.col("size"), slots)
    return stored(sized.select("*", slot.alias("virtual_slot"), F.xxhash64(F.monotonically_increasing_id()).alias("deal")), "slot-rows")


def slot_loads(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot that holds a row: one row a slot."""
    return [tuple(r) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).orderBy("virtual_slot").collect()]


def split_heavy(rows: DataFrame, loads, shards: int, slots=SLOTS) -> DataFrame:
    """``rows`` with heavy slots split: rows that are equal in id, text and size are dealt out.

    A slot with more than an eighth of a shard's share is dealt into as many parts as bring each
    below that; part p of slot s is slot s + (p + 1) * slots. There are fewer than eight such slots a shard.
    """
    most = max(1.0, sum(b for _, b, _ in loads) / shards / 8)
    heavy = [(slot, min(n, -int(-b // most))) for slot, b, n in loads if b > most and n > 1]
    if not heavy:
        return rows
    parts = F.broadcast(rows.sparkSession.createDataFrame(heavy, "heavy int, parts int"))
    part = F.pmod("deal", F.col("parts").cast("long")).cast("int")
    return rows.join(parts, F.col("virtual_slot") == F.col("heavy"), "left").withColumn("virtual_slot", F.coalesce(F.col("virtual_slot") + (part + 1) * slots, "virtual_slot")).drop("heavy", "parts")


def first_map(loads, shards: int) -> list[tuple]:
    """Version 1: the heaviest slot first, always to the shard with the fewest bytes."""
    filled, owner = [0] * shards, {}
    for slot, size, _ in sorted(loads, key=lambda x: (-x[1], x[0])):
        shard = min(range(shards), key=lambda s: (filled[s], s))
        owner[slot], filled[shard] = shard, filled[shard] + size
    return [(1, slot, owner[slot], size, rows) for slot, size, rows in loads]


def rebalanced(rows: list[tuple], loads, shards: int, slack=0.01) -> list[tuple]:
    """The next version: slots move only from shards above the mean to shards below it.

    ``rows`` is the newest version of the map; ``loads`` may have changed since. Slots of shards
    that no longer exist, and slots that are new, go first to the emptiest shards; then the
    fullest shard gives the slot that fits the gap best, until none is over the mean by more
    than ``slack`` or no move helps.
    """
    version = max((r[0] for r in rows), default=0) + 1
    known = {r[1]: r[2] for r in rows}
    size = {slot: b for slot, b, _ in loads}
    filled, held = [0] * shards, [set() for _ in range(shards)]
    owner = {s: known[s] for s in size if known.get(s, shards) < shards}
    for slot, shard in owner.items():
        filled[shard] += size[slot]
        held[shard].add(slot)

    def put(slot, shard):
        owner[slot] = shard
        filled[shard] += size[slot]
        held[shard].add(slot)

    for slot in sorted(size.keys() - owner.keys(), key=lambda s: (-size[s], s)):
        put(slot, min(range(shards), key=lambda s: (filled[s], s)))
    mean = sum(size.values()) / max(1, shards)
    for _ in range(len(size)):
        full = max(range(shards), key=lambda s: (filled[s], -s))
        low = min(range(shards), key=lambda s: (filled[s], s))
        gap = min(filled[full] - mean, mean - filled[low])
        fitting = [s for s in held[full] if 0 < size[s] < filled[full] - filled[low]]
        if filled[full] <= mean * (1 + slack) or not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(size[s] - gap), s))
        held[full].discard(slot)
        filled[full] -= size[slot]
        put(slot, low)
    return [(version, slot, owner[slot], b, n) for slot, b, n in loads]


def map_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A map version as a table; write it in append mode to keep every version."""
    return spark.createDataFrame(rows, MAP_SCHEMA)


def newest(maps: DataFrame) -> DataFrame:
    """The newest version in a table of versions."""
    top = maps.agg(F.max("version").alias("top"))
    return maps.join(top, F.col("version") == F.col("top")).drop("top")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Per row of ``rows`` (:func:`slotted`, heavy slots split): doc_id, size, text_crc32, virtual_slot, shard, slot.

    ``slot`` is the row's place in its shard, without gaps from 0: the rows of the shard's
    earlier virtual slots (a running sum over the map) plus the place within its own virtual
    slot. So places come from thousands of small sorts, not from one a shard.
    """
    order = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(order), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    # the map has one row a slot, fixed slots and parts of heavy ones: a proven bound
    return rows.withColumn("place", place).join(F.broadcast(offsets), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int, slots=SLOTS) -> tuple[DataFrame, DataFrame]:
    """Rows with their shards, and the stored map (version 1) that put them there.

    Law ``bytes``: shards hold nearly equal bytes, also where ids are NULL or repeat, or rows are
    equal in all. A NULL text has no bytes (size 16, checksum 0). Other columns are not looked at,
    whatever their names; long texts are only measured. An empty table gives an empty table.
    """
    rows = slotted(docs, slots)
    rows = split_heavy(rows, slot_loads(rows), shards, slots)
    slot_map = stored(map_table(docs.sparkSession, first_map(slot_loads(rows), shards)), "slot-map")
    return assign(rows, slot_map), slot_map
