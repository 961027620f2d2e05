"""N-gram Jaccard join by rare-first prefix filtering (operator 6).

A document is the set of its word 5-grams. Equal sets are one class; classes are joined. In any
order of the grams that all sets share, two sets of Jaccard similarity t or more have a gram in
common among the first n - ceil(t n) + 1 of each. The order is rare first: grams by how often
their bucket of a counting sketch over all documents was met, then by hash, so passages that
many documents share stand last and are in no prefix unless a document consists of them.

Every prefix gram that at least two classes have is an entry of an inverted list. Entries pass
the length filter (sizes within t), the positional filter (what is left behind the two places can
still reach the overlap) and, per pair, the suffix filter (a split of both remainders at a pivot
bounds the overlap) before sets are compared.

Near copies of one text are thousands that all resemble each other. The order is one for all sets,
so lists with the same members are met by each of them in the same order, and the first of them
stands for the rest. Then each list links its members to one hub: the member that meets the gram
first, which of near copies is the one that was changed least. Classes so linked are one component;
what is left are pairs across components of one list. The filters are asked of all of them as they
are met, so few are left to verify, and every one of these is verified: first by bitmaps of both
sets, which bound the overlap from above, then by the sets, which move for the pairs that are left
alone. No link between components is lost, while pairs inside one need no comparison.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components, union
from .shared import WordHashes, arrow_pass, free_names, gram_sets, release, shuffles_cleaned, stored

GRAM = 5
#: Similarity as a fraction of integers: 75 of 100.
OVER, UNDER = 75, 100
#: Buckets of the sketch (4 bytes each, sent to every executor), whatever the input.
SKETCH_BITS = 22
#: Cells of the bitmap for each prefix gram, and its most bits (32 MB); beyond them it lets more
#: through, and the result is the same. Tasks add sketch and bitmap up in pieces.
CELLS, MOST_BITS, PIECES = 8, 28, 64
#: Documents hashed at a time, and bytes kept of a gram in prefixes and sets.
BATCH, GRAM_BYTES = 512, 6
#: Bits of the bitmaps that thin out documents read for their sets, and of that of the lists that stay.
SLOT_BITS, CHOSEN_BITS = 23, 26

_WORDS = WordHashes()


def set_key(grams: np.ndarray) -> int:
    """A signed 64-bit digest of a set. Among a billion distinct sets two agree with a chance under 3 %."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1


def buckets(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def rare_order(grams: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    # grams come in ascending order, so a stable sort by count breaks ties by hash
    return grams[np.argsort(sketch[buckets(grams)], kind="stable")]


def batches_of(column):
    """A column's texts, a few at a time, so that a large batch is not held twice."""
    for i in range(0, len(column), BATCH):
        yield column.slice(i, BATCH).to_pylist()


def in_pieces(array: np.ndarray) -> pa.RecordBatch:
    """A task's array as compressed pieces, to be added up piece by piece."""
    per = len(array) // PIECES
    packed = [zlib.compress(array[i * per:(i + 1) * per].tobytes(), 1) for i in range(PIECES)]
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(packed, pa.binary())], ["piece", "data"])


def added_up(parts: DataFrame, kind, fold, finish, out_kind) -> dict[int, np.ndarray]:
    """Pieces of all tasks, folded: an array of fixed size in all, which the driver receives."""
    def add(batches):
        held = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[piece] = fold(held.get(piece), np.frombuffer(zlib.decompress(data), kind))
        if held:
            packed = [zlib.compress(finish(x).tobytes(), 1) for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], ["piece", "data"])

    sums = arrow_pass(parts.repartition(PIECES, "piece"), add, "piece int, data binary").collect()
    return {piece: np.frombuffer(zlib.decompress(data), out_kind) for piece, data in sums}


def first_reading(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Stored rows (doc_id, n, class), and how many documents' grams fall into each bucket of the sketch.

    The sketch is 2^SKETCH_BITS counts, whatever the input. Tasks write rows and pieces of their
    counts side by side, so texts are read once for both.
    """
    names = ["piece", "data", "doc_id", "n", "class"]

    def scan(batches):
        total, some = np.zeros(1 << SKETCH_BITS, np.int64), False
        for batch in batches:
            ns, keys = [], []
            for texts in batches_of(batch.column(1)):
                sets = gram_sets(texts, _WORDS, GRAM)
                total += np.bincount(buckets(np.concatenate(sets)), minlength=len(total))
                ns += [len(own) for own in sets]
                keys += [set_key(own) if len(own) else None for own in sets]
            some = some or any(ns)
            nothing = pa.nulls(len(batch))
            yield pa.RecordBatch.from_arrays([nothing.cast(pa.int32()), nothing.cast(pa.binary()), batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.int64())], names)
        if some:
            pieces = in_pieces(np.minimum(total, 65535).astype(np.uint16))
            nothing = pa.nulls(len(pieces), pa.int64())
            yield pa.RecordBatch.from_arrays([*pieces.columns, nothing, nothing, nothing], names)

    read = arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), scan, "piece int, data binary, doc_id long, n long, class long")
    read = stored(read, "gram-rows")
    pieces = added_up(read.filter("piece is not null").select("piece", "data"), np.uint16, lambda held, x: x.astype(np.int64) if held is None else held + x, lambda x: np.minimum(x, 2 ** 31 - 1).astype(np.int32), np.int32)
    none = np.zeros((1 << SKETCH_BITS) // PIECES, np.int32)
    rows = read.filter("piece is null").select("doc_id", "n", "class")
    rows.stored_at = read.stored_at
    return rows, np.concatenate([pieces.get(i, none) for i in range(PIECES)])


def repeat_cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Cells of grams. Prefixes hold mostly low hashes (ties in rarity are in order of hash), so bits are mixed first."""
    return ((tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def packed_cells(cells: np.ndarray, again: np.ndarray) -> bytes:
    """Ascending cells and a flag of each. Gaps are laid out by byte, as their upper bytes are mostly zero."""
    gaps = np.diff(cells, prepend=0).astype("<u4")
    return np.array([len(cells)], "<u4").tobytes() + gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(again).tobytes()


def unpacked_cells(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = int(data[:4].view("<u4")[0])
    gaps = np.ascontiguousarray(data[4:4 + 4 * n].reshape(4, n).T).view("<u4").reshape(-1)
    return np.cumsum(gaps, dtype=np.int64), np.unpackbits(data[4 + 4 * n:], count=n).astype(bool)


def repeated_cells(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the cells that two or more prefix grams fall into, and the bits of a cell's number.

    A gram alone in its cell is in no list of two, so it need not be shuffled; the bitmap lets
    through every gram that is not alone, and by chance some that are.
    """
    n = rows.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    n //= GRAM_BYTES
    bits = min(MOST_BITS, max(12, (CELLS * n).bit_length()))
    per = (1 << bits) // PIECES

    def bitmap(cells):
        out = np.zeros(per // 8, np.uint8)
        np.add.at(out, cells >> 3, np.uint8(128) >> (cells & 7).astype(np.uint8))  # cells differ, so bits never carry
        return out

    def mark(batches):
        met = [repeat_cells(prefix_tokens(batch.column(0)), bits).astype(np.uint32) for batch in batches]
        if sum(map(len, met)):
            cells, counts = np.unique(np.concatenate(met), return_counts=True)
            cells, ends = cells.astype(np.int64), np.searchsorted(cells, np.arange(PIECES + 1) * per)
            data = []
            for i in range(PIECES):
                data.append(zlib.compress(packed_cells(cells[ends[i]:ends[i + 1]] - i * per, counts[ends[i]:ends[i + 1]] > 1), 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(data, pa.binary())], ["piece", "data"])

    def fold(held, x):
        cells, again = unpacked_cells(x)
        once, twice = bitmap(cells), bitmap(cells[again])
        return (once, twice) if held is None else (held[0] | once, held[1] | twice | (held[0] & once))

    parts = arrow_pass(rows.filter("prefix is not null").select("prefix"), mark, "piece int, data binary")
    pieces = added_up(parts, np.uint8, fold, lambda x: x[1], np.uint8)
    none = np.zeros(per // 8, np.uint8)
    return np.concatenate([pieces.get(i, none) for i in range(PIECES)]), bits


def slot_of(key, doc_id):
    """The bit of a (class, document) in a bitmap of 2^SLOT_BITS."""
    return key.bitwiseXOR(F.coalesce(doc_id, F.lit(-1))).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def bitmap_of(slots: DataFrame) -> np.ndarray:
    """Bits of the column ``slot``, as 64-bit words: a fixed size, whatever the input."""
    bits = slots.select(F.shiftright("slot", 6).alias("at"), (F.col("slot") % 64).cast("int").alias("bit"))
    out = np.zeros((1 << SLOT_BITS) // 64, np.int64)
    for at, word in bits.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).collect():  # 2^SLOT_BITS / 64 rows at most
        out[at] = word
    return out


def in_bitmap(held: np.ndarray, slot: int) -> int:
    return int(held[slot // 64]) >> (slot % 64) & 1


def with_prefixes(docs: DataFrame, sketch, copied, reps) -> DataFrame:
    """class, n, prefix (the first grams in rare order, packed) of each class.

    Bitmaps of the classes that several documents have, and of the (class, document) that stand for
    these, leave out other copies; a task also writes a class once. What a bitmap lets through by
    chance repeats a class, which later steps allow for.
    """
    def scan(batches):
        counts, seen, mask = sketch.value, set(), (1 << SLOT_BITS) - 1
        several, stands = copied.value, reps.value
        for batch in batches:
            ns, keys, prefixes = [], [], []
            for ids, texts in zip(batches_of(batch.column(0)), batches_of(batch.column(1))):
                for doc_id, grams in zip(ids, gram_sets(texts, _WORDS, GRAM)):
                    if not len(grams):
                        continue
                    key = set_key(grams)
                    if in_bitmap(several, key & mask) and not in_bitmap(stands, (key ^ (-1 if doc_id is None else doc_id)) & mask) or key in seen:
                        continue
                    seen.add(key)
                    ns.append(len(grams))
                    keys.append(key)
                    prefixes.append(packed_grams(rare_order(grams, counts)[:prefix_length(len(grams))]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.array(prefixes, pa.binary())], ["class", "n", "prefix"])

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), scan, "class long, n long, prefix binary")


def prefix_tokens(column) -> np.ndarray:
    """The grams of a column of prefixes, one after another. Two grams that agree in the bytes kept share a list, whose pairs are verified as any."""
    return unpacked_grams(b"".join(column.to_pylist())).view(np.int64)


def reach(n, m, place, other):
    """Length and positional filter for a gram at ``place`` of n and at ``other`` of m (from 0).

    A pair that meets the threshold passes at its first common gram, before which nothing is shared.
    """
    left = F.least(n - place, m - other)
    return (F.least(n, m) * UNDER >= F.greatest(n, m) * OVER) & (left * (OVER + UNDER) >= (n + m) * OVER)


def marked(tokens: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the cells that the tokens fall into."""
    bits = CHOSEN_BITS
    per = (1 << bits) // PIECES

    def mark(batches):
        out, some = np.zeros(1 << bits, bool), False
        for batch in batches:
            out[repeat_cells(np.asarray(batch.column(0)), bits)] = True
            some = some or len(batch) > 0
        if some:
            yield in_pieces(np.packbits(out))

    pieces = added_up(arrow_pass(tokens.select("token"), mark, "piece int, data binary"), np.uint8, lambda held, x: x if held is None else held | x, lambda x: x, np.uint8)
    none = np.zeros(per // 8, np.uint8)
    return np.concatenate([pieces.get(i, none) for i in range(PIECES)])


def tokens_in(rows: DataFrame, sent, bits: int) -> DataFrame:
    """token, class, n, place of the prefix grams whose cell is set in a bitmap."""
    def scan(batches):
        bitmap = sent.value
        for batch in batches:
            tokens = prefix_tokens(batch.column(2))
            lengths = np.asarray(pc.binary_length(batch.column(2))).astype(np.int64) // GRAM_BYTES
            cells = repeat_cells(tokens, bits)
            keep = (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            owner = np.repeat(np.arange(len(lengths)), lengths)[keep]
            ns, keys = np.asarray(batch.column(1)), np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep]), pa.array(keys[owner]), pa.array(ns[owner].astype(np.int32)), pa.array(place[keep].astype(np.int32))], ["token", "class", "n", "place"])

    return arrow_pass(rows.select("class", "n", "prefix"), scan, "token long, class long, n int, place int")


def entries(rows: DataFrame) -> DataFrame:
    """Stored: inverted lists of the prefix grams that at least two classes have (token, class, n, place, size), one of each set of members.

    Grams alone in their cell of the bitmap go first, without a shuffle. Lists are told apart by the
    number of their members and two sums of their digests, which do not depend on order and count a
    class that repeats as often in each of its lists; of equal lists the gram that comes first in
    its members' order stays, and the first gram that two sets share is never dropped for a later
    one. Only entries of the lists that stay are shuffled whole.
    """
    spark = rows.sparkSession
    found, bits = repeated_cells(rows)
    sent = spark.sparkContext.broadcast(found)
    part = lambda salt: F.sum(F.xxhash64(F.lit(salt), "class").bitwiseAND(F.lit((1 << 40) - 1))).alias(f"members_{salt}")
    per = tokens_in(rows, sent, bits).groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.sum("place").alias("places"), part(1), part(2)).filter("size > 1")
    chosen = stored(per.groupBy("size", "members_1", "members_2").agg(F.min_by("token", F.struct("places", "token")).alias("token")).select("token"), "gram-chosen")
    sent.destroy()
    kept = spark.sparkContext.broadcast(marked(chosen))
    each = tokens_in(rows, kept, CHOSEN_BITS).join(chosen, "token").distinct()
    lists = stored(each, "gram-entries")
    kept.destroy()
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    out = stored(lists.join(sizes, "token"), "gram-lists")
    release(chosen, lists)
    return out


def candidate_sets(docs: DataFrame, wanted: DataFrame, reading: int) -> tuple[DataFrame, DataFrame]:
    """The sets of the classes in ``wanted`` (class, rep), both stored: row, class, n, grams, cells, and the class, row, n, cells of one row a class.

    Documents are read again, and a bitmap of fixed size, in which every wanted class sets the
    bit of its (class, rep), lets only those through that may be wanted. So copies beside the
    class's representative are not carried. The sets stay where they were read: what the bitmap
    let through by chance, and a class that several tasks wrote, is left out by ``row``, whose
    numbers differ between readings 0 and 1.
    """
    mask = (1 << SLOT_BITS) - 1
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(slot_of(F.col("class"), F.col("rep")).alias("slot"))))

    def scan(batches):
        held, seen = sent.value, set()
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, len(b), BATCH)):
            keys, ns, grams, cells = [], [], [], []
            for doc_id, own in zip(batch.column(0).to_pylist(), gram_sets(batch.column(1).to_pylist(), _WORDS, GRAM)):
                if len(own):
                    key = set_key(own)
                    if in_bitmap(held, (key ^ (-1 if doc_id is None else doc_id)) & mask) and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        ns.append(len(own))
                        grams.append(packed_grams(own))
                        cells.append(set_cells(own))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.array(grams, pa.binary()), pa.array(cells, pa.binary())], ["class", "n", "grams", "cells"])

    passed = arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), scan, "class long, n long, grams binary, cells binary")
    sets = stored(passed.withColumn("row", F.monotonically_increasing_id() * 2 + reading), "gram-sets")
    sent.destroy()
    one = sets.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.min(F.struct("row", "n", "cells")).alias("one"))
    return sets, stored(one.select("class", "one.*"), "gram-cells")


def set_cells(grams: np.ndarray) -> bytes:
    """A bitmap of the cells that the grams fall into: two to four for each gram, a power of two of them."""
    m = max(64, 1 << (2 * len(grams) - 1).bit_length())
    out = np.zeros(m, bool)
    out[(grams & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def may_be_similar(n: int, x: np.ndarray, m: int, y: np.ndarray) -> bool:
    """Whether bitmaps of two sets of n and m grams leave room for the overlap: a cell that one of them lacks holds a gram that it lacks."""
    k = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, k), axis=0) for z in (x, y))  # cells of the larger one fold onto those of the smaller
    lacks = lambda a, b: int(np.bitwise_count(a & ~b).sum())
    return min(n - lacks(x, y), m - lacks(y, x)) * (OVER + UNDER) >= (n + m) * OVER


def packed_grams(grams: np.ndarray) -> bytes:
    """Six bytes of each gram: in one pair of sets, two grams that differ agree in these with a chance of one in 10^8 for a thousand grams."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - GRAM_BYTES:].tobytes()


def unpacked_grams(data) -> np.ndarray:
    out = np.zeros((len(data) // GRAM_BYTES, 8), np.uint8)
    out[:, 8 - GRAM_BYTES:] = np.frombuffer(data, np.uint8).reshape(-1, GRAM_BYTES)
    return out.view("<u8").reshape(-1)


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    """An upper bound of the overlap of two ascending arrays from splits at pivots."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    pivot = b[len(b) // 2]
    i, j = int(np.searchsorted(a, pivot)), len(b) // 2
    hit = int(i < len(a) and a[i] == pivot)
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i + hit:], b[j + 1:], depth - 1) + hit


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * intersection >= 75 * union; the suffix filter goes first."""
    total = len(a) + len(b)
    if suffix_bound(a, b, 3) * (OVER + UNDER) < total * OVER:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) * (OVER + UNDER) >= total * OVER


def close_pairs(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Of pairs (a, b: classes) those that the bitmaps of their sets let pass, stored, with the rows x and y of the sets."""
    def bound(batches):
        for batch in batches:
            n, m = batch.column(4).to_pylist(), batch.column(6).to_pylist()
            x, y = ([np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(i)] for i in (5, 7))
            yield batch.select([0, 1, 2, 3]).filter(pa.array([may_be_similar(*each) for each in zip(n, x, m, y)], pa.bool_()))

    side = lambda name, row, *names: cells.select(F.col("class").alias(name), F.col("row").alias(row), *[F.col(c).alias(as_) for c, as_ in zip(("n", "cells"), names)])
    full = pairs.join(side("a", "x", "n", "x_cells"), "a").join(side("b", "y", "m", "y_cells"), "b")
    return stored(arrow_pass(full.select("a", "b", "x", "y", "n", "x_cells", "m", "y_cells"), bound, "a long, b long, x long, y long"), "gram-close")


def sets_of(sets: DataFrame, sent) -> DataFrame:
    """row, grams of the sets whose classes a bitmap lets pass, in place."""
    def scan(batches):
        held = sent.value
        for batch in batches:
            slots = np.asarray(batch.column(0)) & ((1 << SLOT_BITS) - 1)
            yield batch.select([1, 2]).filter(pa.array((held[slots >> 6] >> (slots & 63)) & 1 > 0))

    return arrow_pass(sets.select("class", "row", "grams"), scan, "row long, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs (a, b: classes) that meet the threshold, stored. Sets move only for pairs whose bitmaps leave it open."""
    def compare(batches):
        for batch in batches:
            keep = [similar(unpacked_grams(x.as_buffer()), unpacked_grams(y.as_buffer())) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    close = close_pairs(pairs, cells)
    sent = [pairs.sparkSession.sparkContext.broadcast(bitmap_of(close.select(F.col(c).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).alias("slot")))) for c in ("a", "b")]
    left, right = (sets_of(sets, held) for held in sent)
    full = close.join(left.select(F.col("row").alias("x"), F.col("grams").alias("p")), "x").join(right.select(F.col("row").alias("y"), F.col("grams").alias("q")), "y")
    out = stored(arrow_pass(full.select("a", "b", "p", "q"), compare, "a long, b long"), "gram-links")
    for held in sent:
        held.destroy()
    release(close)
    return out


def hub_pairs(lists: DataFrame) -> DataFrame:
    """Each list's members with its hub, the member that meets the gram first, where the filters let them pass."""
    hubs = lists.groupBy("token").agg(F.min(F.struct("place", "class", "n")).alias("hub")).select(F.col("token").alias("t"), "hub")
    met = lists.join(hubs, F.col("token") == F.col("t")).filter((F.col("class") != F.col("hub.class")) & reach(F.col("n"), F.col("hub.n"), F.col("place"), F.col("hub.place")))
    return met.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")).distinct()


def open_lists(lists: DataFrame, parts: DataFrame | None) -> DataFrame:
    """Lists of three and more (hubs have met all of two) with members of several components, each entry with its ``part``."""
    lists = lists.filter("size > 2")
    placed = lists.withColumn("part", F.col("class")) if parts is None else lists.join(parts.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("part", F.coalesce("root", "class")).drop("root")
    several = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("token")
    return placed.join(several, "token", "left_semi")


def cross_pairs(live: DataFrame) -> DataFrame:
    """All pairs of one list in different components that the filters let pass.

    The smaller of two sets has to meet a gram that both share early enough to overlap one of its
    own size at least, so only such entries are asked for partners of their size and above.
    """
    small = live.filter((F.col("n") - F.col("place")) * (OVER + UNDER) >= F.col("n") * (2 * OVER))
    other = live.select("token", F.col("class").alias("b"), F.col("part").alias("q"), F.col("n").alias("m"), F.col("place").alias("other"))
    larger = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("class") < F.col("b")))
    met = small.join(other, "token").filter(larger & (F.col("part") != F.col("q")) & reach(F.col("n"), F.col("m"), F.col("place"), F.col("other")))
    return met.select(F.least("class", "b").alias("a"), F.greatest("class", "b").alias("b")).distinct()


@shuffles_cleaned
def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class, classes with their part, and the verified links between classes.

    rows: doc_id, n, class; parts: class, rep, part (a class of the same connected component);
    links: a, b. The links connect exactly the classes that all links of the full graph connect;
    pairs that were known to be in one component were not compared. All three are stored.
    """
    context = docs.sparkSession.sparkContext
    rows, counts = first_reading(docs)
    known = stored(rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "gram-classes")
    classes, copies = known.select("class", "rep"), known.filter("copies > 1")
    mask = F.lit((1 << SLOT_BITS) - 1)
    sent = [context.broadcast(x) for x in (counts, bitmap_of(copies.select(F.col("class").bitwiseAND(mask).alias("slot"))), bitmap_of(copies.select(slot_of(F.col("class"), F.col("rep")).alias("slot"))))]
    hashed = stored(with_prefixes(docs, *sent), "gram-prefixes")
    for x in sent:
        x.destroy()
    lists = entries(hashed)
    release(hashed)
    met = lambda pairs: pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    first = stored(hub_pairs(lists), "gram-pairs")
    asked = stored(classes.join(met(first), "class", "left_semi"), "gram-asked")
    sets, cells = candidate_sets(docs, asked, 0)
    links = verified(first, sets, cells)
    parts = None if links.isEmpty() else components(links)
    live = stored(open_lists(lists, parts), "gram-open")
    rest = stored(cross_pairs(live).join(first, ["a", "b"], "left_anti"), "gram-pairs")
    # few classes are left; documents are read again for those that no hub has met
    late = stored(classes.join(met(rest), "class", "left_semi"), "gram-asked")
    new = stored(late.join(asked, "class", "left_anti"), "gram-asked")
    late_sets = [] if new.isEmpty() else [candidate_sets(docs, new, 1)]
    more = verified(rest, *(union(list(tables)) for tables in zip((sets, cells), *late_sets)))
    if not more.isEmpty():
        if parts is not None:
            release(parts)
        parts = components(union([links, more]))
    release(lists, asked, sets, cells, first, live, rest, late, new, *(t for tables in late_sets for t in tables))
    if parts is None:
        out = classes.select("class", "rep", F.col("class").alias("part"))
    else:
        out = classes.join(parts.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "rep", F.coalesce("root", "class").alias("part"))
    out = stored(out, "gram-parts")
    every = stored(union([links, more]), "gram-links")
    release(known, links, more, *([] if parts is None else [parts]))
    return rows, out, every


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, class.

    ``component_id`` is the smallest doc_id reachable over links of similarity 0.75 or more.
    Texts of fewer than five words are one gram; NULL texts and texts without words have no
    grams, are linked with nothing and are their own component. Equal sets are one class. Rows
    that share an id are judged by their own texts; a NULL id takes part, but names no component
    (component_id is NULL if no reachable row has an id). An empty table gives an empty table.
    """
    rows, parts, _ = similar_classes(docs)
    least = parts.groupBy("part").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = parts.join(least.filter("size > 1"), "part", "left").select(F.col("class").alias("c"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(named, F.col("class") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class")


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """The columns of ``docs`` and ``name``: the digest of a text's set, NULL where it has no words."""
    names, place = docs.columns, docs.columns.index("text")

    def scan(batches):
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, len(b), BATCH)):
            texts = [None if t is None else t.encode() for t in batch.column(place).to_pylist()]
            keys = [set_key(own) if len(own) else None for own in gram_sets(texts, _WORDS, GRAM)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*names, name])

    return arrow_pass(docs, scan, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), f"`{name}` long"]))


def one_row_of_each(docs: DataFrame) -> DataFrame:
    """Exactly one row of each component, with all the columns of ``docs``; rows without words all stay.

    Of a component its class with the least id stays (classes without id last; ties by digest),
    and of that class the row with this id and the first text. Where one row has the id, the id
    alone finds it; NULL and repeated ids are told apart by the digests of their texts. NULL and
    empty texts have no words; long texts are hashed whole; rows repeated in full leave one. The
    names of other columns are free: those used in between are chosen beside them.
    """
    rows, parts, _ = similar_classes(docs.select("doc_id", "text"))
    stay, digest, own = free_names(docs.columns, "gram_stay", 3)
    first = parts.groupBy("part").agg(F.min(F.struct(F.col("rep").isNull().alias("unnamed"), "rep", "class")).alias("first"))
    again = rows.filter("class is not null and doc_id is not null").groupBy(F.col("doc_id").alias("again")).count().filter("count > 1").select("again")
    stays = first.select(F.col("first.rep").alias(stay), F.col("first.class").alias(digest)).join(again, F.col(stay) == F.col("again"), "left")
    stays = stored(stays.select(stay, digest, (F.col(stay).isNotNull() & F.col("again").isNull()).alias("alone")), "gram-stays")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.filter(worded)
    single = stays.filter("alone").select(stay)
    out = [kept.join(single, F.col("doc_id") == F.col(stay)).select(*named), docs.filter(~worded).select(*named)]
    shared = stays.filter("not alone").select(stay, digest)
    if not shared.isEmpty():
        repeated = shared.filter(F.col(stay).isNotNull()).select(stay).distinct()
        asked = with_class(union([kept.filter("doc_id is null").select(*named), kept.join(repeated, F.col("doc_id") == F.col(stay), "left_semi").select(*named)]), own)
        met = asked.join(shared, F.col("doc_id").eqNullSafe(F.col(stay)) & (F.col(own) == F.col(digest)))
        row = F.struct(*named)
        one = met.groupBy(stay, digest).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias(own))
        out.append(one.select(f"{own}.*"))
    release(rows, parts)
    return union(out)
