"""Exact rank correlations of pairs of columns, with few bytes moved and kept for a row.

Rows are read once and kept on disk as packed chunks. Exact counts of the values between chosen
borders say how many values lie below each stretch of a column, so a stretch can be ranked
by itself. Pairs follow one another: the rows of a pair meet by stretches of the first column
for its ranks, then, with these ranks, by stretches of the second one, where products are summed. Values
that hold many rows are borders themselves: their ranks are known from the counts, and their
rows don't move for them. Shuffle files go as each pair's job ends, and the chunks in the end.
"""

import pickle
import sys
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, functions as F

# Rows of a chunk, rows that a task holds before it gives them out by stretches, and rows of a stretch.
_CHUNK, _HELD, _PART = 1 << 17, 1 << 20, 1 << 19
# Values that a chunk names as marks of its order, and stretches between the borders chosen from them.
_MARKS, _STRETCHES = 256, 1024
# A value is ranked by the counts alone if it holds one row in so many.
_DIRECT = 2048
#: Code of missing and non-finite values.
NOTHING = np.iinfo(np.int64).min
_SUMS = ("xy_own", "xy_every", "xx_own", "xx_every", "yy_own", "yy_every")
_MOVED = "part int, data binary, scope int, " + ", ".join(f"{c} double" for c in _SUMS)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


def codes(values: np.ndarray) -> np.ndarray:
    """Order-preserving integers of doubles."""
    bits = (values + 0.0).view(np.int64)  # one zero
    code = np.where(bits < 0, -(bits & np.int64(0x7FFFFFFFFFFFFFFF)), bits)
    return np.where(np.isfinite(values), code, NOTHING)


def _planes(a: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers, then the second ones and so on."""
    turned = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
    return pa.Codec("zstd", 1).compress(pa.py_buffer(turned), asbytes=True)


def _from_planes(kind: str, n: int, data: bytes) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(pa.Codec("zstd").decompress(data, n * kind.itemsize), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def _small(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as hold them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def pack(a: np.ndarray, ordered: bool = False) -> tuple:
    """A column of integers in few bytes: gaps of ordered ones, else numbers of distinct ones if these are few."""
    if ordered:
        return "gaps", len(a), _planes(np.diff(a, prepend=np.int64(0)))
    some = a[::max(1, len(a) // 512)]
    if a.itemsize > 1 and len(np.unique(some)) < 0.9 * len(some):
        distinct, place = np.unique(a, return_inverse=True)
        if 4 * len(distinct) <= len(a):
            return "few", pack(distinct, True), _plain(_small(place))
    return _plain(a)


def _plain(a: np.ndarray) -> tuple:
    return "plain", a.dtype.str, len(a), _planes(a)


def unpack(packed: tuple) -> np.ndarray:
    kind, *rest = packed
    if kind == "gaps":
        return np.cumsum(_from_planes("<i8", *rest))
    if kind == "few":
        return unpack(rest[0])[unpack(rest[1])]
    return _from_planes(*rest)


def _tables(batches):
    """The batches of a task, put together to chunks."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _CHUNK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _chunks(batches):
    """Rows (scope, codes of a column, ...) as packed chunks, with the sizes of their scopes and the marks of their columns."""
    for table in _tables(batches):
        coded = table.column(0).combine_chunks().dictionary_encode()
        labels = [*coded.dictionary.to_pylist(), None]
        scope = np.asarray(coded.indices.fill_null(len(labels) - 1)).astype(np.int64)
        columns = [codes(np.asarray(table.column(i).combine_chunks().fill_null(np.nan))) for i in range(1, table.num_columns)]
        if "all" in labels:  # as in a union of all rows, called 'all', and the rows of each phase
            named = np.flatnonzero(scope == labels.index("all"))
            scope[named] = len(labels) - 1
            scope, *columns = [np.concatenate([c, c[named]]) for c in (scope, *columns)]
        # marks of another chunk lie elsewhere, so that together they name more values
        moved = (int(np.bitwise_xor.reduce(np.concatenate(columns))) * 0x9E3779B97F4A7C15 % 2 ** 64) / 2 ** 64
        marks = []
        for c in columns:
            there = np.sort(c[c != NOTHING])
            n = min(_MARKS, len(there))
            marks.append((len(there), there[((np.arange(n) + moved) * (len(there) / max(n, 1))).astype(np.int64).clip(0, max(len(there) - 1, 0))]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([labels], pa.list_(pa.string())), pa.array([np.bincount(scope, minlength=len(labels)).tolist()], pa.list_(pa.int64())),
             pa.array([pickle.dumps(marks, 5)], pa.binary()), pa.array([pickle.dumps([pack(c) for c in (_small(scope), *columns)], 5)], pa.binary())], ["scopes", "sizes", "marks", "data"])


def _borders(marks: list) -> np.ndarray:
    """Values that part a column into stretches of like size, and values that look like holding many rows. ``marks``: (rows, marks) of chunks."""
    marks = [(n, m) for n, m in marks if n]
    if not marks:
        return np.zeros(0, np.int64)
    values, weights = np.concatenate([m for _, m in marks]), np.concatenate([np.full(len(m), n / len(m)) for n, m in marks])
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    even = values[order][np.searchsorted(upto, upto[-1] * np.arange(1, _STRETCHES) / _STRETCHES).clip(0, len(values) - 1)]
    distinct, place, met = np.unique(values, return_inverse=True, return_counts=True)
    heavy = distinct[(met > 1) & (np.bincount(place, weights) * 2 * _DIRECT >= upto[-1])]
    return np.union1d(even, heavy)


def _slots(borders: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Odd for a border, even for what lies between two of them."""
    left = np.searchsorted(borders, code)
    return left + left + (borders[np.minimum(left, len(borders) - 1)] == code if len(borders) else 0)


def _read(batches, index: dict, wanted: list):
    """Of each chunk, the numbers of its rows' scopes and the wanted columns."""
    for batch in batches:
        for labels, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            packed = pickle.loads(data.as_buffer())
            yield np.array([index.get(x, 0) for x in labels], np.int64)[unpack(packed[0])], [unpack(packed[1 + i]) for i in wanted]


def _summed(keys: list, counts: list):
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def _count_task(index: dict, borders: list, partners: list):
    """Rows of a task by column, partners that are there (as bits), scope and slot."""
    def run(batches):
        held = {}
        for scope, columns in _read(batches, index, list(range(len(borders)))):
            known = [c != NOTHING for c in columns]
            for i, c in enumerate(columns):
                wide = 2 * len(borders[i]) + 1
                bits = sum((known[p].astype(np.int64) << k for k, p in enumerate(partners[i])), np.zeros(len(c), np.int64))
                keys = scope * wide + _slots(borders[i], c)
                for b in np.unique(bits[known[i]]):
                    mine = keys[known[i] & (bits == b)]
                    met, n = np.unique(mine, return_counts=True)
                    before = held.get((i, b))
                    held[i, b] = _summed([before[0], met], [before[1], n]) if before else (met, n)
        for (i, b), (keys, n) in held.items():
            wide = 2 * len(borders[i]) + 1
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(i, pa.int32()), len(n)), pa.repeat(pa.scalar(int(b), pa.int64()), len(n)),
                                              pa.array((keys // wide).astype(np.int32)), pa.array((keys % wide).astype(np.int32)), pa.array(n)], ["side", "bits", "scope", "slot", "n"])
    return run


class Layout:
    """Where the values of a column stand among the rows of a pair.

    Ranks are told doubled and less their mean, as whole numbers: ``own`` within the scope, ``every`` over all.
    """

    def __init__(self, borders: np.ndarray, scopes: int, scope: np.ndarray, slot: np.ndarray, n: np.ndarray):
        """``n``: rows by scope and slot; several counts of the same rows' place are added up."""
        self.borders, self.wide = borders, 2 * len(borders) + 1
        # only what is there: keys of scope and slot in order, their rows, and the rows below them in the scope
        self.keys, self.counts = _summed([scope.astype(np.int64) * self.wide + slot], [n])
        scope, slot = self.keys // self.wide, self.keys % self.wide
        self.sizes = np.bincount(scope, self.counts, scopes).astype(np.int64)
        self.below = np.cumsum(self.counts) - self.counts - (np.cumsum(self.sizes) - self.sizes)[scope]
        every, self.total = np.bincount(slot, self.counts, self.wide).astype(np.int64), int(self.counts.sum())
        direct = (np.arange(self.wide) % 2 == 1) & (every > 0) & (every * _DIRECT >= self.total)
        most = min(_PART, max(self.total // 64, 1 << 12))
        part, firsts, held, fresh = np.full(self.wide, -1), [], 0, True
        for k in np.flatnonzero(every):
            if direct[k]:
                fresh = True
                continue
            if fresh or held + every[k] > most:
                firsts.append(k)
                held, fresh = 0, False
            held += every[k]
            part[k] = len(firsts) - 1
        self.parts, self.direct_rows = len(firsts), int(every[direct].sum())
        # a part, or -1 less the slot of a directly ranked value
        self.place, self.firsts = np.where(direct, -1 - np.arange(self.wide), part), np.array(firsts, np.int64)
        self.below_every = np.cumsum(every) - every
        self.every = 2 * self.below_every + every - self.total
        # squares of the values that are ranked directly, by scope
        mine = direct[slot]
        own, every = self.direct(scope[mine], self.place[slot[mine]])
        self.squares = [np.bincount(scope[mine], self.counts[mine] * r.astype(float) ** 2, scopes) for r in (own, every)]

    def places(self, code: np.ndarray) -> np.ndarray:
        return self.place[_slots(self.borders, code)]

    def direct(self, scope, place):
        """Ranks of directly ranked values."""
        slot = -1 - place
        at = np.searchsorted(self.keys, scope * self.wide + slot)
        return 2 * self.below[at] + self.counts[at] - self.sizes[scope], self.every[slot]

    def ranked(self, part: int, scope, code):
        """Ranks of all rows of a part, ordered by their codes."""
        n = len(code)
        fresh = np.r_[True, code[1:] != code[:-1]]
        first = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        every = 2 * self.below_every[self.firsts[part]] + first[run] + np.r_[first[1:], n][run] - self.total
        by = np.argsort(scope, kind="stable")
        s, c = scope[by], code[by]
        new = np.r_[True, s[1:] != s[:-1]]
        fresh = new | np.r_[True, c[1:] != c[:-1]]
        first, start = np.flatnonzero(fresh), np.flatnonzero(new)
        # of each scope: where its rows start here, and the rows below the part
        met, run = np.cumsum(new) - 1, np.cumsum(fresh) - 1
        base = 2 * (self.below[np.searchsorted(self.keys, s[start] * self.wide + self.firsts[part])] - start) - self.sizes[s[start]]
        own = np.empty(n, np.int64)
        own[by] = base[met] + first[run] + np.r_[first[1:], n][run]
        return own, every


class _Sums:
    """Sums by scope."""

    def __init__(self, scopes: int):
        self.of = {c: np.zeros(scopes) for c in _SUMS}

    def add(self, name: str, scope, own, every, own2, every2):
        for c, a, b in ((f"{name}_own", own, own2), (f"{name}_every", every, every2)):
            self.of[c] += np.bincount(scope, a.astype(float) * b, len(self.of[c]))

    def rows(self):
        met = np.flatnonzero(np.any([v != 0 for v in self.of.values()], 0)).astype(np.int32)
        empty = pa.nulls(len(met), pa.binary())
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(-1, pa.int32()), len(met)), empty, pa.array(met), *[pa.array(v[met]) for v in self.of.values()]], ["part", "data", "scope", *_SUMS])


class _Sender:
    """Holds rows (code, scope, other columns) and gives them out in packed runs of a part."""

    def __init__(self, layout: Layout):
        self.layout, self.held, self.rows = layout, [], 0

    def add(self, *columns):
        if len(columns[0]):
            self.held.append(columns)
            self.rows += len(columns[0])
        if self.rows >= _HELD:
            yield from self.flush()

    def flush(self):
        if not self.rows:
            return
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.rows = [], 0
        order = np.argsort(columns[0])
        columns = [c[order] for c in columns]
        part = self.layout.places(columns[0])
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        data = [pickle.dumps([pack(c[a:b], k == 0) for k, c in enumerate(columns)], 5) for a, b in zip(first, [*first[1:], len(part)])]
        yield pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(data, pa.binary()), pa.nulls(len(data), pa.int32()), *[pa.nulls(len(data), pa.float64()) for _ in _SUMS]],
                                         ["part", "data", "scope", *_SUMS])


def _by_x_task(index, i, j, x: Layout):
    """Rows of a pair to the parts of their first column."""
    def run(batches):
        out = _Sender(x)
        for scope, (a, b) in _read(batches, index, [i, j]):
            both = np.flatnonzero((a != NOTHING) & (b != NOTHING))
            there = both[x.places(a[both]) >= 0]
            yield from out.add(a[there], _small(scope[there]), b[there])
        yield from out.flush()
    return run


def _on(scope, own, every, code, y: Layout, sums: _Sums, out: _Sender):
    """Ranked rows to the parts of their second column; those with a directly ranked value there are summed at once."""
    place = y.places(code)
    here = np.flatnonzero(place < 0)
    sums.add("xy", scope[here], own[here], every[here], *y.direct(scope[here], place[here]))
    there = np.flatnonzero(place >= 0)
    small = np.int32 if y.total < 1 << 31 else np.int64
    yield from out.add(code[there], _small(scope[there]), own[there].astype(small), every[there].astype(small))


def _direct_task(index, i, j, x: Layout, y: Layout):
    """Rows of a pair whose first value is ranked directly, to the parts of their second column."""
    def run(batches):
        sums, out = _Sums(len(index)), _Sender(y)
        for scope, (a, b) in _read(batches, index, [i, j]):
            both = np.flatnonzero((a != NOTHING) & (b != NOTHING))
            place = x.places(a[both])
            here, place = both[place < 0], place[place < 0]
            yield from _on(scope[here], *x.direct(scope[here], place), b[here], y, sums, out)
        yield from out.flush()
        yield sums.rows()
    return run


def _parts(batches, sums: _Sums):
    """The rows of one part after another, ordered by code; sums of earlier steps are added up."""
    now, held = None, []

    def whole():
        columns = [np.concatenate(c) for c in zip(*[[unpack(c) for c in pickle.loads(d)] for d in held])]
        order = np.argsort(columns[0])
        code, scope, *rest = [c[order] for c in columns]
        return now, code, scope.astype(np.int64), *rest

    for batch in batches:
        summed = np.flatnonzero(np.asarray(batch.column(0)) < 0)
        for c in _SUMS if len(summed) else ():
            np.add.at(sums.of[c], np.asarray(batch.column("scope").take(summed)), np.asarray(batch.column(c).take(summed)))
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if part < 0:
                continue
            if part != now and held:
                yield whole()
                held = []
            now = part
            held.append(data.as_py())
    if held:
        yield whole()


def _by_y_task(x: Layout, y: Layout):
    """Ranks rows of whole parts of the first column and sends them to the parts of the second one."""
    def run(batches):
        sums, out = _Sums(len(x.sizes)), _Sender(y)
        for part, code, scope, other in _parts(batches, sums):
            own, every = x.ranked(part, scope, code)
            sums.add("xx", scope, own, every, own, every)
            yield from _on(scope, own, every, other, y, sums, out)
        yield from out.flush()
        yield sums.rows()
    return run


def _product_task(y: Layout):
    """Sums of whole parts of the second column."""
    def run(batches):
        sums = _Sums(len(y.sizes))
        for part, code, scope, own_x, every_x in _parts(batches, sums):
            own, every = y.ranked(part, scope, code)
            sums.add("yy", scope, own, every, own, every)
            sums.add("xy", scope, own_x.astype(np.int64), every_x.astype(np.int64), own, every)
        yield sums.rows()
    return run


@contextmanager
def _settings(spark, wanted: dict):
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _gathered(moved: DataFrame) -> DataFrame:
    return moved.repartition("part").sortWithinPartitions("part")


def _pair(kept: DataFrame, index: dict, i: int, j: int, x: Layout, y: Layout) -> dict:
    """Sums of a pair by scope."""
    rows = []
    if x.parts:
        rows.append(_gathered(kept.mapInArrow(_by_x_task(index, i, j, x), _MOVED)).mapInArrow(_by_y_task(x, y), _MOVED))
    if x.direct_rows:
        rows.append(kept.mapInArrow(_direct_task(index, i, j, x, y), _MOVED))
    sums = _Sums(len(index))
    if rows:
        moved = _gathered(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])).mapInArrow(_product_task(y), _MOVED)
        for r in moved.groupBy("scope").agg(*[F.sum(c).alias(c) for c in _SUMS]).collect():
            for c in _SUMS:
                sums.of[c][r.scope] = r[c]
    for name, of in (("xx", x), ("yy", y)):
        sums.of[f"{name}_own"] += of.squares[0]
        sums.of[f"{name}_every"] += of.squares[1]
    return sums.of


def rank_correlations(rows: DataFrame, quantities: int):
    """For rows (scope, quantities, variables): sizes by scope, and by (quantity, variable) the valid rows and the rank correlation by scope.

    The scope None stands for all rows, whatever their scope. The driver holds marks of each chunk and counts by
    scope and stretch. Runs one job that reads ``rows``, one that counts, and one for each pair.
    """
    spark, columns = rows.sparkSession, len(rows.columns) - 1
    partners = [list(range(quantities, columns)) if i < quantities else list(range(quantities)) for i in range(columns)]
    # chunks are large rows, so few of them are handed to Python at once
    later = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
    kept = rows.mapInArrow(_chunks, "scopes array<string>, sizes array<long>, marks binary, data binary").persist(StorageLevel.DISK_ONLY)
    try:
        sizes, marks = {None: 0}, [[] for _ in range(columns)]
        for r in kept.select("scopes", "sizes", "marks").collect():
            for label, n in zip(r.scopes, r.sizes):
                if n:
                    sizes[label] = sizes.get(label, 0) + n
            for held, found in zip(marks, pickle.loads(r.marks)):
                held.append(found)
        borders, index = [_borders(m) for m in marks], {label: k for k, label in enumerate(sizes)}
        kept_rows = kept.select("scopes", "data")
        with _settings(spark, later):
            counted = kept_rows.mapInArrow(_count_task(index, borders, partners), "side int, bits long, scope int, slot int, n long")
            counted = counted.groupBy("side", "bits", "scope", "slot").agg(F.sum("n").alias("n")).toArrow()
            side, bits, scope, slot, n = [np.asarray(c) for c in counted.columns]

            def layout(i, partner):
                mine = (side == i) & ((bits >> partners[i].index(partner)) & 1 == 1)
                return Layout(borders[i], len(index), scope[mine], slot[mine], n[mine])

            found = {}
            for i in range(quantities):
                for j in range(quantities, columns):
                    x, y = layout(i, j), layout(j, i)
                    of = _pair(kept_rows, index, i, j, x, y)
                    # the scope None tells of all rows
                    told = {label: (int(x.sizes[k]), *[of[f"{c}_own"][k] for c in ("xy", "xx", "yy")]) for label, k in index.items() if label is not None}
                    told[None] = x.total, *[of[f"{c}_every"].sum() for c in ("xy", "xx", "yy")]
                    found[i, j - quantities] = {label: (valid, float(xy / np.sqrt(xx * yy)) if xx * yy > 0 else None) for label, (valid, xy, xx, yy) in told.items()}
        total = sum(sizes.values())
        return {None: total} | {label: k for label, k in sizes.items() if label is not None}, found
    finally:
        kept.unpersist(True)
