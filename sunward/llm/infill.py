"""Fill-in-middle transformation: texts cut at code points by select on SWAR words (operator 12).

Cutting a text after k units needs the byte where the k-th unit ends. A batch's texts lie in one
buffer, which is viewed as 64-bit words. In each word the bytes that end a unit (the next byte is
no continuation byte) are marked by shifts and masks, eight at a time; a population count per word
and their running sum turn "the k-th unit of text t" into a binary search for the word, and a sum
of marks by one multiplication finds the byte in it. Nothing is decoded and no byte is looked at
on its own; memory is a fixed multiple of the buffer.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import arrow_pass, free_names

#: Rows cut at a time.
BATCH = 256

_TOPS = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)
_LITTLE = np.dtype("<u8")


@dataclass(frozen=True)
class Form:
    """How rows are turned: sentinels, share of rows turned and of these in suffix-first order, in hundredths."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    turned: int = 90
    suffix_first: int = 20
    seed: int = 1

    def __post_init__(self):
        for s in self.sentinels:
            # such strings never overlap one another, so they are found again wherever a text is cut
            if len(s) < 3 or s[0] != "<" or s[-1] != ">" or set("<>") & set(s[1:-1]):
                raise ValueError(f"a sentinel is <, a name and >: {s!r}")
        if len(set(self.sentinels)) < 3:
            raise ValueError("sentinels must differ")

    @property
    def sentinels(self):
        return self.prefix, self.suffix, self.middle


def unit_ends(words: np.ndarray) -> np.ndarray:
    """For each word its bytes that end a unit, as the top bits of these bytes. ``words``: little-endian, zeros after the end."""
    starts = (~words | (words << np.uint64(1))) & _TOPS  # not 10xxxxxx
    after = np.append(starts[1:], _TOPS)
    return (starts >> np.uint64(8)) | ((after & np.uint64(0x80)) << np.uint64(56))


class Units:
    """Rank and select of unit ends over a buffer of UTF-8."""

    def __init__(self, data: np.ndarray):
        """``data``: uint8."""
        padded = np.zeros(-(-len(data) // 8) * 8 + 8, np.uint8)
        padded[:len(data)] = data
        self.marks = unit_ends(padded.view(_LITTLE))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before byte ``at``."""
        word, low = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (low << np.uint64(3))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th unit of the buffer (from 1); 0 for k = 0."""
        word = np.maximum(np.searchsorted(self.before, k, side="left") - 1, 0)
        inside = (k - self.before[word]).astype(np.uint64)
        sums = (self.marks[word] >> np.uint64(7)) * _ONES  # byte i: marks in bytes 0 to i
        reached = ((sums | _TOPS) - inside * _ONES) & _TOPS  # top bit where the sum is at least ``inside``
        return np.where(k > 0, word * 8 + 9 - np.bitwise_count(reached), 0)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes and the offsets of its rows; NULL rows are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def draws(doc_id, seed: int):
    """h1 to h4: the first four groups of eight hex digits of a seeded sha256 of the id (NULL: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, form: Form = Form()) -> DataFrame:
    """The columns of ``docs`` and: n, form, prefix_chars, middle_chars, output.

    ``n`` is the number of code points; the two cuts are drawn from the id alone. A text that is
    empty or holds a sentinel, and a share of all rows, stay ``plain`` (lengths NULL, output the
    text). NULL texts are empty, NULL ids draw as an id without digits; rows that repeat are
    treated alike, each by itself. Texts of any length are cut in one go, in memory of a small
    multiple of their bytes. An empty table stays empty. Columns named like a result are replaced.
    """
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    others = [c for c in docs.columns if c not in results]
    draw = free_names(docs.columns, "draw", 4)
    rows = docs.select(*[f"`{c}`" for c in others], *[h.alias(name) for name, h in zip(draw, draws("doc_id", form.seed))])
    place, width = others.index("text"), len(others)
    marks = [s.encode() for s in form.sentinels]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "n long, form string, prefix_chars long, middle_chars long, output string"])

    def scan(batches):
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, len(b), BATCH)):
            data, ends = texts_of(batch.column(place))
            units = Units(data)
            first = units.rank(ends[:-1])
            n = units.rank(ends[1:]) - first
            h1, h2, h3, h4 = (np.asarray(batch.column(width + i)) for i in range(4))
            low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
            # nothing before a text's first unit belongs to it, also where no unit is asked for
            cuts = [np.where(k > 0, units.select(first + k), ends[:-1]) for k in (low, high)]
            whole = data.tobytes()
            forms, outputs = [], []
            for i, (start, p, q, end) in enumerate(zip(ends[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), ends[1:].tolist())):
                if start == end or h3[i] % 100 >= form.turned or any(whole.find(m, start, end) >= 0 for m in marks):
                    forms.append("plain")
                    outputs.append(whole[start:end])
                elif h4[i] % 100 < form.suffix_first:
                    forms.append("spm")
                    outputs.append(b"".join((marks[1], whole[q:end], marks[0], whole[start:p], marks[2], whole[p:q])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((marks[0], whole[start:p], marks[1], whole[q:end], marks[2], whole[p:q])))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(n, pa.int64()), pa.array(forms), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain),
                                              pa.array(outputs, pa.binary()).cast(pa.string())], [*others, *results])

    return arrow_pass(rows, scan, schema)


def restored(output, form_name, form: Form = Form()):
    """The text that an output was made from, by its form alone."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in form.sentinels))
    return F.when(form_name == "plain", output).when(form_name == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
