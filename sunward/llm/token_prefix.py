"""Exact token counts at every prefix, by dynamic programming over the vocabulary (operator 8).

A byte-pair encoding has a property that makes prefixes cheap: a token sequence is the encoding
of its text if and only if every two neighbouring tokens are the encoding of their own
concatenation. So the encoding of ``text[:i]`` is the encoding of ``text[:j]`` plus one token
``text[j:i]``, for the single j at which that token agrees with the last token before j. One
pass over the text thus gives the exact count at every prefix, and answers "how many tokens",
"where must this be cut for a budget" and "how many tokens has this slice's head" without
encoding anything again.

Pieces of the vocabulary never run over a blank that follows other text, so a text falls into
independent segments, and the prefix counts of a segment are remembered (up to a bound).
"""

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import arrow_pass

BLANK = "▁"
#: Characters between remembered heads of segments, and how many such steps the longest head has.
HEAD, LONGEST_HEAD = 3, 8


class Remembered(dict):
    """A function's results in two generations: when the young one is full it becomes the old one.

    What is asked for again stays, and memory is bounded by twice ``bound`` entries.
    """

    def __init__(self, function, bound: int):
        self.function, self.bound, self.old = function, bound, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.function(key)
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixCounter:
    """Prefix counts under one sentencepiece BPE model with an identity normaliser."""

    def __init__(self, model_file: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if self.library.normalize("a  b ﬁ") != f"{BLANK}a{BLANK}{BLANK}b{BLANK}ﬁ":
            raise ValueError("the prefix counts need a model that only escapes blanks")
        n = self.library.get_piece_size()
        ordinary = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.names = [self.library.id_to_piece(i) for i in range(n)]
        self.pieces = {self.names[i]: i for i in ordinary}
        self.longest = max(map(len, self.pieces))
        inner = [p for p in self.pieces if BLANK in p[1:] and p.strip(BLANK)]
        if inner:
            raise ValueError(f"pieces run over a blank: {inner[:3]}")
        # characters that stand in no piece but their own end a segment too
        joined = {c for p in self.pieces if len(p) > 1 for c in p}
        apart = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        lone = f"[{apart}]" if apart else "(?!)"
        # so does a letter before a sign that follows a letter in no piece (a comma, a full stop)
        after = {p[i] for p in self.pieces for i in range(1, len(p)) if re.match(r"\w", p[i - 1])}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not re.match(r"\w", c) and c not in after)
        ended = f"{BLANK}*\\w+(?=[{signs}])|" if signs else ""
        self.cut = re.compile(f"{ended}{BLANK}+[^{BLANK}{apart}]*|{lone}|[^{BLANK}{apart}]+")
        self.totals = Remembered(lambda s: self.segment(s)[-1], 400_000)
        self.heads = Remembered(lambda s: self.walked(s), 60_000)
        self.pairs = Remembered(lambda pair: self.apart(self.names[pair // n], self.names[pair % n]), 400_000)

    def apart(self, left: str, right: str) -> bool:
        """Whether two tokens stay apart when their concatenation is encoded."""
        # the line feed has no piece, so nothing merges with what the library puts in front
        return self.library.encode("\n" + left + right, out_type=str)[2:] == [left, right]

    def walked(self, s: str) -> tuple[list[int], list[int | None]]:
        """Count and last token (its id) at every prefix of a segment, the empty one first.

        They depend on nothing behind the prefix, so a segment goes on from where the remembered
        head of its first characters, HEAD by HEAD, has come to.
        """
        pieces, longest, pairs, n = self.pieces, self.longest, self.pairs, len(self.names)
        count, last = [0], [None]
        head = min((len(s) - 1) // HEAD, LONGEST_HEAD) * HEAD
        if head:
            count, last = (known.copy() for known in self.heads[s[:head]])
        for i in range(head + 1, len(s) + 1):
            for j in range(max(0, i - longest), i):
                token = pieces.get(s[j:i])
                if token is not None:
                    before = last[j]
                    if before is None or pairs[before * n + token]:
                        count.append(count[j] + 1)
                        last.append(token)
                        break
            else:  # no piece ends here: the character falls back to its bytes, and nothing merges with it
                count.append(count[i - 1] + len(s[i - 1].encode("utf-8", "surrogatepass")))
                last.append(None)
        return count, last

    def segment(self, s: str) -> list[int]:
        """Token counts at every prefix of a segment, the empty one first."""
        return self.walked(s)[0]

    def cuts(self, text: str) -> list[str]:
        """Segments of a text; the first starts with the blank the library puts in front."""
        return self.cut.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token count of text[:k] for k = 0 .. len(text)."""
        out, total, at = np.zeros(len(text) + 1, np.int64), 0, 0
        for k, s in enumerate(self.cuts(text)):
            own = self.segment(s)
            own = own[1:] if k == 0 else own
            out[at:at + len(own)] = np.fromiter(own, np.int64, len(own)) + total
            at, total = at + len(own) - 1, total + own[-1]
        out[0] = 0  # the library gives an empty text no tokens, not even the blank
        return out

    def fits(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the length of its longest prefix of at most ``budget``."""
        cuts = self.cuts(text)
        reached = list(accumulate(map(self.totals.__getitem__, cuts), initial=0))
        if reached[-1] <= budget:
            return reached[-1], len(text)
        # a whole segment never has fewer tokens than none of it, so the prefix ends in the first that goes over
        k = bisect_right(reached, budget) - 1
        own = self.segment(cuts[k])
        inside = max(i for i, n in enumerate(own) if reached[k] + n <= budget)
        return reached[-1], max(0, sum(map(len, cuts[:k])) + inside - 1)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    """One counter a worker process, so that what it remembers serves all its tasks."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, budget: int, id_column="doc_id", text_column="text", prefixes=False) -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit, fit_chars.

    ``fit_chars`` is the length in code points of the longest prefix of at most ``budget``
    tokens. With ``prefixes`` the column ``prefix_tokens`` (array) holds the exact count at
    every prefix, from the empty one to the whole text. Special strings inside a text are
    ordinary text. A NULL text counts as empty: no bytes, no tokens. Rows keep their ids as they
    are, NULL or repeated; an empty table gives an empty table. The work is one narrow pass: no
    shuffle, nothing held beyond a batch and bounded memories.
    """
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    schema += ", prefix_tokens array<int>" if prefixes else ""

    def count(batches):
        own = counter(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pairs = [own.fits(t, budget) for t in texts]
            tokens = [n for n, _ in pairs]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                       pa.array([n > budget for n in tokens], pa.bool_()), pa.array([f for _, f in pairs], pa.int64())]
            names = [id_column, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if prefixes:
                columns.append(pa.array([own.prefixes(t) for t in texts], pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_pass(docs.select(F.col(id_column), F.col(text_column)), count, schema)
