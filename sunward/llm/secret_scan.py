"""Secret scans by novelty: what a candidate adds to its compressed surroundings (operator 13).

Three fixed patterns find assignments, access keys and long hex runs. Beside them, every string
of key-like characters that follows a sensitive word on its line is a candidate. Its surroundings
are compressed by zstandard, primed with a dictionary of identifiers, with and without it; the
bytes it adds, for each of its own, are its novelty. Names, paths, placeholders and repeated
strings are mostly matches in the dictionary or nearby and add little; random keys add nearly
all of their bytes and are reported.
"""

import builtins
import keyword
import re
import sys

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .shared import arrow_pass

#: Fixed patterns of the base: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # runs, so shorter ones need not be met at all
)
#: Cheap signs without one of which a pattern cannot match (in lower case for the first).
_ASSIGN_SIGNS = ("password", "passwd", "secret", "token", "apikey", "api_key")
NOVEL = "novel"
ORDER = {kind: i for i, kind in enumerate([*(b[0] for b in BASE), NOVEL])}

#: A candidate, and the words that make what follows them on the line sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|bearer|private|signature|session|cookie|salt|api_?key|access_?key|key\b|_key|-key", re.I | re.A)
_CLASSES = tuple(re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]"))
#: Characters between a sensitive word and a candidate at most; characters before and after it that surround it.
NEAR, BEFORE, AFTER = 64, 512, 256
#: Added bytes for each of the candidate's own from which it is reported; hex digits carry half a byte
#: each, and zstandard finds a part of that.
NOVELTY, HEX_NOVELTY = 0.8, 0.6
_HEX = re.compile(r"[0-9A-Fa-f-]+")
LEVEL = 3
#: Rows scanned at a time.
BATCH = 512

#: Names of settings and code that the dictionary holds beside those of the language.
COMMON = ("your_api_key_goes_here", "your-secret-key-here", "insert_your_token_here", "replace_with_your_password", "test-session-cookie", "example", "placeholder", "changeme", "sample", "dummy", "value", "default", "config", "settings", "environment", "username", "password", "secret", "token", "access", "client",
          "api_key", "private_key", "public_key", "certificate", "authorization", "bearer", "session", "cookie", "signature", "https://", "http://", "www.", ".com/", ".org/", ".html", ".json", "index",
          "localhost", "127.0.0.1", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "function", "return", "const", "static", "public", "private", "string", "number", "boolean",
          "undefined", "process.env.", "os.environ", "getenv", "request", "response", "header", "content", "application", "database", "connection", "service", "account", "document", "element", "object")


def identifiers() -> bytes:
    """The words of the dictionary, made once on the driver so that all tasks hold the same."""
    names = {n for n in dir(builtins) if not n.startswith("_")} | set(keyword.kwlist) | {n for n in sys.stdlib_module_names if not n.startswith("_")}
    return " ".join([*sorted(names), *COMMON]).encode()


class Novelty:
    """Marginal compressed size under a fixed dictionary."""

    def __init__(self, words: bytes):
        primed = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, data: bytes) -> int:
        return len(self.packer.compress(data))

    def of(self, before: str, candidate: str, after: str) -> float:
        """Bytes that ``candidate`` adds between ``before`` and ``after``, for each of its own; its other occurrences nearby are left out, or a key used twice would explain itself."""
        before, after = before.replace(candidate, ""), after.replace(candidate, "")
        return (self.size((before + candidate + after).encode()) - self.size((before + after).encode())) / len(candidate)


def base_spans(text: str) -> list[tuple]:
    """kind, start, end of the fixed patterns, leftmost and without overlaps within a kind."""
    out = []
    small = text.lower()
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(s in small for s in _ASSIGN_SIGNS) or kind == "access" and "AKIA" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return out


def candidates(text: str):
    """Key-like strings after a sensitive word: start, end."""
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".-":  # the end of a sentence
            end -= 1
        if end - start < 16 or sum(c.search(text, start, end) is not None for c in _CLASSES) < 2:
            continue
        lead = text[max(0, start - NEAR):start]
        if SENSITIVE.search(lead, lead.rfind("\n") + 1):
            yield start, end


def spans_of(text: str, novelty: Novelty, least=NOVELTY, least_hex=HEX_NOVELTY) -> list[tuple]:
    """kind, start, end, novelty (None for the base) by start, then kind; novel ones overlap no base span."""
    found = [(*s, None) for s in base_spans(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    at, reach = 0, 0
    for start, end in candidates(text):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start:
            score = novelty.of(text[max(0, start - BEFORE):start], text[start:end], text[end:end + AFTER])
            if score >= (least_hex if _HEX.fullmatch(text, start, end) else least):
                found.append((NOVEL, start, end, score))
    return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


SPANS = "array<struct<kind: string, start: long, end: long, novelty: double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def secrets(docs: DataFrame, least=NOVELTY, least_hex=HEX_NOVELTY) -> DataFrame:
    """The columns of ``docs`` and ``found``: kind, start, end (code points, end exclusive), novelty.

    Whole texts are scanned, one after another, in time and memory that grow with each text alone;
    NULL and empty texts have no spans. Ties of start go by kind. Repeated rows are scanned each by
    itself and agree; an empty table stays empty. A column named ``found`` is replaced.
    """
    others = [c for c in docs.columns if c != "found"]
    place, words = others.index("text"), identifiers()
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), f"found {SPANS}"])

    def scan(batches):
        novelty = Novelty(words)
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, len(b), BATCH)):
            found = [[] if not t else [dict(zip(("kind", "start", "end", "novelty"), s)) for s in spans_of(t, novelty, least, least_hex)] for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPAN_TYPE)], [*others, "found"])

    return arrow_pass(docs.select(*[f"`{c}`" for c in others]), scan, schema)
