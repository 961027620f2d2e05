"""Quality rules, line first (operator 5).

Every line is judged by itself: does it end like a sentence, is it navigation, has it a sign
for every word, is it boilerplate, does it repeat an earlier line. Lines that fail are taken out, and a document that loses more
than a set share of its words is rejected. The document counts that the rules start from are
taken from the whole text in the same pass, without a shuffle.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import WordHashes, arrow_pass, gram_hashes

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
MIN_WORDS, REPEAT_SHARE = 50, 50
#: Share of its words (percent) that a document may lose with its failing lines.
MOST_LOST = 40
#: What a sentence or a heading with a colon ends with.
ENDINGS = (".", "!", "?", ":", ";", "…", "\"", "'", ")", "]", "”", "’", "»", "。", "！", "？")
#: Signs between the entries of a menu or path of links.
SEPARATORS = "|>»·•/\\"
#: Phrases of page furniture, told by a line of at most SHORT words that has one.
BOILERPLATE = ("accept cookies", "all rights reserved", "click here", "enable javascript", "follow us", "log in", "lorem ipsum", "privacy policy",
               "read more", "share this", "sign in", "sign up", "subscribe to", "terms of service", "terms of use", "this site uses cookies", "view all")
SHORT = 15

_WORDS = WordHashes()
_SEPARATOR = re.compile(f"[{re.escape(SEPARATORS)}]")
_SYMBOL = re.compile(f"[{re.escape(SYMBOLS.decode())}]")
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))


def repeated_words(words: list) -> int:
    """Words inside 3-word windows found twice or more in the text."""
    if len(words) < 4:
        return 0
    _, inverse, counts = np.unique(gram_hashes(_WORDS.of(words), 3), return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i:i + len(again)] |= again
    return int(inside.sum())


def line_fault(line: str, n_words: int) -> str | None:
    """The first rule a line fails: navigation, symbols, boilerplate or punctuation; or none."""
    if len(_SEPARATOR.findall(line)) * 3 >= n_words > 1:
        return "navigation"
    if len(_SYMBOL.findall(line)) >= n_words > 1:
        return "symbols"
    if n_words <= SHORT and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if not line.rstrip().endswith(ENDINGS):
        return "punctuation"
    return None


def judged_lines(text: str) -> list[tuple[str, int, str | None]]:
    """Every line with a word: the line, its words, and the rule it fails."""
    seen, out = set(), []
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            out.append((line, n, "repeated" if line in seen else line_fault(line, n)))
            seen.add(line)
    return out


def clean(docs: DataFrame, with_text=True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, kept_words, one count a rule, and (``with_text``) cleaned: the lines left.

    ``base_failed``: under 50 words, or over half of them in repeated 3-word windows. ``kept``:
    not base_failed, and at most MOST_LOST percent of the words stand in failing lines. A NULL
    text is an empty one: no words, base_failed, not kept, cleaned is empty. Rows are judged one
    by one, so ids may be NULL or repeated; an empty table gives an empty table.
    """
    rules = ("navigation", "symbols", "boilerplate", "punctuation", "repeated")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", *(f"{r}_lines" for r in rules))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts) + (", cleaned string" if with_text else "")

    def scan(batches):
        for batch in batches:
            rows, texts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                raw = text.encode()
                words, lines = raw.split(), judged_lines(text)
                faults = [f for _, _, f in lines]
                rows.append((len(words), len(text) - len(raw) + len(raw.translate(None, BLANKS)), len(raw) - len(raw.translate(None, SYMBOLS)), faults.count("repeated"),
                             repeated_words(words), sum(n for _, n, f in lines if f is None), *(faults.count(r) for r in rules)))
                if with_text:
                    texts.append("\n".join(line for line, _, f in lines if f is None))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([pa.array(texts, pa.string())] if with_text else [])], ["doc_id", *counts, *(["cleaned"] if with_text else [])])

    out = arrow_pass(docs.select("doc_id", "text"), scan, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_SHARE)
    kept = ~failed & ((F.col("n_words") - F.col("kept_words")) * 100 <= F.col("n_words") * MOST_LOST)
    return out.withColumns({"base_failed": failed, "kept": kept})
