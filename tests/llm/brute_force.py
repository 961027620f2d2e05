"""Plain Python versions of what several tests compare with."""

import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")



def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def contamination(text, windows):
    ws = bench_words(text)
    hit, items = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(ws) - n + 1):
            for item in windows.get(tuple(ws[i:i + n]), ()):
                items.add(item)
                hit.update(range(i, i + n))
    return len(ws), len(hit), items


def item_windows(spark, folder):
    windows = defaultdict(set)
    for b in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        ws = bench_words(b.text)
        for i in range(max(1, len(ws) - 12) if ws else 0):
            windows[tuple(ws[i:i + 13])].add(b.item_id)
    return windows


def grams(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def linked(sets):
    """Components by comparing all pairs that share a gram; ids to their least id."""
    root = {i: i for i in range(len(sets))}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            lists[g].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in lists[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]
