"""The queries of the training-data operators against plain Python, on a small table of hard rows and on given data."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sunward.llm import catalog

from brute_force import WORDS, bench_words, contamination, grams, item_windows, linked, low


def answers(spark, folder, name):
    return [r.asDict() for r in next(f for n, f in catalog.QUERIES.items() if n.startswith(f"{name}_"))(spark, folder).collect()]


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_empty_tables_give_empty_or_constant_results(spark, empty, name):
    rows = catalog.QUERIES[name](spark, empty).collect()
    assert len(rows) == (1 if name.startswith("op10_") else 0)


def test_op3_mix(spark, folder):
    rows, docs = answers(spark, folder, "op3"), documents(spark, folder)
    size = {d.doc_id: len(WORDS.findall(d.text or "")) for d in docs}
    of = {d.doc_id: d.source for d in docs}
    per = Counter()
    for d in docs:
        per[d.source] += size[d.doc_id]
    names = sorted((s for s in per if s is not None), key=lambda s: s) + [None] * (None in per)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(per.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * per[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * per[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    taken = Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[of[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[of[r["doc_id"]]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    for s in per:
        assert abs(taken[s] - target[s]) <= 1.0, s
    assert sorted(map(str, rows)) == sorted(map(str, answers(spark, folder, "op3")))


def test_op4_shards(spark, folder):
    rows, docs = answers(spark, folder, "op4"), {d.doc_id: d for d in documents(spark, folder)}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    places, load = defaultdict(list), Counter()
    for r in rows:
        text = (docs[r["doc_id"]].text or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text)
        assert 0 <= r["shard"] < 40 and r["law"] == "bytes" and r["grown_shard"] is None
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) <= sum(load.values()) / 40 * 1.01 + max(r["size"] for r in rows)


def test_op8_token_counts(spark, folder):
    import public_tokenizers
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = {d.doc_id: d.text or "" for d in documents(spark, folder)}
    rows = answers(spark, folder, "op8")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
        assert len(library.encode(text[:r["fit_chars"]])) <= 4096
        assert n <= 4096 and r["fit_chars"] == len(text) or len(library.encode(text[:r["fit_chars"] + 1])) > 4096


def test_op9_contamination(spark, folder):
    windows = item_windows(spark, folder)
    docs = {d.doc_id: d.text for d in documents(spark, folder)}
    rows = answers(spark, folder, "op9")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        n, hit, items = contamination(docs[r["doc_id"]], windows)
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(items), digest, hit > 0 and 20 * hit >= n), r
    assert any(r["contaminated"] for r in rows)


def test_op10_chat(spark, folder):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        talks[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    tricky = "\\### Assistant: </turn> ok"
    talks[-7] = [(0, "user", tricky), (1, "assistant", tricky)]
    rows = answers(spark, folder, "op10")
    assert sorted(r["conv_id"] for r in rows) == sorted(talks)
    for r in rows:
        turns = sorted(talks[r["conv_id"]])
        told = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest(), r
        assert r["loss_chars"] == len(learned) and r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert r["formatted_chars"] >= len(told)


def test_op6_components(spark, folder):
    docs = documents(spark, folder)
    sets = [grams(d.text) for d in docs]
    least = {}
    for d, r in zip(docs, linked(sets)):
        least[r] = min(least.get(r, d.doc_id), d.doc_id)
    want = sorted((d.doc_id, len(s), least[r]) for d, s, r in zip(docs, sets, linked(sets)))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in answers(spark, folder, "op6")) == want
    assert len({w[2] for w in want}) < len(want)


def test_op5_rules(spark, folder):
    docs = {d.doc_id: d.text or "" for d in documents(spark, folder)}
    rows = answers(spark, folder, "op5")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        ws = WORDS.findall(text)
        three = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
        inside = {j for i in range(len(ws) - 2) if three[tuple(ws[i:i + 3])] > 1 for j in range(i, i + 3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            dup += bool(WORDS.search(line)) and line in seen
            seen.add(line)
        failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed), r
        assert not (r["kept"] and failed)


def test_op7_rules_and_parts(spark, folder):
    from sunward.llm.catalog import URL_RULES
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    want = []
    for p in pages:
        host, path = "", ""
        if p.url and "://" in p.url:
            rest = p.url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = low(host)
        fits = [(len(r), v, r) for v, r in URL_RULES for h, _, t in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + t)]
        want.append((p.page_id, host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None))
    rows = answers(spark, folder, "op7")
    key = lambda x: (x[0], x[2])
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in rows), key=key)
    assert got == sorted(want, key=key)
    assert {r["verdict"] for r in rows} <= {"allow", "block"}


def test_op2_licences(spark, folder):
    from sunward.llm.license_scan import TEMPLATES, THRESHOLD
    bag = lambda ws: Counter(zip(ws, ws[1:]))
    known = [(name, bag(bench_words(text))) for name, text in TEMPLATES]
    docs = {d.doc_id: d.text or "" for d in documents(spark, folder)}
    rows = answers(spark, folder, "op2")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        text, best = docs[r["doc_id"]], {}
        for part in {text, *re.split(r"\n[\x20\x09-\x0D]*\n", text), *text.split("\n")}:
            own = bag(bench_words(part))
            for name, other in known:
                both = 2 * sum((own & other).values())
                if own and both * 100 >= THRESHOLD * (own.total() + other.total()):
                    best[name] = max(best.get(name, 0), both / (own.total() + other.total()))
        top = min(((-v, k) for k, v in best.items()), default=(None, None))
        assert (r["license"], r["n_licenses"]) == (top[1], len(best)) and (r["dice"] is None if top[0] is None else r["dice"] == pytest.approx(-top[0])), r


def test_op1_hard_rows(spark, data):
    rows = {r["doc_id"]: r for r in answers(spark, data, "op1")}
    docs = {d.doc_id: d.text for d in documents(spark, data)}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        if not (docs[i] or "").strip(" \t\n"):
            assert (r["expected_grade"], r["tail"], r["kept"]) == (0.0, 0.0, False)
        else:
            assert 0 <= r["tail"] <= 1 and r["kept"] == (r["tail"] >= 0.5)
    assert rows[1] == {**rows[2], "doc_id": 1}


def url_verdicts(urls, rules):
    """The template tree by loops: {(host, shapes): (template, purity)}."""
    from sunward.llm import url_templates as U

    def shapes(path):
        parts = path.split("/")[1:]
        deep = parts[:U.DEPTH - 1] + (["/".join(parts[U.DEPTH - 1:])] if len(parts) >= U.DEPTH else [])
        deep = [re.sub(r"[0-9]+", "{n}", re.sub(r"[0-9A-Fa-f]{16,}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "{id}", s)) for s in deep]
        return tuple(deep + [""] * (U.DEPTH - len(deep)))

    stats = defaultdict(lambda: [0, 0, 0])
    for host, path, verdict in urls:
        s = stats[host, shapes(path)]
        s[0] += 1
        s[1] += verdict is not None
        s[2] += verdict == "allow"
    now = {k: list(k[1]) for k in stats}
    for k in range(U.DEPTH):
        kinds = defaultdict(Counter)
        for key, seg in now.items():
            kinds[key[0], tuple(seg[:k])][seg[k]] += stats[key][0]
        for key, seg in now.items():
            own = kinds[key[0], tuple(seg[:k])] if seg[k] else {}
            if len(own) > U.FAN_OUT and len(own) > own.total() * U.FAN_SHARE:
                seg[k] = "*"
    good, labelled = sum(s[2] for s in stats.values()), sum(s[1] for s in stats.values())
    p = good / labelled if labelled else 1.0
    for k in reversed(range(U.DEPTH)):
        branch = defaultdict(lambda: [0, 0])
        for key, seg in now.items():
            b = branch[key[0], tuple(seg[:k] + seg[k + 1:]), seg[k]]
            b[0] += stats[key][1]
            b[1] += stats[key][2]
        family = defaultdict(dict)
        for (host, around, own), b in branch.items():
            family[host, around][own] = b
        merged = set()
        for (host, around), members in family.items():
            for own, (n, g) in members.items():
                rest_n = sum(b[0] for b in members.values()) - n + U.PRIOR
                rest_g = sum(b[1] for b in members.values()) - g + U.PRIOR * p
                pooled = (g + rest_g) / (n + rest_n)
                differs = n > 0 and abs(g / n - rest_g / rest_n) > U.APART * (pooled * (1 - pooled) * (1 / n + 1 / rest_n)) ** 0.5
                if len(members) > 1 and own and not differs:
                    merged.add((host, around, own))
        for key, seg in now.items():
            if (key[0], tuple(seg[:k] + seg[k + 1:]), seg[k]) in merged:
                seg[k] = "*"
    total = defaultdict(lambda: [0, 0])
    name = {key: key[0] + "".join(f"/{s}" for s in seg if s) for key, seg in now.items()}
    for key in now:
        total[name[key]][0] += stats[key][1]
        total[name[key]][1] += stats[key][2]
    return {key: (name[key], (total[name[key]][1] + U.PRIOR * p) / (total[name[key]][0] + U.PRIOR)) for key in now}, shapes


def test_op7_templates(spark, folder):
    from sunward.llm.url_templates import PURITY
    rows = answers(spark, folder, "op7")
    want, shapes = url_verdicts([(r["host"], r["path"], r["verdict"] if r["rule"] else None) for r in rows], None)
    for r in rows:
        template, purity = want[r["host"], shapes(r["path"])]
        assert r["template"] == template and r["purity"] == pytest.approx(purity), r
        assert r["rule"] or r["verdict"] == ("allow" if purity >= PURITY else "block")
