"""Benchmark decontamination by a prefix-filtered set join (operator 9): DataFrame operations only.

A benchmark item is the set of its windows of 13 words. A window occurs in a document only if
all its shingles (runs of 3 words) do, so one of them, chosen freely, is a necessary prefix:
the join asks for the window's rarest shingle over all documents. What matches is bounded by
position (the window must lie inside the document) and then verified word for word.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import free_names, lower_ascii, release, stored, words_of

WINDOW, SHINGLE = 13, 3
#: What separates the words of documents and items: ASCII but letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct shingles of a benchmark up to which they are sent to every executor (16 bytes each).
BROADCAST_ROWS = 1_000_000


def words(text) -> Column:
    return words_of(lower_ascii(text), SEPARATOR)


def fingerprint(text) -> Column:
    """Tells apart rows that share an id; rows equal in id and text get equal answers."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle(ws: str, at: str) -> Column:
    """Hash of the words at..at+SHINGLE-1 of an array; runs past the end are shorter."""
    return F.xxhash64(*[F.get(ws, F.col(at) + i) for i in range(SHINGLE)])


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window_id, gram: their words), and which items have them.

    Items of fewer words than a window, but not none, are one window; NULL texts have none.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - WINDOW + 1)))
    spans = items.select("item_id", "ws", starts.alias("start")).select("item_id", F.slice("ws", F.col("start"), WINDOW).alias("gram"))
    spans = stored(spans.distinct().withColumn("window_id", F.sha2(F.concat_ws(" ", "gram"), 256)), "bench-windows")
    return spans.select("window_id", "gram").dropDuplicates(["window_id"]), spans.select("window_id", "item_id").distinct()


def sized(df: DataFrame, bound=BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table of narrow rows if it is counted to be within the bound."""
    return F.broadcast(df) if df.count() <= bound else df


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Each window's rarest shingle over all documents: window_id, gram, token, offset.

    Windows of fewer words than a shingle have one shorter run. Rarity is the number of times a
    shingle stands in the documents; ties go to the earlier offset.
    """
    places = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("gram") - SHINGLE)))
    grams = windows.select("window_id", "gram", places.alias("offset"))
    grams = stored(grams.withColumn("token", F.when(F.size("gram") >= SHINGLE, shingle("gram", "offset"))), "bench-shingles")
    tokens = stored(grams.filter("token is not null").select("token").distinct(), "bench-tokens")
    seen = docs.select(words(F.col("text")).alias("ws")).select("ws", F.posexplode("ws").alias("at", "w"))
    seen = seen.filter(F.col("at") <= F.size("ws") - SHINGLE).select(shingle("ws", "at").alias("token"))
    counts = seen.join(sized(tokens), "token").groupBy("token").count()
    rare = Window.partitionBy("window_id").orderBy(F.coalesce("count", F.lit(0)), "offset")
    ranked = grams.join(counts, "token", "left").withColumn("nth", F.row_number().over(rare)).filter("nth = 1")
    return stored(ranked.select("window_id", "gram", "token", "offset"), "bench-prefixes")


def occurrences(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Verified occurrences: doc_id, print, window_id, start, length.

    Windows shorter than a shingle are matched by their first word, all others by their prefix
    shingle; both only where the window fits into the document.
    """
    rows = docs.select("doc_id", fingerprint(F.col("text")).alias("print"), words(F.col("text")).alias("ws"))
    each = rows.select("doc_id", "print", "ws", F.posexplode("ws").alias("at", "w"))
    parts = []
    full = chosen.filter("token is not null")
    short = chosen.filter("token is null").select("window_id", "gram", F.get("gram", F.lit(0)).alias("w0"), "offset")
    keys = stored(full.select("token", "offset", "window_id", F.size("gram").alias("length")), "bench-keys")
    hits = each.filter(F.col("at") <= F.size("ws") - SHINGLE).withColumn("token", shingle("ws", "at")).join(sized(keys), "token")
    hits = hits.withColumn("start", F.col("at") - F.col("offset")).filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("ws")))
    parts.append(hits.select("doc_id", "print", "window_id", "start", "length", F.slice("ws", F.col("start") + 1, F.col("length")).alias("found")))
    short = stored(short, "bench-short")
    if not short.isEmpty():
        near = each.join(sized(short), F.col("w") == F.col("w0")).filter(F.col("at") + F.size("gram") <= F.size("ws"))
        parts.append(near.select("doc_id", "print", "window_id", F.col("at").alias("start"), F.size("gram").alias("length"), F.slice("ws", F.col("at") + 1, F.size("gram")).alias("found")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # the id of a window is the digest of its words, so equal digests are equal words
    return found.filter(F.sha2(F.concat_ws(" ", "found"), 256) == F.col("window_id")).select("doc_id", "print", "window_id", "start", "length")


def hit_words(spans: DataFrame) -> DataFrame:
    """Words inside any occurrence, per document: the length of the union of its spans."""
    order = Window.partitionBy("doc_id", "print").orderBy("start", "length")
    before = F.coalesce(F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", before))
    single = spans.groupBy("doc_id", "print", "start").agg(F.max("length").alias("length"))
    return single.withColumn("fresh", fresh).groupBy("doc_id", "print").agg(F.sum("fresh").cast("long").alias("n_hit"))


def scan(docs: DataFrame, benchmark: DataFrame, share=20) -> DataFrame:
    """Per row of ``docs``: doc_id, print, n_words, n_hit, n_items, items_sha256, contaminated.

    Contaminated: hit words are at least one in ``share`` of the words. Rows are told apart by
    id and text, so repeated ids are judged by their own texts and repeated rows get equal
    answers. A NULL id is an id like others, a NULL text has no words and is clean. An empty
    benchmark leaves every document clean; no documents give an empty table.
    """
    windows, members = item_windows(benchmark)
    spans = stored(occurrences(docs, prefixes(docs, windows)).distinct(), "bench-hits")
    items = spans.select("doc_id", "print", "window_id").distinct().join(members, "window_id")
    items = items.groupBy("doc_id", "print").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    hits = hit_words(spans).alias("h").join(items.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.print") == F.col("i.print")))
    hits = hits.select(F.col("h.doc_id").alias("hit_doc"), F.col("h.print").alias("hit_print"), "n_hit", F.sort_array("items").alias("items"))
    rows = docs.select("doc_id", fingerprint(F.col("text")).alias("print"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("print") == F.col("hit_print")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "print", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
                      ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, share=20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    NULL and empty texts are clean; long texts are judged whole; rows that repeat share their
    verdict. The names of other columns are free: those used in between are chosen beside them.
    """
    windows, _ = item_windows(benchmark)
    spans = stored(occurrences(docs, prefixes(docs, windows)).distinct(), "bench-hits")
    mark, size, of, met, hit = free_names(docs.columns, "bench_mark", 5)
    # stored, so that Spark knows its size when it chooses the join
    hits = stored(hit_words(spans).select(F.col("doc_id").alias(of), F.col("print").alias(met), F.col("n_hit").alias(hit)), "bench-marked")
    marked = docs.withColumn(mark, fingerprint(F.col("text"))).withColumn(size, F.size(words(F.col("text"))))
    on = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(mark) == F.col(met)) & (F.col(hit) * share >= F.col(size))
    release(spans)
    return marked.join(hits, on, "left_anti").select(*[f"`{c}`" for c in docs.columns])
