"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from pyspark.sql import functions as F

from . import chat_trees, decontamination, infill, jaccard_join, license_scan, line_rules, mixing, oracles, quality_classifier, secret_scan, sharding, token_prefix, turn_repair, url_templates
from .shared import WORD, n_words, table

SHARDS = 40
TOKEN_LIMIT = 4096
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op1_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, quality_classifier.grades_of(table(spark, sf_dir, "labels")))
    return quality_classifier.scored(docs, model).select("doc_id", "expected_grade", "tail", "kept")


def op2_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_source_mix(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"), n_words(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_slot_sharding(spark, sf_dir):
    rows, _ = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op5_line_rules(spark, sf_dir):
    out = line_rules.clean(table(spark, sf_dir, "documents"), with_text=False)
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*first, *[c for c in out.columns if c not in first])


def op6_ngram_jaccard_join(spark, sf_dir):
    out = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


def op7_url_templates(spark, sf_dir):
    return url_templates.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_token_counts(spark, sf_dir):
    import public_tokenizers
    return token_prefix.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


def op9_benchmark_decontamination(spark, sf_dir):
    out = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("print")


def op10_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = "### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", "\\" + tricky), (-7, 1, "assistant", "\\" + tricky)], "conv_id long, turn long, role string, text string")
    chats = chat_trees.formatted(chat_trees.reply_chains(turns.unionByName(extra)))
    trained = F.transform(chat_trees.loss_spans(F.col("output")), lambda s: chat_trees.unescaped(F.substring(F.col("output"), s["start"] + 1, s["length"])))
    read = chats.select(F.col("tree_id").alias("conv_id"), chat_trees.turns_of(F.col("output")).alias("turns"), F.concat_ws("", trained).alias("learned"), F.length("output").cast("long").alias("formatted_chars"))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def op11_turn_repair(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.repaired(turn_repair.damaged(talks)).withColumnRenamed("conv_id", "found_id")
    every = talks.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in turn_repair.COUNTS]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_fill_in_middle(spark, sf_dir):
    out = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    again = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_secret_scan(spark, sf_dir):
    out = secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of_kind = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind, *_ in secret_scan.BASE]
    base = F.filter("found", lambda s: s["kind"] != secret_scan.NOVEL)
    return out.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_source_mix, op4_slot_sharding, op5_line_rules, op6_ngram_jaccard_join, op7_url_templates, op8_token_counts, op9_benchmark_decontamination, op10_chat_formatting,
                                 op11_turn_repair, op12_fill_in_middle, op13_secret_scan)}

SQL = {"op2_license_scan": oracles.OP2, "op3_source_mix": oracles.OP3, "op5_line_rules": oracles.OP5, "op6_ngram_jaccard_join": oracles.OP6,
       "op9_benchmark_decontamination": oracles.OP9, "op10_chat_formatting": oracles.OP10, "op12_fill_in_middle": oracles.OP12}
