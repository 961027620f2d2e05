"""URL filters by a tree of path templates (operator 7): DataFrame operations only.

Paths are cut into segments. Segments that carry numbers or ids become wildcards, and so does the
child of a node that has very many different children. Then, from the leaves up, a branch whose
labelled rate does not differ from that of its siblings is merged with them. What remains is a
template; its purity is the share of good among its labelled pages, drawn towards the share of
all labelled pages, and templates of low purity are rejected.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .shared import LOWER, UPPER, stored

#: Levels that are worked before the table is stored again on the way down the tree, which has as many as its paths need.
DEPTH = 4
#: A node with more different children than this, most of them rare, has a wildcard for a child.
FAN_OUT, FAN_SHARE = 50, 0.5
#: Pseudo-pages of the prior, the z value that keeps a branch apart, and the purity a template needs.
PRIOR, APART, PURITY = 4.0, 1.96, 0.5


def host_of(url) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_column(host, path, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits; ``rules`` are (verdict, 'host/path')."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, tail = rule.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        out = F.when(fits, F.lit(value(verdict, rule))) if out is None else out.when(fits, F.lit(value(verdict, rule)))
    return out if out is not None else F.lit(None).cast("string")


def segment_shapes(path) -> Column:
    """Shapes of a path's segments: numbers and ids are wildcards; empty segments at the end are left out."""
    parts = F.slice(F.split(F.regexp_replace(path, r"/+\z", ""), "/"), 2, 2 ** 30)
    return F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"[0-9A-Fa-f]{16,}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "{id}"), r"[0-9]+", "{n}"))


def segment(k: int) -> Column:
    """The k-th segment; behind the last one empty."""
    return F.coalesce(F.get("segments", F.lit(k - 1)), F.lit(""))


def before(k: int) -> Column:
    """The segments before the k-th, with empty ones for those that are missing."""
    return F.concat(F.slice("segments", 1, k - 1), F.array_repeat(F.lit(""), F.lit(k - 1) - F.size("segments")))


def replaced(k: int, value) -> Column:
    return F.concat(before(k), F.array(value), F.slice("segments", k + 1, 2 ** 30))


def levels(nodes: DataFrame) -> int:
    """The deepest level at which a wildcard or a merging is possible.

    It needs a path that reaches the level and another one of the host that reaches the level
    above, so one path that is deeper than all others of its host by more adds nothing. In hosts
    with empty segments inside of paths a shorter path can stand for one that ends in such, so
    there every level counts.
    """
    depths = nodes.groupBy("host", F.size("segments").alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_contains("segments", "")).alias("gaps"))
    per = depths.groupBy("host").agg(F.max(F.struct("depth", "n")).alias("top"), F.max("gaps").alias("gapped"))
    below = depths.join(per, "host").filter(F.col("depth") < F.col("top.depth")).groupBy("host").agg(F.max("depth").alias("next"))
    last = F.when((F.col("top.n") > 1) | F.col("gapped"), F.col("top.depth")).otherwise(F.least("top.depth", F.coalesce("next", F.lit(-1)) + 1))
    return per.join(below, "host", "left").agg(F.max(last)).first()[0] or 0


def template_tree(pages: DataFrame) -> DataFrame:
    """From host, shapes, good (labelled pages: 1 or 0, else NULL) to a template for each (host, shapes).

    Gives host, shapes, template, labelled, n_good, pages. The tree holds one row for each
    different (host, shapes) with counts, so a host with a third of all pages is a few rows.
    Every segment is a level of its own, whatever the depth.
    """
    nodes = pages.groupBy("host", "shapes").agg(F.count(F.lit(1)).alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"))
    nodes = stored(nodes.withColumn("segments", F.col("shapes")), "url-nodes")
    deepest = levels(nodes)
    # down the tree: very many children, most of them rare, are one
    for k in range(1, deepest + 1):
        placed = nodes.withColumns({"parent": before(k), "child": segment(k)})
        children = placed.groupBy("host", "parent", "child").agg(F.sum("pages").alias("pages"))
        wide = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("kinds"), F.sum("pages").alias("total")).filter((F.col("kinds") > FAN_OUT) & (F.col("kinds") > F.col("total") * FAN_SHARE))
        placed = placed.join(wide.select("host", "parent", F.lit(True).alias("wide")), ["host", "parent"], "left")
        nodes = placed.withColumn("segments", F.when(F.coalesce("wide", F.lit(False)) & (F.col("child") != ""), replaced(k, F.lit("*"))).otherwise(F.col("segments"))).drop("parent", "child", "wide")
        if k % DEPTH == 0 or k == deepest:
            nodes = stored(nodes, "url-nodes")
    prior = nodes.agg((F.sum("n_good") / F.sum("labelled")).alias("p")).select(F.coalesce("p", F.lit(1.0)))
    p = float(prior.first()[0])
    # up the tree: branches that do not differ from their siblings are merged
    for k in reversed(range(1, deepest + 1)):
        placed = nodes.withColumns({"around": replaced(k, F.lit("")), "child": segment(k)})
        branch = placed.groupBy("host", "around", "child").agg(F.sum("labelled").alias("n"), F.sum("n_good").alias("g"))
        family = branch.groupBy("host", "around").agg(F.sum("n").alias("all_n"), F.sum("g").alias("all_g"), F.count(F.lit(1)).alias("kinds"))
        rest_n = F.col("all_n") - F.col("n") + PRIOR
        rest_g = F.col("all_g") - F.col("g") + PRIOR * p
        pooled = (F.col("g") + rest_g) / (F.col("n") + rest_n)
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / rest_n))
        differs = (F.col("n") > 0) & (F.abs(F.col("g") / F.nullif("n", F.lit(0)) - rest_g / rest_n) > APART * error)
        merged = branch.join(family, ["host", "around"]).filter((F.col("kinds") > 1) & (F.col("child") != "") & ~F.coalesce(differs, F.lit(False))).select("host", "around", "child", F.lit(True).alias("merged"))
        placed = placed.join(merged, ["host", "around", "child"], "left")
        nodes = stored(placed.withColumn("segments", F.when(F.coalesce("merged", F.lit(False)), replaced(k, F.lit("*"))).otherwise(F.col("segments"))).drop("around", "child", "merged"), "url-nodes")
    shown = F.filter("segments", lambda s: s != "")
    nodes = nodes.withColumn("template", F.when(F.size(shown) > 0, F.concat_ws("/", F.col("host"), F.array_join(shown, "/"))).otherwise(F.col("host")))
    own = nodes.groupBy("template").agg(F.sum("labelled").alias("labelled"), F.sum("n_good").alias("n_good"), F.sum("pages").alias("pages"))
    own = own.withColumn("purity", (F.col("n_good") + PRIOR * p) / (F.col("labelled") + PRIOR))
    return nodes.select("host", "shapes", "template").join(own, "template")


def judge(pages: DataFrame, rules) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    The verdict is that of the longest rule that fits, else that of the page's template: block
    if its smoothed purity is under PURITY. Pages that a rule judges are the labelled ones. A
    NULL url, or one without ``://``, has an empty host and path, and the template of that
    host. With nothing labelled every template has purity 1. Rows are judged one by one, ids may
    be NULL or repeated; an empty table gives an empty table.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rows = rows.select("*", rule_column(F.col("host"), F.col("path"), rules, lambda v, r: r).alias("rule"), rule_column(F.col("host"), F.col("path"), rules, lambda v, r: v).alias("ruled"), segment_shapes(F.col("path")).alias("shapes"))
    rows = stored(rows, "url-rows")
    tree = stored(template_tree(rows.select("host", "shapes", F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0).alias("good"))), "url-templates")
    out = rows.join(tree.select("host", "shapes", "template", "purity"), ["host", "shapes"])
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= PURITY, F.lit("allow")).otherwise(F.lit("block")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
