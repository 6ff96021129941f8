"""URL verdicts from a tree of path templates.

A url's path is a chain of segments below its host. Segments that vary (numbers in them, or values too rare among
their siblings) become wildcards, so that the paths of a host fold into few templates. The tree grows level by level,
as deep as paths are, where a node has rows enough for another literal below it. Each node counts its rows and its
labelled rows. A branch whose labelled share of blocked rows does not differ from its siblings' is
merged into its parent, and so is one without labelled rows; one that differs stands for itself, smoothed towards its
parent. A template is rejected where the share that results is high enough; a host without labelled rows decides nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, only, written

#: A segment is a literal if at least so many rows and this share of its siblings' rows have it.
LITERAL_ROWS, LITERAL_SHARE = 3, 0.02
#: Pseudo-rows that a branch takes from its parent, and the significance that keeps branches apart.
SMOOTH, DIFFER = 2.0, 1.96
#: Smoothed share of blocked rows from which a template is rejected.
REJECT = 0.8
Rule = tuple[str, str, str]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the
    end. Both are empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest (verdict, host, path) rule that fits host, its subdomains and the path; else null.

    The rules stand in the plan: a list short enough to be read by a person. Of equally long ones the first wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the last that fits decides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shape(path: Column) -> Column:
    """The path's segments with their digits as `#`."""
    return F.regexp_replace(F.array_join(F.filter(F.split(path, "/", -1), lambda x: x != ""), "/"), "[0-9]+", "#")


def template_tree(urls: DataFrame) -> DataFrame:
    """host, shape, template, labelled, purity for the distinct hosts and shapes of urls (host, path, label).

    label is block, allow or null. shape is the path with its digits as `#`; purity is the smoothed share of blocked
    rows of the template's branch and labelled the labelled rows that it rests on, be they of a branch above. Each level
    of the tree is one round; a node with fewer than LITERAL_ROWS rows, which can have no literal below it, is not cut
    further and is the template of all its rows. Nulls are empty; an empty table has no rows; other columns are ignored.
    """
    blocked, known = (F.col("label") == "block"), F.col("label").isNotNull()
    host = F.coalesce("host", F.lit(""))
    rows = urls.groupBy(host.alias("host"), _shape(F.coalesce("path", F.lit(""))).alias("shape")).agg(F.count("*").alias("rows"), F.count_if(known).alias("labelled"), F.count_if(blocked).alias("blocked"))
    rows = written(rows, "shapes")
    segments = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/", -1))
    grown = rows.select("host", "shape", "rows", segments.alias("segments"), F.col("host").alias("node"), F.array(F.xxhash64("host")).alias("chain"))
    level, done, old = 0, [], None
    while True:
        enough = grown.where(F.size("segments") > level).groupBy("node").agg(F.sum("rows").alias("among")).where(F.col("among") >= LITERAL_ROWS)
        enough = written(enough, "enough")
        done.append(written(only(grown, enough.withColumn("deeper", F.lit(True)), "node", "left", "shape").where((F.size("segments") <= level) | F.col("deeper").isNull()).select("host", "shape", "node", "chain"), "templates"))
        if enough.isEmpty():
            dropped(enough, *([old] if old else []))
            break
        open_ = only(grown.where(F.size("segments") > level), enough, "node", "inner", "shape").withColumn("segment", F.get("segments", F.lit(level)))
        each = open_.groupBy("node", "segment").agg(F.sum("rows").alias("here"), F.first("among").alias("among"))
        literal = each.where((F.col("here") >= LITERAL_ROWS) & (F.col("here") >= LITERAL_SHARE * F.col("among"))).select("node", "segment", F.lit(True).alias("literal"))
        open_ = only(open_, literal, ["node", "segment"], "left", "shape")
        varied = F.regexp_replace(F.regexp_replace("segment", r"[^.#_-]*#[^.]*", "#"), r"#+", "#")
        name = F.when(F.col("literal"), F.col("segment")).when(F.col("segment").contains("#"), varied).otherwise("*")
        node = F.concat_ws("/", "node", name)
        now = written(open_.select("host", "shape", "rows", "segments", node.alias("node"), F.concat("chain", F.array(F.xxhash64(node))).alias("chain")), "tree")
        dropped(enough, *([old] if old else []))
        grown, old, level = now, now, level + 1
    tree = reduce(DataFrame.unionByName, done)

    at = rows.where("labelled > 0").join(tree, ["host", "shape"]).select(F.explode("chain").alias("at"), "labelled", "blocked")
    nodes = at.groupBy("at").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    steps = tree.select("node", "chain").distinct().select("node", F.posexplode("chain").alias("level", "at"))
    steps = steps.join(nodes, "at", "left").select("node", "level", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("blocked", F.lit(0)).alias("blocked"))
    steps = steps.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("level", "labelled", "blocked"))).alias("steps"))  # one a level

    def step(r, x):
        n, b = x["labelled"].cast("double"), x["blocked"].cast("double")
        others, share = r["n"] - n, (r["b"] + 1e-9) / F.greatest(r["n"], F.lit(1.0))
        gap = b / F.greatest(n, F.lit(1.0)) - (r["b"] - b) / F.greatest(others, F.lit(1.0))
        error = F.sqrt(F.greatest(share * (1 - share), F.lit(0.0)) * (1 / F.greatest(n, F.lit(1.0)) + 1 / F.greatest(others, F.lit(1.0))))
        apart = (n > 0) & (others > 0) & (F.abs(gap) > DIFFER * error)
        own = (b + SMOOTH * r["purity"]) / (n + SMOOTH)
        stands = apart | (x["level"] == 0)
        return F.struct(n.alias("n"), b.alias("b"), F.when(stands, own).otherwise(r["purity"]).alias("purity"), F.when(stands, n).otherwise(r["rests"]).alias("rests"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("b"), F.lit(0.5).alias("purity"), F.lit(0.0).alias("rests"))
    judged = steps.select("node", F.aggregate("steps", start, step).alias("r"))
    out = written(tree.join(judged, "node").select("host", "shape", F.col("node").alias("template"), F.col("r.rests").cast("long").alias("labelled"), F.col("r.purity").alias("purity")), "judged")
    dropped(rows, *done)
    return out


def judged_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, template, labelled, purity,
    decided_by (rule, tree, or null where nothing is known of the host).

    A rule that fits decides; elsewhere the template tree does, learned from the rows that rules label (and from
    labels, a table of page_id and label, where given). Nulls, urls without `://` and repeated rows get a verdict like
    any other; a host without labelled rows is allowed. Extra columns are ignored; an empty table has no rows.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("by", longest_rule(F.col("host"), F.col("path"), rules))
    learn = rows.withColumn("label", F.col("by.verdict"))
    if labels is not None:
        given = labels.select(F.col(key), F.col("label").alias("given"))
        learn = learn.join(given, key, "left").withColumn("label", F.coalesce("label", "given"))
    tree = template_tree(learn.select("host", "path", "label"))
    out = only(rows.withColumn("shape", _shape(F.col("path"))), tree, ["host", "shape"], "left", key)
    verdict = F.coalesce(F.col("by.verdict"), F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    decided = F.when(F.col("by").isNotNull(), "rule").when(F.col("labelled") > 0, "tree")
    return out.select(F.col(key), "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "template", "labelled", "purity", decided.alias("decided_by"))
