"""URL filters by a path-template tree. DataFrame functions only.

Urls are parsed to host and path, path segments get a lexical class (numbers, hex, dates, mixed
identifiers, with their extension), and equal shapes of a host are counted once. Then, level by level
and for each node (host, template so far):

1. a segment is variable if its branch has less than a share or a least count of the node's urls while
   the node branches widely; variable segments become ``*``;
2. literal branches with LEAST_LABELS labelled urls or more are compared in the order of their rates of bad
   urls: a branch joins the one before it if it differs from none of the branches that this has joined (two-proportion
   z test, each pair by itself), and the joined ones become ``(a|b)``. Branches without that evidence stay apart.

A template's purity is the smoothed rate of good labels, (good + strength * prior) / (labels +
strength); a template is rejected if it is under the threshold. Fixed rules (host suffix and path
prefix, the longest wins) come before the method.

Scale. All steps after the first aggregation work on shapes, which are far fewer than urls, with the
segment among the grouping keys, so that a host with a third of all urls is spread over tasks. Levels
are cut by checkpoints. What all shapes of a node have in common is passed in one step, and a shape leaves the tree
where it ends, so there are as many steps as a path has nodes that branch, however long it is.
What is compared at a node is bounded: fewer branches than WIDE, or those with a share of LEAST_SHARE. Verdicts
are joined back on (host, shape).

Cases: a null url, or one without ``://``, has an empty host and path and the template of the empty
path; an empty path is the template ``/``; ties in rule length can't both match, branches of one rate are
taken in the order of their names; repeated rows count as urls and give repeated results; a page with several
labels counts as bad if any is; a null page_id has no label; very long urls are read whole; extra columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii

# Fixed values: (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
WIDE = 12  # children from which a node may have variable segments
LEAST_SHARE = 0.02
LEAST_COUNT = 5
LEAST_LABELS = 5
Z = 2.58
STRENGTH = 8.0
THRESHOLD = 0.5


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.col(url).cast("string")
    at = F.instr(u, "://")
    after = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    return pages.withColumn("host", lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))).withColumn("path", F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule string, its verdict) of the longest rule that fits host and path, else null."""
    rule = verdict = F.lit(None).cast("string")
    for said, host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(host + prefix)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The lexical classes of a path's segments."""
    raw = F.filter(F.split(path, "/"), lambda s: s != "")

    def kind(s: Column) -> Column:
        stem = F.regexp_replace(s, r"\.[A-Za-z0-9]{1,5}$", "")
        ext = lower_ascii(F.regexp_extract(s, r".(\.[A-Za-z0-9]{1,5})$", 1))
        return (
            F.when(s.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.lit("{date}"))
            .when(stem.rlike(r"^\d+$"), F.concat(F.lit("{n}"), ext))
            .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike(r"\d"), F.concat(F.lit("{hex}"), ext))
            .when(stem.rlike(r"\d") & (F.length(stem) >= 12), F.concat(F.lit("{id}"), ext))
            .otherwise(s)
        )

    return F.transform(raw, kind)


def alike(branches: DataFrame, z: float = Z) -> DataFrame:
    """branches(host, template, seg, bl, bb) -> host, template, seg, merged: the name of those that are joined."""
    rate = F.col("bb") / F.col("bl")
    listed = branches.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct(rate.alias("rate"), "seg", "bl", "bb"))).alias("all"))

    def differ(x: Column, y: Column) -> Column:
        pooled = (x["bb"] + y["bb"]) / (x["bl"] + y["bl"])
        spread = F.sqrt(pooled * (1 - pooled) * (1 / x["bl"] + 1 / y["bl"]))
        return F.abs(x["rate"] - y["rate"]) > F.lit(z) * spread

    one = "struct<rate:double,seg:string,bl:bigint,bb:bigint>"

    def step(groups: Column, x: Column) -> Column:
        last = F.element_at(groups, -1)
        fits = (F.size(groups) > 0) & ~F.exists(last, lambda y: differ(x, y))
        grown = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.concat(last, F.array(x))))
        return F.when(fits, grown).otherwise(F.concat(groups, F.array(F.array(x)))).cast(f"array<array<{one}>>")

    joined = listed.select("host", "template", F.explode(F.aggregate(F.col("all").cast(f"array<{one}>"), F.array().cast(f"array<array<{one}>>"), step)).alias("members"))
    several = joined.filter(F.size("members") > 1).select("host", "template", F.array_sort(F.transform("members", lambda x: x["seg"])).alias("names"))
    return several.select("host", "template", F.explode("names").alias("seg"), F.concat(F.lit("("), F.array_join("names", "|"), F.lit(")")).alias("merged"))


def templates(shapes: DataFrame, wide: int = WIDE, share: float = LEAST_SHARE, least: int = LEAST_COUNT, least_labels: int = LEAST_LABELS, z: float = Z) -> DataFrame:
    """shapes(host, segs, n, labels, bad) -> the same with template."""
    columns, node = ["host", "segs", "n", "labels", "bad", "template"], ["host", "template"]
    tree, done = cut(shapes.withColumns({"template": F.lit(""), "rest": F.col("segs")})), []
    while not tree.isEmpty():
        # what the rests of all shapes of a node begin with is what the first and the last of them do
        same = F.array_position(F.zip_with(F.min("rest"), F.max("rest"), lambda x, y: x.eqNullSafe(y)), False)
        shared = tree.groupBy(*node).agg(F.when(same == 0, F.size(F.min("rest"))).otherwise(same - 1).cast("int").alias("shared"))
        path = F.concat("template", F.lit("/"), F.array_join(F.slice("rest", F.lit(1), F.col("shared")), "/"))
        moved = tree.join(shared, node).withColumns({"template": F.when(F.col("shared") > 0, path).otherwise(F.col("template")), "seg": F.get("rest", F.col("shared"))})
        keyed = cut(moved.withColumn("rest", F.slice("rest", F.col("shared") + 2, F.size("rest"))).drop("shared"))
        branches = keyed.filter("seg is not null").groupBy(*node, "seg").agg(F.sum("n").alias("bn"), F.sum("labels").alias("bl"), F.sum("bad").alias("bb"))
        nodes = branches.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("bn").alias("nn"))
        b = branches.join(nodes, node)
        variable = (F.col("children") >= wide) & ((F.col("bn") < least) | (F.col("bn") < share * F.col("nn")))
        proven = (F.col("children") > 1) & ~variable & ~F.col("seg").startswith("{") & (F.col("bl") >= least_labels)
        named = b.join(alike(b.filter(proven), z), [*node, "seg"], "left").select(*node, "seg", F.when(variable, "*").otherwise(F.coalesce("merged", "seg")).alias("branch"))
        done.append(keyed.filter("seg is null").select(*columns))
        tree = cut(
            keyed.filter("seg is not null").join(named, [*node, "seg"]).select(*columns[:-1], F.concat("template", F.lit("/"), "branch").alias("template"), "rest")
        )
    out = done[0] if done else tree
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template")))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, strength: float = STRENGTH, threshold: float = THRESHOLD) -> DataFrame:
    """pages(page_id, url), labels(page_id, bad boolean) -> page_id, host, path, rule, verdict, template, purity, labelled.

    labelled and purity are those of the template.
    """
    marks = labels.filter("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = parsed(pages.select("page_id", "url")).join(marks, "page_id", "left")
    rows = rows.select("page_id", "host", "path", "bad", segments(F.col("path")).alias("segs"))
    shapes = cut(rows.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labels"), F.count_if("bad").alias("bad")))
    total = shapes.agg(F.sum("labels"), F.sum("bad")).first()
    prior = 1 - (total[1] / total[0] if total[0] else 0.0)
    tree = templates(shapes)
    per = tree.groupBy("host", "template").agg(F.sum("labels").alias("labelled"), F.sum("bad").alias("bad"))
    per = per.withColumn("purity", (F.col("labelled") - F.col("bad") + strength * prior) / (F.col("labelled") + strength)).drop("bad")
    known = tree.select("host", "segs", "template").join(per, ["host", "template"])
    rule, said = rule_columns(rules)
    out = rows.drop("bad").join(known, ["host", "segs"], "left")
    method = F.when(F.col("purity") < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "template", F.round("purity", 6).alias("purity"), "labelled")


def op1(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels are those of the document that the last number in a url's path names: bad if toxic or of low quality."""
    number = F.expr("try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) as bigint)")
    named = parsed(pages.select("page_id", "url")).select("page_id", number.alias("doc_id"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = named.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return judge(pages, marks)
