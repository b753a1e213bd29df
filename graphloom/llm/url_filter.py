"""URL filter: site rules first, then a path-template tree learnt from labelled urls.

Rules are (host suffix, path prefix, verdict); a rule fits its host and all subdomains if the path starts with its prefix, and the longest
fitting rule wins (host and path together; block before allow when equally long).

Tree. A path's segments become general by class: numbers, hexadecimal ids, dates, long mixed tokens become wildcards that keep their file extension.
Counts are aggregated by (host, general path) before anything else, so a host with a third of all urls is as many rows as it has
general paths. Then, level by level from the root of each host, the children of each branch are compared: children that are rare among more than FANOUT, or
whose label rates don't differ from their siblings' by more than Z standard errors, merge into one wildcard child. A branch of one general path has nothing left to
compare, so its path is finished at once; the levels end when no branch is left, however deep paths are.

Purity. A template's purity is its smoothed share of good labels, from the root down. Over all hosts, pooled(t) = (good + PRIOR * pooled(parent)) / (labelled + PRIOR).
On a host it is (good + PRIOR * q) / (labelled + PRIOR), where q is pooled(t) plus what the host's parent template is above or below its pooled one. So a host without labels has
the purity that its templates have elsewhere. A template under MOST_IMPURE is rejected.

Labels: urls that a rule decides (and any label column that is given). Defined results: a null url or one without `://` has empty host and path and is
judged by its root; an empty table gives an empty result; repeated rows are judged alike; with nothing labelled every url is allowed; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import join_hot, quoted, settle

FANOUT, Z, PRIOR, MOST_IMPURE = 20, 1.96, 2.0, 0.5
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.substring(url, F.locate("://", url) + F.lit(3), F.length(url))
    there = F.locate("://", url) > 0
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(there, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (host and path prefix) and verdict of the longest rule that fits; null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for site, prefix, kind in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "block")):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(site + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def general(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards."""

    def one(s: Column) -> Column:
        end = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        kind = F.when(stem.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), "{date}").when(stem.rlike(r"^\d+$"), "{n}").when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), "{hex}").when(stem.rlike(r"\d") & (F.length(stem) >= 12), "{id}").when(F.length(stem) > 40, "{long}")
        return F.when(kind.isNotNull(), F.concat(kind, end)).otherwise(s)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)


def _merged(keys: DataFrame) -> DataFrame:
    """keys with template (its pieces): level by level, the children of each branch are compared and merged."""
    ended = F.size("segments") <= F.size("template")
    tree = keys.withColumn("template", F.array().cast("array<string>"))
    done, active = tree.filter(ended), settle(tree.filter(~ended), "level")
    while total := active.count():
        level = active.withColumn("piece", F.get("segments", F.size("template")))
        child = level.groupBy("host", "template", "piece").agg(F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("keys"))
        child = settle(child, "children")
        branch = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("fanout"), F.sum("keys").alias("members"), F.sum("n").alias("all"), F.sum("g").alias("all_g"), F.sum("b").alias("all_b"))
        both = join_hot(child, branch, ["host", "template"], "fanout", total)
        pooled = (F.col("all_g") + 1.0) / (F.col("all_g") + F.col("all_b") + 2.0)
        seen = F.col("g") + F.col("b")
        off = F.abs(F.col("g") - seen * pooled) / F.sqrt(F.greatest(seen, F.lit(1)) * pooled * (1 - pooled))
        rare = (F.col("fanout") > FANOUT) & (F.col("n") * F.col("fanout") < 2 * F.col("all"))
        alike = (F.col("fanout") > 1) & (off < Z) & (seen > 0)
        mapped = both.select("host", "template", "piece", "keys", (F.col("members") == 1).alias("alone"), F.when(rare | alike, "*").otherwise(F.col("piece")).alias("into"))
        moved = join_hot(level, settle(mapped, "merged"), ["host", "template", "piece"], "keys", total)
        rest = F.slice("segments", F.size("template") + 1, F.size("segments"))
        to = F.when(F.col("alone"), F.concat("template", rest)).otherwise(F.concat("template", F.array("into")))
        tree = settle(moved.select("host", "segments", "n", "good", "bad", to.alias("template")), "level")
        done, active = done.unionByName(tree.filter(ended)), tree.filter(~ended)
    return done


def templates(keys: DataFrame) -> DataFrame:
    """keys: host, segments, n, good, bad (one row per host and general path). Adds template and purity."""
    all_ = keys.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    root = (all_["g"] + 1.0) / (all_["g"] + all_["b"] + 1.0)  # with nothing labelled, a url is taken as good
    merged = settle(_merged(keys), "templates-of")
    every = settle(merged.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")), "templates")
    depth = F.explode(F.sequence(F.lit(0), F.size("template"))).alias("d")
    above = every.select("host", "template", "good", "bad", depth).withColumn("prefix", F.slice("template", F.lit(1), F.col("d")))
    total = above.count()
    sums = lambda k, g, b: (F.sum("good").alias(g), F.sum("bad").alias(b), F.count(F.lit(1)).alias(k))
    on_host = settle(above.groupBy("host", "prefix").agg(*sums("k", "g", "b")), "prefixes")
    pooled = on_host.groupBy("prefix").agg(F.sum("g").alias("pg"), F.sum("b").alias("pb"), F.sum("k").alias("pk"))
    found = join_hot(join_hot(above.drop("good", "bad"), on_host, ["host", "prefix"], "k", total), settle(pooled, "pooled"), ["prefix"], "pk", total)
    steps = F.array_sort(F.collect_list(F.struct("d", F.col("g").cast("double").alias("g"), F.col("b").cast("double").alias("b"), F.col("pg").cast("double").alias("pg"), F.col("pb").cast("double").alias("pb"))))

    def down(a: Column, x: Column) -> Column:
        p = F.when(x["d"] == 0, F.lit(root)).otherwise((x["pg"] + PRIOR * a["p"]) / (x["pg"] + x["pb"] + PRIOR))
        q = F.least(F.lit(0.999), F.greatest(F.lit(0.001), p + a["h"] - a["p"]))
        return F.struct(p.alias("p"), ((x["g"] + PRIOR * F.when(x["d"] == 0, F.lit(root)).otherwise(q)) / (x["g"] + x["b"] + PRIOR)).alias("h"))

    start = F.struct(F.lit(root).alias("p"), F.lit(root).alias("h"))
    purity = found.groupBy("host", "template").agg(steps.alias("steps")).select("host", "template", F.aggregate("steps", start, down)["h"].alias("purity"))
    purity = settle(purity.join(every.select("host", "template", "n"), ["host", "template"]), "purity")
    with_purity = join_hot(merged.drop("n"), purity, ["host", "template"], "n", int(keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    return with_purity.select("host", "segments", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, label: Column | None = None) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, template, purity."""
    host, path = parts(F.col(quoted(url_col)))
    read = pages.select(F.col(quoted(id_col)).alias("id"), host.alias("host"), path.alias("path"), (F.lit(None).cast("int") if label is None else label.cast("int")).alias("label"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = settle(read.select("id", "host", "path", name.alias("rule"), verdict.alias("by_rule"), general(F.col("path")).alias("segments"), "label"), "urls")
    good = F.coalesce(F.col("label") == 1, F.col("by_rule") == "allow", F.lit(False))
    bad = F.coalesce(F.col("label") == 0, F.col("by_rule") == "block", F.lit(False))
    keys = settle(rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.sum(good.cast("long")).alias("good"), F.sum(bad.cast("long")).alias("bad")), "general")
    found = settle(templates(keys).join(keys.select("host", "segments", "n"), ["host", "segments"]), "judged")
    out = join_hot(rows, found, ["host", "segments"], "n", rows.count())
    by_tree = F.when(F.col("purity") < MOST_IMPURE, "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", F.coalesce("by_rule", by_tree).alias("verdict"), "template", "purity")
