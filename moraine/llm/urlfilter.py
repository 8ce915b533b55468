"""URL filters by path templates. Built-in expressions and joins only.

Each host has a tree of path segments. A segment that looks variable (a number, a date, hexadecimal, a UUID) becomes a wildcard of
its form at once; level by level, so do the segments of a node that are each rare among many siblings. From the last
level up, sibling branches that differ in one segment are merged where their labels don't differ more than chance allows: in the order of
their shares of bad pages each is held against those merged before it by a chi-squared test of 2 x 2 counts (with Yates' correction), and begins a new group if they
differ. A group of all siblings is a wildcard, one of some is `{a|b}`. Siblings without labels join where all the others are one group, else they stay as they are. Each
template's share of bad pages is smoothed towards the corpus's share, and templates above `REJECT` are rejected with all their pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exchange import saved, workspace
from .warc import _SCHEME

MANY, RARE = 10, 0.1
SMOOTH, REJECT = 10.0, 0.4
#: Critical value of chi-squared at 5 % with one degree of freedom.
CHI_SQUARED = 3.841
BROADCAST_PATHS = 200_000


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1)), r"^.*@", ""), r":[0-9]*$", "")


def _form(s: Column) -> Column:
    """A segment with its variable forms replaced; an ending such as .html stays."""
    ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})?$", 0)
    name = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(name.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("<date>"))
        .when(name.rlike(r"^[0-9]+$"), F.lit("<n>"))
        .when(name.rlike(r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), F.lit("<uuid>"))
        .when(name.rlike(r"(?i)^[0-9a-f]{8,}$") & name.rlike("[0-9]"), F.lit("<hex>"))
        .when(name.rlike(r"[0-9]{3,}$"), F.concat(F.regexp_replace(name, r"[0-9]+$", ""), F.lit("<n>")))
    )
    return F.when(kind.isNull(), s).otherwise(F.concat(kind, ending))


def segments(url: Column) -> Column:
    """The path's segments by form, all of them, then the sorted names of the query's parameters as one that begins with `?`."""
    path = F.regexp_replace(F.regexp_replace(url, _SCHEME + r"[^/?#]*", ""), r"[?#].*$", "")
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _form)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1))))
    end = F.when(query != "", F.array(F.concat(F.lit("?"), F.array_join(names, "&")))).otherwise(F.array().cast("array<string>"))
    return F.concat(parts, end)


def _alike(x: Column, y: Column) -> Column:
    """Whether two branches (l labels, b of them bad) differ no more than chance allows."""
    n = x["l"] + y["l"]
    apart = F.abs(x["b"] * (y["l"] - y["b"]) - (x["l"] - x["b"]) * y["b"]).cast("double") - n / 2
    bad = (x["b"] + y["b"]).cast("double")
    return F.coalesce(n * F.pow(F.greatest(apart, F.lit(0.0)), 2) / F.nullif(x["l"].cast("double") * y["l"] * bad * (n - bad), F.lit(0.0)) <= CHI_SQUARED, F.lit(True))


def _grouped(branch: DataFrame, d: int) -> DataFrame:
    """(host, t, merged) of the branches that become one with others that differ in segment d only. A node has few siblings left: rare ones are a wildcard by now."""
    star = lambda name: F.concat(F.slice("t", 1, d), F.array(name), F.slice("t", d + 2, F.size("t")))
    one = F.struct((F.col("b") / F.greatest("l", F.lit(1))).alias("share"), F.element_at("t", d + 1).alias("s"), "l", "b")
    siblings = branch.withColumn("star", star(F.lit("*"))).groupBy("host", "star").agg(F.collect_list(one).alias("all")).where(F.size("all") > 1)
    start = F.array().cast("array<struct<l:bigint,b:bigint,names:array<string>>>")

    def add(groups: Column, x: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        joined = F.struct((last["l"] + x["l"]).alias("l"), (last["b"] + x["b"]).alias("b"), F.concat(last["names"], F.array(x["s"])).alias("names"))
        own = F.struct(x["l"].alias("l"), x["b"].alias("b"), F.array(x["s"]).alias("names"))
        return F.when((F.size(groups) > 0) & _alike(last, x), F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(joined))).otherwise(F.concat(groups, F.array(own)))

    groups = siblings.withColumn("groups", F.aggregate(F.array_sort(F.filter("all", lambda x: x["l"] > 0)), start, add))
    names = F.when(F.size("groups") < 2, F.array(F.transform("all", lambda x: x["s"]))).otherwise(F.filter(F.transform("groups", lambda g: F.array_sort(g["names"])), lambda n: F.size(n) > 1))
    rows = groups.select("host", "star", (F.size("groups") < 2).alias("whole"), F.explode(names).alias("names"))
    label = F.when(F.col("whole"), F.lit("*")).otherwise(F.concat(F.lit("{"), F.array_join("names", "|"), F.lit("}")))
    rows = rows.select("host", F.col("star").alias("t"), label.alias("label"), F.explode("names").alias("s"))
    return rows.select("host", star(F.col("s")).alias("t"), star(F.col("label")).alias("merged"))


def templates(pages: DataFrame, labels: DataFrame, smooth: float = SMOOTH, reject: float = REJECT) -> DataFrame:
    """(host, path, template, n_labelled, n_bad, bad_share, rejected) of every host and path by form.

    pages: page_id, url; labels: page_id, bad (0 or 1). Rows with a null url have no path; a label of an unknown page, a null
    label or page_id counts for nothing; more than one label of a page all count.
    """
    spark = pages.sparkSession
    folder = workspace(spark)
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("l"), F.sum(F.col("bad").cast("long")).alias("b"))
    rows = pages.where("url is not null").select("page_id", host(F.col("url")).alias("host"), segments(F.col("url")).alias("path")).join(known, "page_id", "left")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    paths = saved(paths.withColumn("t", F.col("path")), folder, "paths")
    depth = paths.agg(F.max(F.size("t"))).first()[0] or 0
    for d in range(depth):  # a node: the host and the first d segments; generalise the segments below it
        at = paths.where(F.size("t") > d).select("host", F.slice("t", 1, d).alias("node"), F.element_at("t", d + 1).alias("s"), "n").where(~F.col("s").startswith("?"))
        children = at.groupBy("host", "node", "s").agg(F.sum("n").alias("n"))
        nodes = children.groupBy("host", "node").agg(F.count("*").alias("k"), F.sum("n").alias("total")).where(F.col("k") >= MANY)
        rare = children.join(nodes, ["host", "node"]).where((F.col("n") < F.col("total") * RARE) & ~F.col("s").rlike("<[a-z]+>|^[*]+$"))
        rare = saved(rare.select(F.col("host").alias("h"), F.col("node").alias("p"), F.col("s").alias("r")), folder, f"rare{d}")
        if rare.isEmpty():
            continue
        hit = (F.col("host") == F.col("h")) & (F.slice("t", 1, d) == F.col("p")) & (F.get("t", F.lit(d)) == F.col("r"))
        star = F.concat(F.slice("t", 1, d), F.array(F.lit("*")), F.slice("t", d + 2, F.size("t")))
        paths = saved(paths.join(rare, hit, "left").withColumn("t", F.when(F.col("r").isNotNull(), star).otherwise(F.col("t"))).drop("h", "p", "r"), folder, f"wild{d}")
    base = F.broadcast(paths.agg((F.sum("b") / F.nullif(F.sum("l"), F.lit(0))).alias("base")).select(F.coalesce("base", F.lit(0.0)).alias("base")))
    for d in reversed(range(depth)):  # merge siblings that differ in segment d only
        branch = paths.groupBy("host", "t").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).where((F.size("t") > d) & ~F.element_at("t", d + 1).startswith("?"))
        merged = saved(_grouped(branch, d), folder, f"groups{d}")
        if not merged.isEmpty():
            paths = saved(paths.join(merged, ["host", "t"], "left").withColumn("t", F.coalesce("merged", "t")).drop("merged"), folder, f"merged{d}")
    w = W.partitionBy("host", "t")
    paths = paths.withColumns({"n_labelled": F.sum("l").over(w), "n_bad": F.sum("b").over(w)}).crossJoin(base)
    share = (F.col("n_bad") + F.lit(smooth) * F.col("base")) / (F.col("n_labelled") + F.lit(smooth))
    template = F.concat(F.lit("/"), F.array_join("t", "/"))
    return saved(paths.select("host", "path", template.alias("template"), "n_labelled", "n_bad", share.alias("bad_share"), (share > reject).alias("rejected")), folder, "templates")


def filter_urls(pages: DataFrame, labels: DataFrame, smooth: float = SMOOTH, reject: float = REJECT) -> DataFrame:
    """(page_id, url, host, template, n_labelled, n_bad, bad_share, rejected) of every page with a url; repeated rows stay repeated.

    A url without scheme has the host ''. Other columns are not read. No pages give no rows; without labels every share is 0.
    """
    found = templates(pages, labels, smooth, reject)
    if found.count() <= BROADCAST_PATHS:
        found = F.broadcast(found)
    rows = pages.where("url is not null").select("page_id", "url", host(F.col("url")).alias("host"), segments(F.col("url")).alias("path"))
    return rows.join(found, ["host", "path"]).select("page_id", "url", "host", "template", "n_labelled", "n_bad", "bad_share", "rejected")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): the test tables name the labelled document of a page by the last number in its path; bad: of low quality or toxic."""
    number = F.regexp_extract("url", r"/([0-9]+)(\.[a-z]+)?/?([?#].*)?$", 1)
    ids = pages.select("page_id", F.expr("try_cast(_n as bigint)").alias("doc_id")) if "_n" in pages.columns else pages.withColumn("_n", number).select("page_id", F.expr("try_cast(_n as bigint)").alias("doc_id"))
    return ids.join(labels, "doc_id").select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, page_labels(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE: dict[str, str] = {}
