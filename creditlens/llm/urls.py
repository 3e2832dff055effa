"""URL verdicts from rules and from a path-template tree learnt per host.

Paths are cut into segments, the tree's levels. A segment becomes a wildcard by its form
(numbers, hexadecimal or mixed ids, with what extension they have) or, level by level,
by counts: below a node with many kinds of children, each child that is not much more
frequent than the average is one of ``*``. Then sibling branches whose labelled purity
does not differ from that of their parent by more than ``SIMILAR`` standard errors are
merged into ``~``. A template's purity is smoothed towards its host's, which is smoothed
towards that of all pages, and templates under ``LEAST_PURITY`` are rejected.

All steps are aggregations: rows are first summed per (host, typed path), so that a host
with a third of all pages is combined before the shuffle, and levels work on those sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import staged

#: Levels that the brute-force test walks; the operator takes as many as the paths have.
DEPTH = 32
#: A node with fewer kinds of children keeps them all.
LEAST_KINDS = 12
#: A child stays itself where it has at least so many times the average of its siblings.
FREQUENT = 4
SIMILAR = 2.0
#: Rows of the prior that are added to each template's labelled rows.
SMOOTHING = 10.0
LEAST_PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host suffix and path prefix written as one) that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, rule).otherwise(out)
    return out


def typed(segment: Column) -> Column:
    """The segment, or the form of a segment that is plainly an id."""
    stem, extension = F.regexp_extract(segment, r"^(?s)(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 1), F.regexp_extract(segment, r"^(?s)(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?$", 2)
    form = (
        F.when(stem.rlike(r"^[0-9]+$"), "{number}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}$") & stem.rlike("[0-9]"), "{hex}")
        .when(stem.rlike(r"^[0-9A-Za-z_-]{12,}$") & stem.rlike("[0-9]") & stem.rlike("[A-Za-z]"), "{id}")
    )
    return F.when(form.isNotNull(), F.concat(form, extension)).otherwise(segment)


def segments(path: Column) -> Column:
    """All segments of a path, typed."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/", -1), typed)


def by_level(rows: DataFrame, along: str, grown: str, step, name: str) -> DataFrame:
    """``rows`` with ``grown``, an array that ``step`` makes longer by one level of ``along`` at a time.

    ``step`` gets the rows that still have a level, as ``child``. Rows whose levels are all done
    are set aside in one table, so that each level costs what is still that deep; the last
    level is that of the longest path.
    """
    done = scratch_path(rows.sparkSession, name)
    rows, k = rows.withColumn(grown, F.array().cast("array<string>")), 0
    schema = rows.schema
    while True:
        rows.where(F.size(along) <= k).write.mode("append").parquet(done)
        rows = rows.where(F.size(along) > k)
        if rows.isEmpty():
            return rows.sparkSession.read.schema(schema).parquet(done)
        rows, k = staged(step(rows.withColumn("child", F.element_at(along, k + 1))).select(*schema.names), name), k + 1


def templates(pages: DataFrame) -> DataFrame:
    """host, segs, template and purity from host, segs and the label (1, 0 or null) of each row."""
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("labelled").alias("labelled")]
    ones = pages.select("host", "segs", F.lit(1).alias("n"), F.when(F.col("label") == 1, 1).otherwise(0).alias("good"), F.col("label").isNotNull().cast("int").alias("labelled"))
    paths = staged(ones.groupBy("host", "segs").agg(*sums), "paths")

    # Variable segments, from the root downward.
    def widened(rows: DataFrame) -> DataFrame:
        kinds = rows.groupBy("host", "shape", "child").agg(F.sum("n").alias("c"))
        nodes = kinds.groupBy("host", "shape").agg(F.sum("c").alias("all"), F.count("*").alias("kinds"))
        rare = kinds.join(nodes.where(f"kinds >= {LEAST_KINDS}"), ["host", "shape"]).where(F.col("c") * F.col("kinds") < FREQUENT * F.col("all"))
        rows = rows.join(rare.select("host", "shape", "child", F.lit("*").alias("wild")), ["host", "shape", "child"], "left")
        return rows.withColumn("shape", F.concat("shape", F.array(F.coalesce("wild", "child"))))

    shaped = by_level(paths, "segs", "shape", widened, "shapes")

    # Similar siblings, from the root downward.
    def joined(rows: DataFrame) -> DataFrame:
        branch = rows.groupBy("host", "merged", "child").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
        parent = branch.groupBy("host", "merged").agg(F.sum("g").alias("pg"), F.sum("l").alias("pl"), F.count("*").alias("children"))
        rate = F.try_divide("pg", "pl")
        far = F.abs(F.col("g") - F.col("l") * rate) > SIMILAR * F.sqrt(F.col("l") * rate * (1 - rate))
        alike = branch.join(parent.where("children > 1"), ["host", "merged"]).where(~F.coalesce(far, F.lit(False)))
        rows = rows.join(alike.select("host", "merged", "child", F.lit("~").alias("one")), ["host", "merged", "child"], "left")
        return rows.withColumn("merged", F.concat("merged", F.array(F.coalesce("one", "child"))))

    tree = by_level(staged(shaped.groupBy("host", "shape").agg(*sums), "tree"), "shape", "merged", joined, "merged")

    # Purity, smoothed from all pages to the host to the template.
    hosts = tree.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("labelled").alias("hl"))
    everything = F.lit(tree.agg(F.try_divide(F.sum("good"), F.sum("labelled"))).first()[0] or 0.0)
    smooth = lambda good, n, prior: (good + SMOOTHING * prior) / (n + SMOOTHING)
    merged = tree.groupBy("host", "merged").agg(F.sum("good").alias("g"), F.sum("labelled").alias("l"))
    pure = merged.join(hosts, "host").withColumn("purity", smooth(F.col("g"), F.col("l"), smooth(F.col("hg"), F.col("hl"), everything)))
    by_shape = tree.select("host", "shape", "merged").join(pure.select("host", "merged", "purity"), ["host", "merged"])
    named_ = by_shape.select("host", "shape", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity")
    return shaped.select("host", "segs", "shape").join(named_, ["host", "shape"]).select("host", "segs", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url",
          label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity, a row per page.

    A null url, or one without ``://``, has an empty host and path, and all such pages share
    the template ``/``. A rule's verdict stands; else a page is blocked where its template's
    purity is under ``LEAST_PURITY``. Without any label the table's purity counts as unknown
    and nothing is rejected. A page with several labels has their mean rounded half up, one
    with a null id has none. Repeated pages count as often as they stand. Other columns are
    not read.
    """
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    marks = labels.groupBy(F.col(f"`{label_id}`").alias("labelled_id")).agg(F.floor(F.avg(F.col(f"`{label_col}`")) + 0.5).cast("int").alias("label"))
    rows = urls.join(marks, urls.page_id == marks.labelled_id, "left").select("page_id", "host", "path", segments(F.col("path")).alias("segs"), "label")
    rows = staged(rows, "urls")
    learnt = templates(rows)
    any_label = not rows.where("label is not null").isEmpty()
    rule = rule_of(F.col("host"), F.col("path"), rules)
    chosen = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])[F.col("rule")] if rules else F.lit(None).cast("string")
    out = rows.join(learnt, ["host", "segs"], "left").withColumn("rule", rule)
    by_method = F.when(F.lit(any_label) & (F.col("purity") < LEAST_PURITY), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(chosen, by_method).alias("verdict"), "template", "purity")
