"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct word shingles. Two collections of ``halves``
half keys, each made of ``rows`` MinHash values, are computed per set; a table
key combines one half key of the first with one of the second collection, so
``halves ** 2`` tables cost only ``2 * halves * rows`` MinHash values. A pair of
Jaccard similarity s shares a key with probability (1 - (1 - s**rows)**halves)**2,
0.9999 at 0.75 with the defaults.

Work runs on classes of equal sets, so thousands of exact copies are one class.
Half keys that no other class has are dropped before keys are combined. Pairs of
classes that share a key are confirmed on their full sets, in rounds: first each
class against one centre of its buckets. Then only buckets that hold several components
stay open (by labels that are joined step by step and closed over all links at the end),
and in them only classes that hold enough shingles in common with other
components to be linked at all (an exact bound). These meet further centres one by one, while
that halves what is open. At last all members of a bucket meet, in one pass: each pair in
different components is compared or ruled out by its sizes or by parity bits of the sets
(exact bounds, too).
No bucket is capped, and a bucket that is one component costs no more pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import discard, named, staged, text_blocks

#: Most rounds in which each open class meets one centre, before all pairs are taken up; a round that
#: leaves more than half of the open members is the last one.
STARS = 4
#: Parity bits of a set; a multiple of 64.
BITS = 1024
#: Members of a bucket that one task compares with the bucket's centres; larger buckets are dealt out in pieces.
PIECE = 2048

_SIG = "doc_id long, crc long, n_shingles long, digest binary, half_a array<long>, half_b array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """For each text the sorted array of its distinct shingle hashes."""
    starts, ends, rows = words.spans(data, offsets, words.SPACED)
    h = words.hashes(data, starts, ends, folded=True)
    wide = words.chained(h, width, 5)
    for lo, hi in zip(rows[:-1], rows[1:]):
        if hi - lo >= width:
            yield np.unique(wide[lo : hi - width + 1])
        elif hi > lo:
            yield words.chained(h[lo:hi], int(hi - lo), 50 + int(hi - lo))
        else:
            yield np.zeros(0, np.uint64)


def _class_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, width: int, halves: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the set's digest and both collections of half keys, for every row."""

    def run(batches):
        odd = words.stream(21, 2 * halves * rows) | np.uint64(1)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                sets = list(shingle_sets(data, offsets, width))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                half = np.zeros((len(sets), 2 * halves), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(2 * halves):
                        total = np.zeros(len(full), np.uint64)
                        for r in range(rows):
                            total = words.mix(total * words._GOLD + np.minimum.reduceat(flat * odd[k * rows + r], first))
                        half[full, k] = words.mix(total + np.uint64(k))
                keys = [_class_key(s) if len(s) else None for s in sets]
                half = half.view(np.int64)
                at = np.arange(0, (len(sets) + 1) * halves, halves, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(at, np.ascontiguousarray(half[:, :halves]).ravel()),
                     pa.ListArray.from_arrays(at, np.ascontiguousarray(half[:, halves:]).ravel())],
                    ["doc_id", "crc", "n_shingles", "digest", "half_a", "half_b"])

    return docs.mapInArrow(run, _SIG)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` parities of how many shingles fall on each: two sets differ in at least as many shingles as bits."""
    odd = np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cls, shingles and parity bits of the classes in ``wanted`` (a row of ids each), made from one document of each."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                own = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 1))
                for key, digest, s in zip(*own, shingle_sets(data, offsets, width)):
                    if len(s) and _class_key(s) == digest:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key], pa.int64()), pa.ListArray.from_arrays(np.array([0, len(s)], np.int32), s.view(np.int64)),
                             pa.array([parity_bits(s)], pa.list_(pa.int64()))],
                            ["cls", "shingles", "bits"])

    return docs.join(wanted, docs.doc_id.eqNullSafe(wanted.of_id) & (docs.crc == wanted.of_crc)).select("cls", "digest", "text").mapInArrow(run, "cls long, shingles array<long>, bits array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (x, y; staged) with ``linked``: 100 * intersection >= percent * union of the full sets.

    Only the sets of classes in ``pairs`` are shuffled: the pairs are a written table, so
    Spark knows their size and sends their ids to the sets where these are few.
    """
    sets = sets.join(pairs.select(F.col("x").alias("cls")).union(pairs.select("y")), "cls", "left_semi")
    x = sets.select(F.col("cls").alias("x"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("cls").alias("y"), F.col("shingles").alias("sy"))
    both = pairs.join(x, "x").join(y, "y").withColumn("common", F.size(F.array_intersect("sx", "sy")).cast("long"))
    union = F.size("sx") + F.size("sy") - F.col("common")
    return both.select("x", "y", (100 * F.col("common") >= percent * union).alias("linked"))


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of an undirected graph of edges (x, y).

    Each step takes the smallest label among the neighbours, then the label's own
    label; the labels are written to the shared folder after each step.
    """
    # Only the last labels outlive the call.
    both = staged(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        labels_now = labels.select("node", "label")
        near = both.join(labels_now, both.y == labels_now.node).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("other"))
        least = labels_now.join(near, "node").select("node", F.least("label", "other").alias("label"), F.col("label").alias("was"))
        up = labels_now.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = staged(least.join(up, "label").select("node", F.least("label", "top").alias("label"), "was"), "labels")
        discard(labels)
        if new.where(new.label != new.was).isEmpty():
            discard(both)
            return new.select("node", F.col("label").alias("component"))
        labels = new


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``_confirmed``, with the pairs written before and its rows written after."""
    pairs = staged(pairs, "pairs")
    out = staged(_confirmed(pairs, sets, percent), "compared")
    discard(pairs)
    return out


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (cls, component) after components have taken the smallest label next to them, and
    that label's own: two steps towards the components that all links make.

    Classes with one label are linked, though not all linked classes have one label yet: what
    is left between them costs further comparisons, no link. ``components`` closes all at the end.
    """
    x, y = comp.select(F.col("cls").alias("x"), F.col("component").alias("cx")), comp.select(F.col("cls").alias("y"), F.col("component").alias("cy"))
    edges = links.join(x, "x").join(y, "y").where("cx != cy").select(F.col("cx").alias("x"), F.col("cy").alias("y"))
    low = edges.select(F.greatest("x", "y").alias("component"), F.least("x", "y").alias("top")).groupBy("component").agg(F.min("top").alias("top"))
    low = staged(low, "hooks")
    up = low.join(low.select(F.col("component").alias("top"), F.col("top").alias("above")), "top", "left").select("component", F.coalesce("above", "top").alias("top"))
    out = staged(comp.join(up, "component", "left").select("cls", F.coalesce("top", "component").alias("component")), "components")
    discard(low)
    return out


def _buckets(classes: DataFrame, halves: int) -> DataFrame:
    """key, its table (i, j), and cls of the classes whose half keys others have too."""
    half = classes.select("cls", F.posexplode(F.concat("half_a", "half_b")).alias("k", "h"))
    half = staged(half, "halves")
    shared = half.groupBy("k", "h").agg(F.count("*").alias("n")).where("n > 1").select("k", "h")
    mine = half.join(shared, ["k", "h"]).groupBy("cls").agg(F.collect_list(F.struct("k", "h")).alias("all"))
    side = lambda test: F.filter("all", test)  # noqa: E731  at most 2 * halves entries
    keys = (
        mine.select("cls", side(lambda e: e.k < halves).alias("a"), side(lambda e: e.k >= halves).alias("b"))
        .select("cls", "b", F.explode("a").alias("a")).select("cls", "a", F.explode("b").alias("b"))
        .select(F.xxhash64("a.k", "a.h", "b.k", "b.h").alias("key"), (F.col("a.k") + 1).alias("i"), (F.col("b.k") - halves + 1).alias("j"), "cls")
    )
    out = staged(keys, "keys")
    discard(half)
    return out


def _top_voted(met: DataFrame) -> DataFrame:
    """x and y: for each class the centre that it meets in most buckets."""
    votes = met.groupBy("cls", "centre").count()
    return votes.groupBy("cls").agg(F.max_by("centre", F.struct("count", "centre")).alias("y")).select(F.col("cls").alias("x"), "y")


def _overlap(shared, size, other, percent: int):
    """Whether an overlap of ``shared`` shingles is enough for sets of these sizes to be linked."""
    return (100 + percent) * shared >= percent * (size + other)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _open(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, i, j, cls, size, component, shared and n: members of buckets that can still join components.

    A class overlaps any class of another component in no more than its ``shared`` shingles,
    those that other components' open classes hold as well. Where these are too few for a
    link even with the smallest set of its buckets that is not too small, the class is left
    out. No link can break this bound; it takes out texts that share just a passage.
    """
    all_ = members.join(comp, "cls")
    mixed = lambda rows: rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"), F.min("size").alias("least")).where("a != b").select("key", "n", "least")
    rows = staged(all_.join(mixed(all_).drop("n"), "key"), "mixed")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("size") * percent / 100))
    mine = rows.groupBy("cls").agg(F.first("component").alias("component"), F.first("size").alias("size"), F.min(smallest).alias("other"))
    near = sets.join(rows.select("cls").distinct(), "cls", "left_semi")
    mine = mine.join(near, "cls").select("cls", F.col("component").alias("c"), "size", "other", F.explode("shingles").alias("s"))
    wide = mine.groupBy("s").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a != b").select("s")
    shared = mine.join(wide, "s", "left_semi").groupBy("cls").agg(F.count("*").alias("shared"), F.first("size").alias("size"), F.first("other").alias("other"))
    shared = shared.where(_overlap(F.col("shared"), F.col("size"), F.col("other"), percent)).select("cls", "shared")
    left = staged(rows.drop("least").join(shared, "cls"), "linkable")
    out = staged(left.join(mixed(left).drop("least"), "key"), "open")
    discard(rows)
    discard(left)
    return out


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, halves: int, rows: int) -> DataFrame:
    """doc_id, crc, n_shingles, component (null without a set) and component_id of every row."""
    docs = docs.select(named(id_col, "doc_id").cast("long").alias("doc_id"), named(text_col, "text"))
    docs = docs.select("doc_id", F.crc32("text").alias("crc"), "text")
    sig = staged(signatures(docs, width, halves, rows), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "crc")).alias("first")
    ids = sig.where("digest is not null").groupBy("digest").agg(first)
    ids = staged(ids.select("digest", F.monotonically_increasing_id().alias("cls"), F.col("first.doc_id").alias("of_id"), F.col("first.crc").alias("of_crc")), "classes")
    # One row stands for each class: equal sets have equal half keys.
    one = sig.join(ids, (sig.digest == ids.digest) & sig.doc_id.eqNullSafe(ids.of_id) & (sig.crc == ids.of_crc)).select("cls", "half_a", "half_b")
    classes = one.select("cls", "half_a", "half_b").dropDuplicates(["cls"])
    keys = _buckets(classes, halves)
    centres = keys.groupBy("key").agg(F.min("cls").alias("centre"), F.count("*").alias("n")).where("n > 1")
    members = centred = staged(keys.join(centres, "key"), "members")
    discard(keys)
    wanted = members.select("cls").distinct().join(ids, "cls")
    sets = staged(_full_sets(docs, wanted, width), "sets")
    comp = staged(members.select("cls").distinct().withColumn("component", F.col("cls")), "components")

    # Each class against the centre that it meets most often.
    done = _compared(_top_voted(members.where("cls != centre")), sets, percent)
    comp = _merged(comp, done.where("linked"))
    members = staged(members.select("key", "i", "j", "cls").join(sets.select("cls", F.size("shingles").cast("long").alias("size")), "cls"), "members")
    discard(centred)
    similar = (100 * F.col("nx") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("nx"))
    similar = similar & _overlap(F.least("sx", "shared"), F.col("size"), F.col("nx"), percent) & (F.col("cx") != F.col("component"))
    rest = _open(members, comp, sets, percent)
    for _ in range(STARS):
        if rest.isEmpty():
            break
        # Centres are now the members with the largest part of their set in other components.
        c = rest.groupBy("key").agg(F.max_by(F.struct("cls", "component", "size", "shared"), F.struct(F.col("shared") / F.col("size"), "cls")).alias("c"))
        c = c.select("key", F.col("c.cls").alias("centre"), F.col("c.component").alias("cx"), F.col("c.size").alias("nx"), F.col("c.shared").alias("sx"))
        near = rest.join(c, "key").where(similar).select(F.least("cls", "centre").alias("x"), F.greatest("cls", "centre").alias("y"), "cls", "centre")
        pairs = _top_voted(near.join(_ordered(done), ["x", "y"], "left_anti"))
        now = _compared(_ordered(pairs).distinct(), sets, percent)
        done = done.union(now)
        if now.where("linked").isEmpty():
            break
        comp = _merged(comp, now.where("linked"))
        old, rest = rest, _open(rest.drop("component", "shared", "n"), comp, sets, percent)
        few = 2 * rest.count() <= old.count()
        discard(old)
        if not few:
            break

    # All pairs that are left, each in the first table only in which the two meet.
    if not rest.isEmpty():
        half_keys = classes.join(rest.select("cls").distinct(), "cls", "left_semi").join(sets.select("cls", "bits"), "cls")
        whole = staged(rest.join(half_keys, "cls").withColumn("pieces", F.ceil(F.col("n") / PIECE)), "whole")
        met_by = whole.withColumn("piece", F.pmod(F.xxhash64("cls"), "pieces"))
        apart = sum((F.bit_count(F.col("qx")[k].bitwiseXOR(F.col("bits")[k])) for k in range(BITS // 64)), F.lit(0))
        similar = similar & ((100 + percent) * apart <= (100 - percent) * (F.col("size") + F.col("nx")))
        c = whole.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.col("cls").alias("x"), F.col("component").alias("cx"), F.col("size").alias("nx"), F.col("shared").alias("sx"), F.col("half_a").alias("ax"), F.col("half_b").alias("bx"), F.col("bits").alias("qx"))
        met = F.arrays_overlap(F.slice("ax", F.lit(1), F.col("i") - 1), F.slice("half_a", F.lit(1), F.col("i") - 1)) | F.arrays_overlap(F.slice("bx", F.lit(1), F.col("j") - 1), F.slice("half_b", F.lit(1), F.col("j") - 1))
        # Merged on shuffled pieces: a broadcast of the members would leave the work to as many tasks as ``whole`` has files.
        pairs = c.hint("merge").join(met_by, ["key", "piece"]).where((F.col("x") < F.col("cls")) & similar & ~met).select("x", F.col("cls").alias("y"))
        done = done.union(_compared(pairs.join(_ordered(done), ["x", "y"], "left_anti"), sets, percent))
        discard(whole)
    comp = components(done.where("linked"))
    for table in (members, rest, sets):
        discard(table)

    named_ = ids.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named_.groupBy("component").agg(F.min("of_id").alias("component_id"))
    of = named_.join(least, "component").select("digest", "component", "component_id")
    out = sig.select("doc_id", "crc", "n_shingles", "digest").join(of, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "crc", "n_shingles", "component", own.alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                    width: int = 5, halves: int = 12, rows: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept, a row per input row.

    A null or empty text, or one without words, has no set, is linked with nothing and
    is its own component. Rows with equal sets are one class whatever their ids; a null
    doc_id belongs to its class's component but never names it, and where a component
    has null ids only, component_id is null and those rows are kept. Repeated rows each
    get a result. Other columns of the input are not read.
    """
    out = _linked(docs, id_col, text_col, percent, width, halves, rows)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                     width: int = 5, halves: int = 12, rows: int = 2) -> DataFrame:
    """One row of ``docs`` for each component, that of its component_id, with the columns of ``docs``.

    Rows without a set all stay. Where several rows of a component have its id, the one
    with the smallest text checksum stays, and of repeated rows one.
    """
    out = staged(_linked(docs, id_col, text_col, percent, width, halves, rows), "linked")
    best = out.where("component is not null and doc_id <=> component_id").groupBy("component", "doc_id").agg(F.min("crc").alias("crc"), F.count("*").alias("n"))
    stay = best.select("doc_id", "crc", (F.col("n") > 1).alias("again")).union(out.where("component is null").select("doc_id", "crc", F.lit(False)).distinct())
    stay = staged(stay.select(F.col("doc_id").alias("stay_id"), F.col("crc").alias("stay_crc"), "again"), "stay")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), F.crc32(F.col(f"`{text_col}`")).alias("own_crc"))
    found = row.join(stay, row.own_id.eqNullSafe(stay.stay_id) & row.own_crc.eqNullSafe(stay.stay_crc))
    once = found.where("not again").select("row")
    return once.union(found.where("again").dropDuplicates(["own_id", "own_crc"]).select("row")).select("row.*")


def oracle(table: str, percent: int = 75, width: int = 5) -> str:
    """The same result in DuckDB's SQL by a join of full sets on their shingles."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{up}', '{low}'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
 s AS (SELECT doc_id, CASE WHEN len(w) >= {width} THEN list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width - 1}], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 c AS (SELECT s, MIN(doc_id) AS id FROM s WHERE len(s) > 0 GROUP BY list_sort(s), s),
 u AS (SELECT list_sort(s) AS k, MIN(id) AS id, ANY_VALUE(len(s)) AS n FROM c GROUP BY 1),
 x AS (SELECT id, n, UNNEST(k) AS sh FROM u),
 l AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * COUNT(*) >= {percent} * (a.n + b.n - COUNT(*))),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT id AS node, id AS top FROM u UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.node),
 t AS (SELECT node, MIN(top) AS top FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, COALESCE(t.top, s.doc_id) AS component_id, s.doc_id = COALESCE(t.top, s.doc_id) AS kept
FROM s LEFT JOIN u ON u.k = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN t ON t.node = u.id"""
