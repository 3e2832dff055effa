"""Benchmark decontamination with a distributed positional inverted index.

Each task turns its documents into segments: the sorted term hashes of about
``SEGMENT_WORDS`` words, and for each term the list of its word positions. Each
segment is a file in the shared folder, so the index is built once and lost
executors reread files; Spark's rows hold the files' names only, and a worker has
one segment at a time, however many its task writes or reads. A phrase is looked up in a segment by taking the list of
its rarest term, shifting it by the term's place in the phrase and intersecting
it with the shifted lists of the other terms, rarest first; only positions that
all lists share are occurrences. Terms are 64-bit hashes of words (words.py).

A document lies in one segment, so a search needs no shuffle. The query phrases are
made in tasks too and written to the shared folder, each once, in files of at most
``BLOCK_WORDS`` words; a worker reads them block by block for its segments and keeps
the last ``_HELD`` of them, so nothing that grows is broadcast or goes through the
driver, which lists the files' names. Which items own the phrases found in a
document is a join of keys. A document's hits leave its task as runs of words.
"""

from __future__ import annotations

import math
import uuid
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import discard, named, open_shared, shared_folder, staged, text_blocks, write_shared

SEGMENT_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20
#: Segments that a task searches, and places that are looked at together.
TASK_SEGMENTS = 4
_CANDIDATES = 1 << 20
_CHUNK = 4096
_HELD = 4


def _invert(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct terms, where each list starts, and all positions by term."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(h) else np.zeros(0, np.int64)
    return ranked[new], np.append(new, len(h)), order


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of ``docs``: segment and place (its file in the shared folder), a row per segment."""
    docs = docs.select(named(id_col, "doc_id").cast("long").alias("doc_id"), F.crc32(named(text_col, "text")).alias("crc"), named(text_col, "text"))
    folder = shared_folder(docs.sparkSession, "segments")

    def segment(number, ids, crcs, sizes, h):
        term, at, position = _invert(np.concatenate(h) if h else np.zeros(0, np.uint64))
        whole = lambda values, kind: pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), pa.array(values, kind))
        table = pa.table({
            "doc_id": whole(ids, pa.int64()), "crc": whole(crcs, pa.int64()), "first": whole(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32()),
            "term": whole(term.view(np.int64), pa.int64()), "at": whole(at.astype(np.int32), pa.int32()), "position": whole(position.astype(np.int32), pa.int32())})
        path = write_shared(f"{folder}/{number}-{uuid.uuid4().hex}", lambda out: pq.write_table(table, out, compression="zstd", use_dictionary=False))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path], pa.string())], ["segment", "place"])

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        ids, crcs, sizes, h, n = [], [], [], [], 0
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                starts, ends, rows = words.spans(data, offsets, words.ALNUM)
                ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                crcs += batch.column(1).slice(lo, hi - lo).to_pylist()
                sizes += np.diff(rows).tolist()
                h.append(words.hashes(data, starts, ends, folded=True))
                n += len(starts)
                if n >= SEGMENT_WORDS:
                    yield segment(number, ids, crcs, sizes, h)
                    number, ids, crcs, sizes, h, n = number + 1, [], [], [], [], 0
        if ids:
            yield segment(number, ids, crcs, sizes, h)

    index = staged(docs.mapInArrow(run, "segment long, place string"), "index")
    index.files_at = folder
    return index


def _dealt(index: DataFrame) -> DataFrame:
    """The segments dealt out over the cores, in tasks of about ``TASK_SEGMENTS`` where they are many."""
    n = index.count()
    return index.repartition(max(1, min(n, max(index.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_SEGMENTS)))))


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (text form of the id) and its words' hashes, long items in chunks of ``_CHUNK`` words."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                starts, ends, rows = words.spans(data, offsets, words.ALNUM)
                h = words.hashes(data, starts, ends, folded=True).view(np.int64)
                for item, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), rows[:-1], rows[1:]):
                    parts = [h[k : min(b, k + _CHUNK)] for k in range(a, b, _CHUNK)]
                    if parts:
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.list_(pa.int64()))], ["item", "words"])

    return items.select(named(id_col, "item").cast("string").alias("item"), named(text_col, "text")).mapInArrow(run, "item string, words array<long>")


def item_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, key (a hash of the words' hashes) and words of each window of ``width`` words of
    an item, or of all its words if it has fewer."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                starts, ends, rows = words.spans(data, offsets, words.ALNUM)
                h = words.hashes(data, starts, ends, folded=True)
                for item, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), rows[:-1], rows[1:]):
                    k = min(width, b - a)
                    for at in range(a, b - k + 1 if k else a, _CHUNK):
                        own = np.lib.stride_tricks.sliding_window_view(h[at : min(b, at + _CHUNK + k - 1)], k)
                        each = pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * np.int32(k), pa.array(own.ravel().view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(_row_key(own).view(np.int64)), each], ["item", "key", "words"])

    return items.select(named(id_col, "item").cast("string").alias("item"), named(text_col, "text")).mapInArrow(run, "item string, key long, words array<long>")


def _row_key(rows: np.ndarray) -> np.ndarray:
    c = words.stream(9, rows.shape[1]) | np.uint64(1)
    return words.mix((rows * c).sum(axis=1, dtype=np.uint64))


def _files(table: DataFrame) -> list[str]:
    """The files of a staged table, each a block that one task can hold."""
    fs, place = open_shared(table.staged_at)
    found = fs.get_file_info(pafs.FileSelector(place))
    return sorted(f"{table.staged_at}/{f.base_name}" for f in found if f.base_name.endswith(".parquet") and f.size)


def _read(path: str) -> pa.Table:
    fs, place = open_shared(path)
    return pq.read_table(place, filesystem=fs).combine_chunks()


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array column in a row, and where each list starts."""
    size = lists.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    values = lists.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.view(np.uint64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


@lru_cache(maxsize=_HELD)
def _windows_of(path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(windows, keys) by length of the windows."""
    table = _read(path)
    values, at = _flat(table["words"])
    key, size = table["key"].to_numpy(), np.diff(at)
    return [(values[at[:-1][size == k][:, None] + np.arange(k)], key[size == k]) for k in np.unique(size)]


@lru_cache(maxsize=_HELD)
def _items_of(path: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, all distinct words, where each item's words start, and the span each may take."""
    table = _read(path)
    return table["item"].to_pylist(), *_flat(table["words"]), table["within"].to_numpy()


class _Segment:
    """A segment of the index: word positions by term, documents by their first word."""

    def __init__(self, number: int, path: str):
        table = _read(path)
        get = lambda name, kind: table.column(name)[0].values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
        self.number, self.doc_id, self.crc = number, table.column("doc_id")[0].values, table.column("crc")[0].values
        self.first, self.at, self.position = get("first", np.int64), get("at", np.int64), get("position", np.int64)
        self.term = get("term", np.int64).view(np.uint64)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands among the terms, and whether it does."""
        if not len(self.term):
            return np.zeros(h.shape, np.int64), np.zeros(h.shape, bool)
        place = np.minimum(np.searchsorted(self.term, h), len(self.term) - 1)
        return place, self.term[place] == h

    @cached_property
    def entry(self) -> np.ndarray:
        """Term and position in one ascending number."""
        return (np.repeat(np.arange(len(self.term)), np.diff(self.at)) << 32) | self.position

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    @cached_property
    def doc_lists(self) -> tuple[np.ndarray, np.ndarray]:
        """The documents of each term in a row, and where each term's start."""
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[self.position]
        term = np.repeat(np.arange(len(self.term)), np.diff(self.at))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
        return doc[new], np.searchsorted(term[new], np.arange(len(self.term) + 1))


def _segments(batches):
    for batch in batches:
        for number, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield _Segment(number, path)


def occurrences(phrases: np.ndarray, s: _Segment) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of each place in a segment where a phrase's terms stand in a row.

    Candidates come from the rarest term's list; each further term keeps those whose
    shifted position is in its own list, found by bisection in (term, position) order.
    """
    place, there = s.places(phrases)
    here = np.flatnonzero(there.all(axis=1))
    if not len(here):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = place[here]
    order = np.argsort(np.diff(s.at)[place], axis=1, kind="stable")
    rarest = np.take_along_axis(place, order[:, :1], axis=1)[:, 0]
    n = s.at[rarest + 1] - s.at[rarest]
    ends, lo, found = np.cumsum(n), 0, []
    while lo < len(here):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + _CANDIDATES, "right")))
        which, start = _in_a_row(place[lo:hi], order[lo:hi], n[lo:hi], s)
        found.append((here[lo + which], start))
        lo = hi
    return np.concatenate([which for which, _ in found]), np.concatenate([start for _, start in found])


def _in_a_row(place: np.ndarray, order: np.ndarray, n: np.ndarray, s: _Segment) -> tuple[np.ndarray, np.ndarray]:
    """``occurrences`` of phrases whose terms stand at ``place``, the rarest with ``n`` positions first in ``order``."""
    pick = lambda k: np.take_along_axis(place, order[:, k : k + 1], axis=1)[:, 0]
    which = np.repeat(np.arange(len(place)), n)
    start = s.position[words.ragged(s.at[pick(0)], n)] - order[which, 0]
    for k in range(1, place.shape[1]):
        want = (pick(k)[which] << 32) | np.maximum(start + order[which, k], 0)
        found = np.minimum(np.searchsorted(s.entry, want), len(s.entry) - 1)
        ok = (s.entry[found] == want) & (start >= 0)
        which, start = which[ok], start[ok]
    return which, start


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """``values``, in ascending order of ``owner``, as a list for each of ``n`` owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


_FOUND = "segment long, ordinal int, doc_id long, crc long, n_words long, runs array<struct<lo:int,hi:int>>, keys array<long>"


def _search(index: DataFrame, files: list[str]) -> DataFrame:
    """A row for each document: its hit words as runs, and the keys of the windows that it has."""

    def run(batches):
        for s in _segments(batches):
            n, total = len(s.first) - 1, int(s.first[-1])
            edge, docs, keys = np.zeros(total + 1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for path in files:
                for rows, key in _windows_of(path):
                    k = rows.shape[1]
                    which, start = occurrences(rows, s)
                    doc = s.doc(start)
                    inside = start + k <= s.first[doc + 1]
                    which, start, doc = which[inside], start[inside], doc[inside]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + k, -1)
                    own = np.unique(doc * len(rows) + which)
                    docs.append(own // len(rows))
                    keys.append(key[own % len(rows)])
            docs, keys = np.concatenate(docs), np.concatenate(keys)
            order = np.argsort(docs, kind="stable")
            # A run ends with its document, also where the next one goes on.
            hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
            cut = np.zeros(total + 1, bool)
            cut[s.first] = True
            lo = np.flatnonzero(hit[1:] & (~hit[:-1] | cut))
            hi = np.flatnonzero(hit[:-1] & (~hit[1:] | cut))
            in_doc = s.doc(lo)
            spans = pa.StructArray.from_arrays([pa.array(x - s.first[in_doc], pa.int32()) for x in (lo, hi)], ["lo", "hi"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, s.number)), pa.array(np.arange(n), pa.int32()), s.doc_id, s.crc,
                 pa.array(np.diff(s.first)), _lists(in_doc, n, spans), _lists(docs[order], n, pa.array(keys[order]))],
                ["segment", "ordinal", "doc_id", "crc", "n_words", "runs", "keys"])

    return _dealt(index).mapInArrow(run, _FOUND)


def phrase_matches(index: DataFrame, items: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """segment, ordinal, doc_id, crc, n_words, runs, n_hit and items (sorted as strings) for every indexed document.

    A phrase is a window of ``width`` neighbouring words of an item, or all words of an
    item that has fewer. ``runs`` are the document's words inside any occurrence (from 0, end
    exclusive), n_hit counts them. A null document or item text has no words; an item with a
    null id is matched but not listed. The result is written: ``index`` is not read again.
    """
    windows = staged(item_windows(items, width, id_col, text_col), "windows")
    each = staged(windows.groupBy("key").agg(F.first("words").alias("words")), "phrases", maxRecordsPerFile=max(1, BLOCK_WORDS // width))
    found = staged(_search(index, _files(each)), "found")
    discard(each)
    owners = windows.where("item IS NOT NULL").select("key", "item").distinct()
    listed = found.select("segment", "ordinal", F.explode("keys").alias("key")).join(owners, "key")
    listed = listed.groupBy("segment", "ordinal").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r.hi - r.lo)
    both = found.drop("keys").join(listed, ["segment", "ordinal"], "left")
    return both.withColumns({"n_hit": n_hit, "items": F.coalesce("items", F.array().cast("array<string>"))})


def _near(s: _Segment, place: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents in which the terms at ``place`` all stand inside ``within`` words, and the number of ends of such spans.

    The documents of the rarest term are kept while the further terms, rarest first, have them too.
    """
    docs, doc_at = s.doc_lists
    place = place[np.argsort(doc_at[place + 1] - doc_at[place], kind="stable")]
    left = docs[doc_at[place[0]] : doc_at[place[0] + 1]]
    for p in place[1:]:
        own = docs[doc_at[p] : doc_at[p + 1]]
        left = left[own[np.minimum(np.searchsorted(own, left), len(own) - 1)] == left]
        if not len(left):
            return left, left
    where, kind = [], []
    for k, p in enumerate(place):
        own = s.position[s.at[p] : s.at[p + 1]]
        lo, hi = np.searchsorted(own, s.first[left]), np.searchsorted(own, s.first[left + 1])
        where.append(own[words.ragged(lo, hi - lo)])
        kind.append(np.full(len(where[-1]), k))
    where, kind = np.concatenate(where), np.concatenate(kind)
    order = np.argsort(where)
    where, kind = where[order], kind[order]
    oldest = where.copy()
    for k in range(len(place)):
        oldest = np.minimum(oldest, np.maximum.accumulate(np.where(kind == k, where, -1)))
    doc = s.doc(where)
    ok = (oldest >= s.first[doc]) & (where - oldest < within)
    return np.unique(doc[ok], return_counts=True)


def proximity_matches(index: DataFrame, items: DataFrame, within: int | None = None, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """segment, ordinal, doc_id, item, n_spans: documents where all distinct words of an item stand, in any
    order, inside ``within`` neighbouring words (None: twice the item's number of words); n_spans
    counts the ends of such spans.

    Items that share an id are one item; those without an id or words are not searched. Each of an item's
    lists gives, at every occurrence of any of its terms, the last place of each term; the oldest of
    them tells the shortest span that ends there. The result is written: ``index`` is not read again.
    """
    chunks = item_words(items, id_col, text_col).where("item IS NOT NULL")
    longest = F.lit(within).cast("long") if within is not None else 2 * F.count("*")
    whole = chunks.select("item", F.explode("words").alias("word")).groupBy("item").agg(F.collect_set("word").alias("words"), longest.alias("within"))
    # A row per item, so that no block has but a part of one.
    whole = staged(whole, "items", maxRecordsPerFile=max(1, BLOCK_WORDS // _CHUNK))
    files = _files(whole)

    def run(batches):
        for s in _segments(batches):
            for path in files:
                names, flat, item_at, spans = _items_of(path)
                place, there = s.places(flat)
                for i in np.flatnonzero(np.logical_and.reduceat(there, item_at[:-1])):
                    docs, n = _near(s, place[item_at[i] : item_at[i + 1]], spans[i])
                    if len(docs):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(docs), s.number)), pa.array(docs, pa.int32()), s.doc_id.take(pa.array(docs)),
                             pa.array([names[i]] * len(docs)), pa.array(n, pa.int64())],
                            ["segment", "ordinal", "doc_id", "item", "n_spans"])

    return staged(_dealt(index).mapInArrow(run, "segment long, ordinal int, doc_id long, item string, n_spans long"), "near")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near, a row per input row.

    n_near counts the items all of whose words stand, in any order, inside a span of twice their
    number; it does not make a document contaminated. A null or empty text has no words and is clean. Repeated rows and null ids each get
    their own result row; further columns of either table are not read.
    """
    index = build_index(docs, id_col, text_col)
    m = phrase_matches(index, items, width)
    near = proximity_matches(index, items).groupBy("segment", "ordinal").agg(F.count("*").alias("n_near"))
    discard(index)
    return m.join(near, ["segment", "ordinal"], "left").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, with the columns of ``docs``.

    A row is found again by its id and its text's checksum, so rows that share an id, or
    have none, keep verdicts of their own.
    """
    index = build_index(docs, id_col, text_col)
    m = phrase_matches(index, items, width).where("n_hit > 0")
    bad = staged(m.select(F.col("doc_id").alias("bad_id"), F.col("crc").alias("bad_crc")).distinct(), "contaminated")
    discard(index)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("bad_id")) & F.crc32(F.col(f"row.`{text_col}`")).eqNullSafe(F.col("bad_crc"))
    return own.join(bad, same, "left_anti").select("row.*")


def oracle(docs: str, items: str, width: int = 10) -> str:
    """The result of ``contamination`` in DuckDB's SQL by a join on whole windows, and on words for n_near."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words_of = f"COALESCE(regexp_extract_all(translate(text, '{up}', '{low}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    return f"""WITH d AS (SELECT doc_id, {words_of} AS w FROM {docs}),
 i AS (SELECT item_id, {words_of} AS w FROM {items}),
 q AS (SELECT DISTINCT item_id, LEAST({width}, len(w)) AS k, array_to_string(w[p:p + LEAST({width}, len(w)) - 1], ' ') AS win FROM (SELECT item_id, w, UNNEST(range(1, GREATEST(1, len(w) - {width} + 1) + 1)) AS p FROM i WHERE len(w) > 0)),
 n AS (SELECT DISTINCT k FROM q),
 v AS (SELECT doc_id, k, UNNEST(range(1, len(w) - k + 2)) AS p, w FROM d, n WHERE len(w) >= k),
 o AS (SELECT doc_id, p, k, item_id FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM v) JOIN q USING (k, win)),
 h AS (SELECT doc_id, COUNT(DISTINCT pos) AS n_hit FROM (SELECT doc_id, UNNEST(range(p, p + k)) AS pos FROM o) GROUP BY 1),
 x AS (SELECT item_id::VARCHAR AS item, UNNEST(w) AS word FROM i WHERE item_id IS NOT NULL),
 t AS (SELECT item, COUNT(DISTINCT word) AS kinds, 2 * COUNT(*) AS within FROM x GROUP BY 1),
 y AS (SELECT DISTINCT item, word FROM x),
 e AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(len(w))) AS p FROM d),
 c AS (SELECT doc_id, item FROM (SELECT DISTINCT doc_id, word FROM e) JOIN y USING (word) JOIN t USING (item) GROUP BY doc_id, item, kinds HAVING COUNT(*) = kinds),
 g AS (SELECT doc_id, item, word, p FROM c JOIN y USING (item) JOIN e USING (doc_id, word)),
 s AS (SELECT DISTINCT z.doc_id, item FROM g z JOIN t USING (item) JOIN g b USING (doc_id, item) WHERE b.p BETWEEN z.p - within + 1 AND z.p GROUP BY z.doc_id, item, z.p, kinds HAVING COUNT(DISTINCT b.word) = kinds),
 r AS (SELECT doc_id, COUNT(*) AS n_near FROM s GROUP BY 1),
 m AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM o) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items, sha256(COALESCE(list, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated, COALESCE(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id)"""
