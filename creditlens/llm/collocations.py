"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word from their first word. All words and all pairs of neighbouring
frequent words are counted first, as any pair may still start a perfect collocation. From
then on a pair p with first word w is a branch: a longer phrase that starts with p occurs
F = f(p) times at most, and its cut after w scores no more than floor(scale * F / (f(w) + F)),
which is the branch's bound. Each round expands, per language, the branches whose bound
reaches the score of the candidate at a place that doubles from round to round, and counts
what the best candidates still need to be settled: their extensions to both sides, which
decide whether a longer phrase swallows them, and the last three words of a four-word phrase,
whose count its lowest cut may need (until then its other cuts bound its score). It ends where
the language's first ``top`` surviving scores, ties included, are settled and no branch or
open candidate can reach them. Branches below are never counted.

A count is one pass over the texts: each task adds up its phrases and the sums are shuffled.
Words are 64-bit hashes with their language (words.py). Which phrases a pass counts is told
by bitmaps of a fixed size (bitmaps.py); what they let through beyond is counted exactly, too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .bitmaps import bitmap, loaded, may_hold
from .common import discard, named, staged, text_blocks

BITS = 26
#: Words or phrases that a task gathers before it adds them up.
_GATHERED = 1 << 21
_BREAK = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LONGER = ("t1", "t2", "t3", "t4")


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(named(lang_col, "lang").cast("string"), F.lit("und")).alias("lang"), named(text_col, "text").cast("string").alias("text"))


def _blocks(batch):
    """(first row, bytes, starts, ends, rows, terms, breaks) of blocks of texts; breaks[i]: word i + 1 does not go on after word i."""
    names = batch.column(0).to_pylist()
    known = {x: _lang_hash(x) for x in set(names)}
    own = np.array([known[x] for x in names], np.uint64)
    for lo, hi, data, offsets in text_blocks(batch.column(1)):
        starts, ends, rows = words.spans(data, offsets, _WORD)
        size = np.diff(rows)
        terms = words.mix(words.hashes(data, starts, ends, folded=True) + np.repeat(own[lo:hi], size))
        breaks = np.ones(len(starts), bool)
        if len(starts):
            cut = np.concatenate([[0], np.cumsum(_BREAK[data], dtype=np.int64)])
            breaks[:-1] = cut[starts[1:]] > cut[ends[:-1]]
            breaks[(rows[1:] - 1)[size > 0]] = True
        yield lo, data, starts, ends, rows, terms, breaks


def _words(texts: DataFrame) -> DataFrame:
    """term, lang, word and f of every distinct word of a language."""

    def added(parts):
        terms, at = np.concatenate([p[0] for p in parts]), np.cumsum([0] + [len(p[0]) for p in parts])
        unique, first, n = np.unique(terms, return_index=True, return_counts=True)
        part = np.searchsorted(at, first, "right") - 1
        text, lang = [], []
        for k, i in zip(part.tolist(), (first - at[part]).tolist()):
            _, starts, ends, raw, row, names = parts[k]
            text.append(words._lower(raw[starts[i] : ends[i]]).decode("utf-8", "replace"))
            lang.append(names[np.searchsorted(row, i, "right") - 1])
        return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(lang, pa.string()), pa.array(text, pa.string()), pa.array(n, pa.int64())], ["term", "lang", "word", "f"])

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, data, starts, ends, rows, terms, _ in _blocks(batch):
                parts.append((terms, starts, ends, data.tobytes(), rows, names[lo:]))
                n += len(terms)
                if n >= _GATHERED:
                    yield added(parts)
                    parts, n = [], 0
        if n:
            yield added(parts)

    found = texts.mapInArrow(run, "term long, lang string, word string, f long")
    return found.groupBy("term").agg(F.first("lang").alias("lang"), F.min("word").alias("word"), F.sum("f").alias("f"))


def _grams(terms: np.ndarray, breaks: np.ndarray, good: np.ndarray):
    """Keys of the pairs, threes and fours that start at each word, and which of them lie in a piece and have frequent words only."""
    keys, ok = [terms], [good]
    for size in (2, 3, 4):
        n = max(0, len(terms) - size + 1)
        keys.append(words.chained(terms, size, 60 + size) if n else terms[:0])
        ok.append(ok[-1][:n] & good[size - 1 :][:n] & ~breaks[size - 2 :][:n])
    return keys, ok


def _added(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Sums over equal keys (the first array of each part); the other arrays depend on the key."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    _, first, n = np.unique(columns[0], return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([*[pa.array(c[first].view(np.int64)) for c in columns], pa.array(n, pa.int64())], [*names, "n"])


def _gathered(batches, pick, names):
    parts, n = [], 0
    for batch in batches:
        for block in _blocks(batch):
            parts += (found := pick(block[5], block[6]))
            n += sum(len(p[0]) for p in found)
            if n >= _GATHERED:
                yield _added(parts, names)
                parts, n = [], 0
    if n:
        yield _added(parts, names)


def _pairs(texts: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """key, t1, t2 and a of the pairs of neighbouring frequent words that occur ``least`` times."""
    path = frequent.staged_at

    def run(batches):
        good = loaded(path, BITS)

        def pick(terms, breaks):
            keys, ok = _grams(terms, breaks, may_hold(good, terms, BITS))
            at = np.flatnonzero(ok[1])
            return [(keys[1][at], terms[at], terms[at + 1])]

        yield from _gathered(batches, pick, ["key", "t1", "t2"])

    sums = texts.mapInArrow(run, "key long, t1 long, t2 long, n long")
    return sums.groupBy("key").agg(F.first("t1").alias("t1"), F.first("t2").alias("t2"), F.sum("n").alias("a")).where(F.col("a") >= least)


def _longer(texts: DataFrame, pairs: DataFrame, wanted: dict[str, DataFrame], least: int) -> DataFrame:
    """size, key, pre and suf (keys without the last and the first word), t1 to t4 and a.

    Threes and fours of frequent pairs whose first pair is in ``right``, threes whose last pair
    is in ``left2`` or that are in ``exact``, fours whose last three are in ``left3``.
    """
    paths = {k: t.staged_at for k, t in wanted.items()}
    frequent = pairs.staged_at
    names = ["key", "size", "pre", "suf", *_LONGER]

    def run(batches):
        good = loaded(frequent, BITS)
        sets = {k: loaded(p, BITS) for k, p in paths.items()}
        hit = lambda name, keys: may_hold(sets[name], keys, BITS)

        def pick(terms, breaks):
            keys, ok = _grams(terms, breaks, np.ones(len(terms), bool))
            two = ok[1] & may_hold(good, keys[1], BITS)
            right, out = two & hit("right", keys[1]), []
            three = two[: len(keys[2])] & two[1:][: len(keys[2])] & ok[2]
            four = three[: len(keys[3])] & two[2:][: len(keys[3])] & ok[3]
            left = two & hit("left2", keys[1])
            at3 = np.flatnonzero(three & (right[: len(three)] | left[1:][: len(three)] | hit("exact", keys[2])))
            at4 = np.flatnonzero(four)
            at4 = at4[right[at4] | hit("left3", keys[2][at4 + 1])]
            for size, at in ((3, at3), (4, at4)):
                columns = [terms[at + i] if i < size else np.zeros(len(at), np.uint64) for i in range(4)]
                out.append((keys[size - 1][at], np.full(len(at), size, np.uint64), keys[size - 2][at], keys[size - 2][at + 1], *columns))
            return out

        yield from _gathered(batches, pick, names)

    sums = texts.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    out = sums.groupBy("key").agg(*[F.first(c).alias(c) for c in names[1:]], F.sum("n").alias("a"))
    return out.where(F.col("a") >= least)


def _cut(cuts: list[tuple[int, str, str]], scale: int):
    """The lowest-scoring of cuts (k, count before, count after); cuts with an unknown count are left out."""
    one = [F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.expr(f"CAST({scale} AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) div (CAST({x} AS DECIMAL(20,0)) + CAST({y} AS DECIMAL(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))) for k, x, y in cuts]
    return F.least(*one) if len(one) > 1 else one[0]


def _scored(pairs: DataFrame, grams: DataFrame, vocabulary: DataFrame, scale: int) -> DataFrame:
    """The threes and fours in ``grams`` with lang, score (a bound if not exact), l, r and whether it is exact."""
    of_word = lambda t, name: vocabulary.select(F.col("term").alias(t), F.col("f").alias(name))
    counts = pairs.select("t1", "t2", "a")
    two = lambda x, y, name: counts.select(F.col("t1").alias(x), F.col("t2").alias(y), F.col("a").alias(name))
    known = grams.select(F.col("key").alias("part"), F.col("a").alias("f_part"))
    three = grams.where("size = 3").join(of_word("t1", "f1").join(vocabulary.select(F.col("term").alias("t1"), "lang"), "t1"), "t1").join(of_word("t3", "f3"), "t3")
    three = three.join(two("t1", "t2", "f12"), ["t1", "t2"]).join(two("t2", "t3", "f23"), ["t2", "t3"])
    three = three.select("lang", "size", "key", "pre", "suf", *_LONGER, "a", _cut([(1, "f1", "f23"), (2, "f12", "f3")], scale).alias("cut"), F.lit(True).alias("exact"))
    four = grams.where("size = 4").join(of_word("t1", "f1").join(vocabulary.select(F.col("term").alias("t1"), "lang"), "t1"), "t1").join(of_word("t4", "f4"), "t4")
    four = four.join(two("t1", "t2", "f12"), ["t1", "t2"]).join(two("t3", "t4", "f34"), ["t3", "t4"])
    four = four.join(known.select(F.col("part").alias("pre"), F.col("f_part").alias("f123")), "pre", "left").join(known.select(F.col("part").alias("suf"), F.col("f_part").alias("f234")), "suf", "left")
    four = four.select("lang", "size", "key", "pre", "suf", *_LONGER, "a", _cut([(1, "f1", "f234"), (2, "f12", "f34"), (3, "f123", "f4")], scale).alias("cut"), (F.col("f123").isNotNull() & F.col("f234").isNotNull()).alias("exact"))
    return three.unionByName(four).select("lang", "size", "key", "pre", "suf", *_LONGER, "a", "cut.score", "cut.l", "cut.r", "exact")


def _nth(rows: DataFrame, n: int, name: str) -> DataFrame:
    """lang and the ``n``-th highest score of languages that have as many rows."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), "key")
    ranked = rows.select("lang", "key", "score").withColumn("at", F.row_number().over(w)).where(F.col("at") <= n)
    return ranked.where(F.col("at") == n).select("lang", F.col("score").alias(name))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 2000, least: int = 30,
                 scale: int = 2_000_000, swallow: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases of 2 to 4 words.

    Rows without a language are of the language ``und``. A null or empty text has no words;
    repeated rows count again; equal scores and counts are ranked by the phrase's bytes.
    An empty table, or a language without a phrase that occurs ``least`` times, gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col)
    counted = staged(_words(texts), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    vocabulary = staged(counted.where(F.col("f") >= least), "vocabulary")
    frequent = bitmap(vocabulary.select("term"), BITS)
    pairs = _pairs(texts, frequent, least)
    one = lambda t, f: vocabulary.select(F.col("term").alias(t), F.col("f").alias(f))
    pairs = pairs.join(one("t1", "f1").join(vocabulary.select(F.col("term").alias("t1"), "lang"), "t1"), "t1").join(one("t2", "f2"), "t2")
    pairs = pairs.select("lang", "key", "t1", "t2", "a", _cut([(1, "f1", "f2")], scale).alias("cut"), F.expr(f"CAST({scale} AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(f1 AS DECIMAL(20,0)) + CAST(a AS DECIMAL(20,0)))").alias("bound"))
    pairs = staged(pairs.select("lang", "key", "t1", "t2", "a", "cut.score", "cut.l", "cut.r", "bound"), "pairs")
    pair_bits = bitmap(pairs.select("key"), BITS)

    none = staged(spark.createDataFrame([], "key long"), "none")
    grams = staged(spark.createDataFrame([], "key long, size long, pre long, suf long, t1 long, t2 long, t3 long, t4 long, a long"), "grams")
    asked = {k: none for k in ("right", "left2", "left3", "exact")}
    place = top
    while True:
        scored = _scored(pairs, grams, vocabulary, scale)
        mine = pairs.select("lang", F.lit(2).cast("long").alias("size"), "key", F.lit(0).cast("long").alias("pre"), F.lit(0).cast("long").alias("suf"), "t1", "t2", F.lit(0).cast("long").alias("t3"), F.lit(0).cast("long").alias("t4"), "a", "score", "l", "r", F.lit(True).alias("exact"))
        longest = grams.select(F.col("pre").alias("key"), "a").union(grams.select("suf", "a")).groupBy("key").agg(F.max("a").alias("longer"))
        both = mine.unionByName(scored).join(longest, "key", "left").where(f"longer IS NULL OR 100 * longer < {swallow} * a").drop("longer")
        has = lambda name, key, flag: asked[name].select(F.col("key").alias(key), F.lit(True).alias(flag))  # noqa: E731, B023
        first = pairs.select(F.col("key").alias("first"), "t1", "t2")
        both = both.join(first, ["t1", "t2"]).join(has("right", "first", "r_done"), "first", "left").join(has("left2", "key", "l2_done"), "key", "left").join(has("left3", "key", "l3_done"), "key", "left")
        both = both.withColumn("r_done", F.coalesce("r_done", F.lit(False))).withColumn("l_done", (F.col("size") == 4) | F.coalesce("l2_done", "l3_done", F.lit(False)))
        known = staged(both.withColumn("settled", F.col("exact") & F.col("l_done") & (F.col("r_done") | (F.col("size") == 4))).drop("l2_done", "l3_done"), "known")
        branches = pairs.join(asked["right"], "key", "left_anti").select("lang", "key", "bound")
        # What could still be among the first: settled survivors set the mark.
        mark = _nth(known.where("settled"), top, "mark")
        open_ = known.where("NOT settled").join(mark, "lang", "left").where("mark IS NULL OR score >= mark")
        open_branches = branches.join(mark, "lang", "left").where("mark IS NULL OR bound >= mark")
        # Of that, the best: as good as the candidate at the round's place.
        goal = _nth(known, place, "goal")
        best = staged(open_.join(goal, "lang", "left").where("goal IS NULL OR score >= goal").select("size", "key", "first", "suf", "exact", "l_done", "r_done"), "best")
        grow = staged(open_branches.join(goal, "lang", "left").where("goal IS NULL OR bound >= goal").select("key"), "grow")
        if best.isEmpty() and grow.isEmpty():
            if open_.isEmpty() and open_branches.isEmpty():
                break
            place *= 2
            discard(known)
            continue
        new = {
            "right": grow.union(best.where("size < 4 AND NOT r_done").select("first")).distinct(),
            "left2": best.where("size = 2 AND NOT l_done").select("key"),
            "left3": best.where("size = 3 AND NOT l_done").select("key"),
            "exact": best.where("NOT exact").select(F.col("suf").alias("key")).distinct(),
        }
        new = {k: staged(t, k) for k, t in new.items()}
        found = _longer(texts, pair_bits, {k: bitmap(t, BITS) for k, t in new.items()}, least)
        old, grams = grams, staged(grams.union(found.select(grams.columns)).dropDuplicates(["key"]), "grams")
        asked = {k: staged(t.union(new[k]).distinct(), k) for k, t in asked.items()}
        place *= 2
        for t in (old, known, best, grow):
            discard(t)

    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    sure = known.where("settled").join(mark, "lang", "left").where("mark IS NULL OR score >= mark")
    named_ = sure
    for t in _LONGER:
        named_ = named_.join(vocabulary.select(F.col("term").alias(t), F.col("word").alias(f"{t}_word")), t, "left")
    phrase = F.concat_ws(" ", *[f"{t}_word" for t in _LONGER])
    out = named_.select("lang", phrase.alias("phrase"), "a", "l", "r", F.col("score").cast("long").alias("score"))
    out = out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(table: str, top: int = 2000, least: int = 30, scale: int = 2_000_000, swallow: int = 80) -> str:
    """The same rows in DuckDB's SQL by counting every phrase of one to four words."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH p AS (SELECT COALESCE(lang, 'und') AS lang, UNNEST(string_split_regex(translate(COALESCE(text, ''), '{up}', '{low}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {table}),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
 g AS (SELECT lang, w, k, UNNEST(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k),
 f AS (SELECT lang, w[i:i + k - 1] AS g, k, COUNT(*)::HUGEINT AS a FROM g GROUP BY ALL),
 n AS (SELECT lang, SUM(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
 c AS (SELECT * FROM f WHERE k > 1 AND a >= {least}),
 u AS (SELECT lang, g, k, a, UNNEST(range(1, k)) AS cut FROM c),
 s AS (SELECT u.lang, u.g, u.k, u.a, cut, x.a AS l, y.a AS r, {scale}::HUGEINT * u.a // (x.a + y.a) AS score FROM u
  JOIN f x ON x.lang = u.lang AND x.g = u.g[1:cut] JOIN f y ON y.lang = u.lang AND y.g = u.g[cut + 1:u.k]),
 b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
 e AS (SELECT lang, g[2:k] AS g, a FROM c WHERE k > 2 UNION ALL SELECT lang, g[1:k - 1], a FROM c WHERE k > 2
  UNION ALL SELECT lang, g[2:3], a FROM c WHERE k = 4 UNION ALL SELECT lang, g[1:2], a FROM c WHERE k = 4 UNION ALL SELECT lang, g[3:4], a FROM c WHERE k = 4),
 m AS (SELECT lang, g, MAX(a) AS longer FROM e GROUP BY ALL),
 t AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, l, r, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE longer IS NULL OR 100 * longer < {swallow} * b.a),
 o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= {top}"""
