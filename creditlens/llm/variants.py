"""Spelling variants of words by a trie of letter-group counts.

A word's vector counts its letters by group (code point modulo ``GROUPS``). Vectors in
group order form a trie; a word that differs by one inserted, deleted or replaced letter
has at most one more in one group (surplus) and one less in one group (deficit). A search
goes down the trie depth first with a budget of one each, and the words of the leaves that
it reaches are verified letter by letter.

The trie is dealt out by its subtrees: every word stands in the subtree of its first counts
and is sent as a query to each subtree that its budget can reach. A subtree with more than
``most`` words is divided by its next count, and the queries that stood before it go one
level further, until no subtree but a single vector is larger. Near words have the first
or the last ``EDGE`` letters in common (a word has at least twice as many), so a leaf's
words are compared by these only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, named, staged

GROUPS = 16
#: Counts that the first subtrees are named by.
TOP = 4
EDGE = 3
LETTERS = "a-zÀ-ÿ"
#: States and pairs of words that one step of a search takes at once.
_STEP = 1 << 17
#: Letters up to which words are compared side by side; longer ones one by one.
_WIDE = 48


def words_of(docs: DataFrame, id_col: str, text_col: str, every: int, least_letters: int, least_n: int) -> DataFrame:
    """word and n: the runs of letters after one letter has been taken from some of them."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    doc, text = F.coalesce(named(id_col, "doc_id").cast("string"), F.lit("")), F.translate(named(text_col, "text").cast("string"), up, low)
    runs = docs.select(doc.alias("doc_id"), F.explode(F.split(text, f"[^{LETTERS}]+")).alias("run")).where(F.length("run") >= least_letters)
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substr(run, 1, CAST(h % length(run) AS INT))"), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")
    found = runs.select("run", h.alias("h")).select(word).where(F.length("word") >= least_letters)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _letters(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all below 256) of strings, and where each string starts and ends."""
    raw = [w.encode("latin-1") for w in array.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw], dtype=np.int64)])


def _vectors(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts by group; they stop at 250, which never takes two words further apart."""
    n = len(at) - 1
    cell = np.repeat(np.arange(n), np.diff(at)) * GROUPS + letters % GROUPS
    return np.minimum(np.bincount(cell, minlength=n * GROUPS), 250).astype(np.uint8).reshape(n, GROUPS)


def _with_vectors(words: DataFrame) -> DataFrame:
    """word, n and vector (a string of ``GROUPS`` two-digit hexadecimal counts)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                text = _vectors(*_letters(batch.column(0))).tobytes().hex()
                hexed = [text[i : i + 2 * GROUPS] for i in range(0, len(text), 2 * GROUPS)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hexed)], ["word", "n", "vector"])

    return words.mapInArrow(run, "word string, n long, vector string")


def _count(depth: int, off: int = 0):
    """The two digits of a word's count at ``depth``, plus ``off``."""
    own = F.conv(F.substring("vector", 2 * depth + 1, 2), 16, 10).cast("int") + off
    return F.lpad(F.lower(F.hex(own)), 2, "0")


def _steps(states: DataFrame, depth: int) -> DataFrame:
    """States (word, n, vector, node, surplus and deficit left) one level further down."""
    own = F.conv(F.substring("vector", 2 * depth + 1, 2), 16, 10).cast("int")
    step = lambda off, s, d: F.struct(F.concat("node", _count(depth, off)).alias("node"), (F.col("surplus") - s).alias("surplus"), (F.col("deficit") - d).alias("deficit"))
    ways = F.array(step(0, 0, 0), F.when(F.col("surplus") > 0, step(1, 1, 0)), F.when((F.col("deficit") > 0) & (own > 0), step(-1, 0, 1)))
    out = states.select("word", "n", "vector", F.explode(ways).alias("to")).where("to IS NOT NULL")
    return out.select("word", "n", "vector", "to.node", "to.surplus", "to.deficit")


def _placed(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Words with the subtree (node) that each stands in, and states: queries with the subtrees that they search."""
    inside = words.withColumn("node", F.substring("vector", 1, 2 * TOP))
    states = words.select("word", "n", "vector", F.lit("").alias("node"), F.lit(1).alias("surplus"), F.lit(1).alias("deficit"))
    for depth in range(TOP):
        states = _steps(states, depth)
    done, asked = [], []
    for depth in range(TOP, GROUPS):
        full = staged(inside.groupBy("node").count().where(F.col("count") > most).select("node"), "overfull")
        if full.isEmpty():
            break
        done.append(inside.join(full, "node", "left_anti"))
        asked.append(states.join(full, "node", "left_anti"))
        inside = staged(inside.join(full, "node", "left_semi").select("word", "n", "vector", F.concat("node", _count(depth)).alias("node")), "divided")
        states = staged(_steps(states.join(full, "node", "left_semi"), depth), "states")
    for a in done:
        inside = inside.unionByName(a)
    for a in asked:
        states = states.unionByName(a)
    return inside, states


class _Trie:
    """The words of one subtree, sorted by what remains of their vectors."""

    def __init__(self, vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1]) if vectors.shape[1] else np.arange(len(vectors))
        node, self.keys = np.zeros(len(order), np.int64), []
        for level in range(vectors.shape[1]):
            keys, node = np.unique(node << 8 | vectors[order, level], return_inverse=True)
            self.keys.append(keys)
        self.leaf = np.empty(len(order), np.int64)
        self.leaf[order] = node

    def search(self, vectors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray):
        """(query, leaf) in pieces: each leaf that a query's budget reaches, depth first."""
        first = np.arange(len(vectors))
        stack = [(0, first, np.zeros(len(first), np.int64), surplus, deficit)]
        while stack:
            level, q, node, s, d = stack.pop()
            if len(q) > _STEP:
                half = len(q) // 2
                stack += [(level, q[half:], node[half:], s[half:], d[half:]), (level, q[:half], node[:half], s[:half], d[:half])]
                continue
            if level == len(self.keys):
                yield q, node
                continue
            own, keys = vectors[q, level].astype(np.int64), self.keys[level]
            more, less = np.flatnonzero(s > 0), np.flatnonzero((d > 0) & (own > 0))
            way = np.concatenate([np.arange(len(q)), more, less])
            off = np.repeat(np.array([0, 1, -1]), [len(q), len(more), len(less)])
            want = node[way] << 8 | (own[way] + off)
            to = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = np.flatnonzero(keys[to] == want)
            way, off = way[ok], off[ok]
            if len(ok):
                stack.append((level + 1, q[way], to[ok], s[way] - (off > 0), d[way] - (off < 0)))


def _edges(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last ``EDGE`` letters of each word as numbers."""
    place = np.int64(256) ** np.arange(EDGE)
    return letters[at[:-1, None] + np.arange(EDGE)] @ place, letters[at[1:, None] - 1 - np.arange(EDGE)] @ place


def _is_near(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes ``a`` of ``b``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) == 1 and a[same:] == b[same + 1 :]


def _verified(a, b, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs x[i], y[i] of the word lists ``a`` and ``b`` (letters, at): whether they are near."""
    out = np.zeros(len(x), bool)
    la, lb = np.diff(a[1])[x], np.diff(b[1])[y]
    close = np.abs(la - lb) <= 1
    wide = np.maximum(la, lb) > _WIDE
    for i in np.flatnonzero(close & wide):
        out[i] = _is_near(*(t[0][t[1][k] : t[1][k + 1]].tobytes() for t, k in ((a, x[i]), (b, y[i]))))
    take = np.flatnonzero(close & ~wide)
    x, y, la, lb = x[take], y[take], la[take], lb[take]
    column = np.arange(_WIDE)

    def side(t, k, size, back):
        place = t[1][k + 1, None] - 1 - column if back else t[1][k, None] + column
        return np.where(column < size[:, None], t[0][np.clip(place, 0, len(t[0]) - 1)], 0)

    differ = side(a, x, la, False) != side(b, y, lb, False)
    apart = differ.sum(axis=1)
    head = np.where(apart > 0, differ.argmax(axis=1), _WIDE)
    differ = side(a, x, la, True) != side(b, y, lb, True)
    tail = np.where(differ.any(axis=1), differ.argmax(axis=1), _WIDE)
    out[take] = np.where(la == lb, apart == 1, head + tail >= np.minimum(la, lb))
    return out


def _pairs(trie: _Trie, words, queries, states):
    """(query, word) of all near words, in pieces."""
    edges, own = _edges(*words), _edges(*queries)
    tables = []
    for side in (0, 1):
        key = trie.leaf << (8 * EDGE) | edges[side]
        order = np.argsort(key, kind="stable")
        tables.append((key[order], order))
    for q, leaf in trie.search(*states):
        for side, (keys, order) in enumerate(tables):
            want = leaf << (8 * EDGE) | own[side][q]
            lo = np.searchsorted(keys, want)
            size = np.searchsorted(keys, want, "right") - lo
            cut = np.concatenate([[0], np.cumsum(size)])
            for a in range(0, int(cut[-1]), _STEP):
                at = np.arange(a, min(a + _STEP, int(cut[-1])))
                which = np.searchsorted(cut, at, "right") - 1
                x, y = q[which], order[lo[which] + at - cut[which]]
                if side:  # pairs with the same first letters have been met
                    new = own[0][x] != edges[0][y]
                    x, y = x[new], y[new]
                ok = _verified(queries, words, x, y)
                yield x[ok], y[ok]


def near_words(words: DataFrame, most: int) -> DataFrame:
    """word, n_near and best (a struct of -n and the word) of the words that have near ones."""
    inside, states = _placed(words, most)
    both = inside.select("node", "word", "n", "vector", F.lit(-1).alias("surplus"), F.lit(-1).alias("deficit"))
    both = both.unionByName(states.select("node", "word", "n", "vector", "surplus", "deficit"))

    def run(group: pa.Table) -> pa.Table:
        surplus, deficit = (group[c].to_numpy() for c in ("surplus", "deficit"))
        depth = len(group["node"][0].as_py())
        mine, asked = np.flatnonzero(surplus < 0), np.flatnonzero(surplus >= 0)
        take = lambda name, rows: group[name].combine_chunks().take(pa.array(rows))
        n_near, best = np.zeros(len(asked), np.int64), np.full(len(asked), -1)
        if len(mine):
            words, queries = _letters(take("word", mine)), _letters(take("word", asked))
            rest = lambda t: _vectors(*t)[:, depth // 2 :]
            n = take("n", mine).to_numpy()
            order = sorted(range(len(mine)), key=take("word", mine).to_pylist().__getitem__)
            rank = np.empty(len(mine), np.int64)  # the smaller, the better a form
            rank[np.array(order)[np.argsort(-n[order], kind="stable")]] = np.arange(len(mine))
            lowest = np.full(len(asked), len(mine))
            for x, y in _pairs(_Trie(rest(words)), words, queries, (rest(queries), surplus[asked], deficit[asked])):
                np.add.at(n_near, x, 1)
                np.minimum.at(lowest, x, rank[y])
            of = np.empty(len(mine), np.int64)
            of[rank] = np.arange(len(mine))
            best = np.where(n_near > 0, of[np.minimum(lowest, len(mine) - 1)], -1)
        some = np.flatnonzero(n_near)
        near = mine[best[some]] if len(some) else some
        return pa.table({"word": take("word", asked[some]), "n_near": n_near[some], "best_n": take("n", near).cast(pa.int64()), "best": take("word", near)})

    found = both.groupBy("node").applyInArrow(run, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of the words that have a form, by doubling the steps taken along forms."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("top"))
        new = staged(now.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        discard(now)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        now = new


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_letters: int = 2 * EDGE,
             least_n: int = 5, ratio: int = 5, most: int = 20_000) -> DataFrame:
    """word, form, root, n, n_near and form_n: every word with its spelling variants grouped.

    A null or empty text, or one without letters, has no words. A null id counts as an empty
    one when a run's checksum is taken; repeated rows count again. Of near words with the same
    n the smallest is the form. An empty table gives no rows. Other columns are not read.
    """
    if least_letters < 2 * EDGE:
        raise ValueError(f"words need {2 * EDGE} letters at least")
    words = staged(_with_vectors(words_of(docs, id_col, text_col, every, least_letters, least_n)), "words")
    near = words.join(near_words(words, most), "word", "left")
    has = -F.col("best.n") >= ratio * F.col("n")
    out = near.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.n")).alias("form_n"))
    out = staged(out, "variants")
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
