"""Quality rules on repetition and on how well a public vocabulary fits a text.

Each word (a run between ASCII white space) is encoded on its own with a public
SentencePiece vocabulary with byte fallback. Three figures of a text follow:
characters per token, the share of byte-fallback tokens and the entropy of its
token distribution in bits. Figures first lose their language's trend with the text's
length. A text is rejected where a figure then leaves the band of its language and
length (the octave of its word count), blended with the bands above it by the number of
texts, without a least count. Bands are medians and median absolute deviations over all
texts of the table that pass the base rules, exact on figures rounded to a thousandth:
counts per rounded value are summed before any ranking, so a language with most of the
rows costs no more than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import words
from .common import named, staged, text_blocks

#: Deviations (in scaled MADs) that a figure may be below and above its band's median.
BANDS = {"chars_per_token": (6.0, 8.0), "token_entropy": (4.0, 8.0), "byte_share": (None, 10.0)}
#: Least scaled MAD, so that a uniform group does not reject harmless differences.
LEAST_DEVIATION = {"chars_per_token": 0.02, "token_entropy": 0.05, "byte_share": 0.004}
#: Texts that the band above counts in the blend with a group's own band.
PRIOR = 50
#: Doublings of one word at which adjusted figures stand: 256 words.
AT = 8
#: Rejected too: figures that are low together, by the sum of their deviations.
JOINT = -6.0

_FIGURES = list(BANDS)
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
_LINE = np.arange(256) != 0x0A

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]
_STATS = ", ".join(f"{c} long" for c in _COUNTS) + ", chars_per_token double, byte_share double, token_entropy double"


class Vocabulary:
    """Tokens of single words under a SentencePiece model, remembered by the words' hashes."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.memory = words.TokenMemory()

    def _encode(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        lists = self.model.encode(texts, num_threads=1)
        return [i for x in lists for i in x], np.array([len(x) for x in lists], np.int64)

    def tokens(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in turn, and how many each word has."""
        return self.memory.tokens(data, starts, ends, h, self._encode)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure_block(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    n_rows = len(offsets) - 1
    starts, ends, rows = words.spans(data, offsets, words.SPACED)
    h = words.hashes(data, starts, ends, folded=False)
    tokens, per_word = vocabulary.tokens(data, starts, ends, h)
    token_at = np.concatenate([[0], np.cumsum(per_word)])[rows]
    windows = words.chained(h, 3, 7)
    l_start, l_end, l_rows = words.spans(data, offsets, _LINE)
    with_word = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    line = words.hashes(data, l_start, l_end, folded=False)
    out = {c: np.zeros(n_rows, np.int64) for c in _COUNTS} | {c: np.full(n_rows, np.nan) for c in _FIGURES}
    out["n_words"] = np.diff(rows)
    out["word_chars"] = _per_row((_CODE_POINT & words.SPACED)[data], offsets)
    out["n_symbols"] = _per_row(_SYMBOLS[data], offsets)
    out["n_tokens"] = np.diff(token_at)
    fallback = vocabulary.fallback[tokens]
    for i in range(n_rows):
        lo, hi = rows[i], rows[i + 1]
        if hi - lo >= 3:
            _, which, count = np.unique(windows[lo : hi - 2], return_inverse=True, return_counts=True)
            twice = count[which] > 1
            hit = np.zeros(hi - lo, bool)
            for k in range(3):
                hit[k : k + len(twice)] |= twice
            out["n_repeat_words"][i] = hit.sum()
        own = line[l_rows[i] : l_rows[i + 1]][with_word[l_rows[i] : l_rows[i + 1]]]
        out["n_dup_lines"][i] = len(own) - len(np.unique(own))
        t = slice(token_at[i], token_at[i + 1])
        if n := token_at[i + 1] - token_at[i]:
            p = np.unique(tokens[t], return_counts=True)[1] / n
            out["token_entropy"][i] = abs(-(p * np.log2(p)).sum())
            out["byte_share"][i] = fallback[t].sum() / n
            out["chars_per_token"][i] = out["word_chars"][i] / n
    return out


def measured(docs: DataFrame, model: str, text_col: str = "text", lang_col: str | None = "lang", carried: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the carried columns, all by default), lang and the figures of every row."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carried is None else carried)]).alias("row")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None), F.lit("")).alias("lang")
    taken = docs.select(row, lang, named(text_col, "text"))
    out = StructType([*taken.select("row", "lang").schema.fields, *StructType.fromDDL(_STATS).fields])

    def run(batches):
        # The task's own: a worker lives on for later steps, which would have its memory on top of theirs.
        vocabulary = Vocabulary(model)
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                m = measure_block(data, offsets, vocabulary)
                figures = [pc.if_else(pc.is_nan(pa.array(m[c])), pa.scalar(None, pa.float64()), pa.array(m[c])) for c in ("chars_per_token", "byte_share", "token_entropy")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *[pa.array(m[c], pa.int64()) for c in _COUNTS], *figures],
                    ["row", "lang", *_COUNTS, "chars_per_token", "byte_share", "token_entropy"])

    return taken.mapInArrow(run, out)


def _length():
    """Doublings of one word that a text is long."""
    return F.log2(F.greatest(F.col("n_words"), F.lit(1)))


def _long(stats: DataFrame, figures: dict) -> DataFrame:
    """lang, octave, n_words, figure and v, its value in thousandths."""
    pairs = F.array(*[F.struct(F.lit(f).alias("figure"), F.round(c * 1000).cast("long").alias("v")) for f, c in figures.items()])
    return stats.select("lang", "octave", "n_words", F.explode(pairs).alias("x")).select("lang", "octave", "n_words", "x.figure", "x.v")


def _adjusted(figure: str):
    """The figure without its language's trend, as it would be at the length ``AT``."""
    return F.col(figure) - F.col(f"{figure}_slope") * (_length() - AT)


def _median(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Lower median of ``value`` with multiplicity ``n``, per key: a window over distinct rounded values."""
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("below", F.sum("n").over(w.orderBy(value))).withColumn("all", F.sum("n").over(w))
    return ranked.where(2 * F.col("below") >= F.col("all")).groupBy(*keys).agg(F.min(value).alias(name))


def trends(stats: DataFrame) -> DataFrame:
    """lang and, per figure, how much it grows when the number of words doubles.

    The slope through the octaves' medians, weighted by their texts; that of all languages
    together counts in each as ``PRIOR`` texts an octave off."""
    long = _long(stats.where(~F.col("base_failed")), {f: F.col(f) for f in _FIGURES})
    counts = staged(long.groupBy("lang", "octave", "figure", "v").agg(F.count("*").alias("n"), F.sum(F.round(_length() * 1000).cast("long")).alias("x")), "figures")
    keys = ["lang", "octave", "figure"]
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("x") / F.sum("n") / 1000).alias("x"))
    points = _median(counts, keys, "v", "median").join(sizes, keys).withColumn("y", F.col("median") / 1000)
    sums = points.groupBy("lang", "figure").agg(F.sum("n").alias("w"), *[F.sum(F.col("n") * F.expr(e)).alias(c) for c, e in (("sx", "x"), ("sy", "y"), ("sxx", "x * x"), ("sxy", "x * y"))])
    own = sums.select("lang", "figure", (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("w")).alias("xx"), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("w")).alias("xy"))
    shared = own.groupBy("figure").agg((F.sum("xy") / (F.sum("xx") + PRIOR)).alias("shared"))
    slope = F.round((F.col("xy") + PRIOR * F.col("shared")) / (F.col("xx") + PRIOR), 6)
    return own.join(shared, "figure").groupBy("lang").pivot("figure", _FIGURES).agg(F.first(slope))


def bands(stats: DataFrame) -> DataFrame:
    """lang, octave and, per figure: median and scaled MAD of the figures at the length ``AT``.

    A group's band is its own blended with that of the level above, octave with language and
    language with table, by its number of texts: smoothly, and alike at every size. The level
    of a language gives way to the table's only as far as languages differ little from each
    other; its MAD, and an octave's band, count the level above as ``PRIOR`` texts."""
    long = _long(stats.where(~F.col("base_failed")), {f: _adjusted(f) for f in _FIGURES})
    counts = staged(long.groupBy("lang", "octave", "figure", "v").agg(F.count("*").alias("n")), "adjusted")

    def level(keys: list[str], k: int) -> DataFrame:
        c = counts.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
        mid = _median(c, keys, "v", "median")
        off = c.join(mid, keys).groupBy(*keys, F.abs(F.col("v") - F.col("median")).alias("d")).agg(F.sum("n").alias("n"))
        found = mid.join(_median(off, keys, "d", "mad"), keys).join(c.groupBy(*keys).agg(F.sum("n").alias("n")), keys)
        return found.select(*keys, (F.col("median") / 1000).alias(f"m{k}"), (F.col("mad") * 1.4826 / 1000).alias(f"d{k}"), F.col("n").alias(f"n{k}"))

    octave, lang, table = staged(level(["lang", "octave", "figure"], 0), "octaves"), staged(level(["lang", "figure"], 1), "languages"), level(["figure"], 2)
    floor = F.create_map(*[F.lit(x) for f in _FIGURES for x in (f, LEAST_DEVIATION[f])])[F.col("figure")]
    # What a text's figure differs from its language's, and languages from the table.
    off = counts.join(lang.select("lang", "figure", "m1"), ["lang", "figure"]).groupBy("figure", F.abs(F.col("v") - F.round(F.col("m1") * 1000).cast("long")).alias("d")).agg(F.sum("n").alias("n"))
    within = _median(off, ["figure"], "d", "within").select("figure", F.greatest(F.col("within") * 1.4826 / 1000, floor).alias("within"))
    between = lang.join(table, "figure").groupBy("figure").agg(F.avg((F.col("m1") - F.col("m2")) * (F.col("m1") - F.col("m2"))).alias("between"))
    best = octave.join(lang.join(table.select("figure", "m2"), "figure").join(within, "figure").join(between, "figure"), ["lang", "figure"])
    blend = lambda n, own, above: (F.col(n) * own + PRIOR * above) / (F.col(n) + PRIOR)
    weight, noise = F.col("n1") * F.col("between"), F.col("within") * F.col("within")
    best = best.withColumn("ml", (weight * F.col("m1") + noise * F.col("m2")) / (weight + noise)).withColumn("dl", blend("n1", F.col("d1"), F.col("within")))
    wide = best.select("lang", "octave", "figure", blend("n0", F.col("m0"), F.col("ml")).alias("median"), F.greatest(blend("n0", F.col("d0"), F.col("dl")), floor).alias("mad"))
    return wide.groupBy("lang", "octave").pivot("figure", _FIGURES).agg(F.first("median").alias("median"), F.first("mad").alias("mad"))


def with_verdict(stats: DataFrame) -> DataFrame:
    """Adds base_failed, the figures' deviations and kept to measured rows."""
    n = F.col("n_words")
    stats = stats.withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
    stats = stats.withColumn("octave", F.floor(_length()).cast("int"))
    slopes = staged(trends(stats), "trends")
    stats = stats.join(slopes.select("lang", *[F.col(f).alias(f"{f}_slope") for f in _FIGURES]), "lang", "left")
    joined = stats.join(staged(bands(stats), "bands"), ["lang", "octave"], "left")
    away = {f: (_adjusted(f) - F.col(f"{f}_median")) / F.col(f"{f}_mad") for f in _FIGURES}
    bad = [away["chars_per_token"] + away["token_entropy"] < JOINT]
    for f, (below, above) in BANDS.items():
        bad += [away[f] < -below] if below is not None else []
        bad += [away[f] > above] if above is not None else []
    rejected = F.lit(False)
    for b in bad:
        rejected = rejected | F.coalesce(b, F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected)


def quality_rules(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the counts, the fertility figures, base_failed and kept, a row per input row.

    A null text has no words, like an empty one: its figures are null and the base rules
    reject it. A null language is a language of its own. Repeated rows, null ids and equal
    figures need no special case. Columns other than id, text and language are not read.
    """
    lean = docs.select(named(id_col, "doc_id"), named(text_col, "text"), named(lang_col, "lang"))
    stats = staged(measured(lean, model, carried=["doc_id"]), "fertility")
    return with_verdict(stats).select("row.doc_id", *_COUNTS, "chars_per_token", "byte_share", "token_entropy", "base_failed", "kept")


def keep_good(docs: DataFrame, model: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    stats = staged(measured(docs, model, text_col, lang_col), "measured")
    return with_verdict(stats).where("kept").select("row.*")
