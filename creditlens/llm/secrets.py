"""Secrets in text: fixed patterns, and random strings by token efficiency.

A vocabulary of byte pairs learnt from text packs words into few tokens; random strings
need about one token for each two characters. A run of token characters is taken for a
secret where its characters per token under a public vocabulary are at most
``MOST_CHARS_PER_TOKEN``, after known digests (runs of hexadecimal digits of a digest's
length), UUIDs, plain numbers, and identifiers made of words that the vocabulary packs
well are set aside. Where the run as a whole is packed too well, its parts between
separators and the stretches of tokens in it are held against the same limit, so that
words joined to a key do not hide it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import named

# The kinds in their order, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: What the method looks at, and what it sets aside.
LEAST_RANDOM = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RANDOM)
PART = re.compile(r"[A-Za-z0-9+]{%d,}" % LEAST_RANDOM)
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A piece between separators that is a word in one case, words in camel case, or a number.
PIECE = re.compile(r"[A-Za-z0-9]+")
FORM = re.compile(r"[0-9]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A digest or UUID beside separators only.
SET_ASIDE = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|{DIGEST.pattern})(?![A-Za-z0-9])")
MOST_CHARS_PER_TOKEN = 2.2
#: The same for a word of an identifier; long words of other languages lie between the two.
MOST_CHARS_PER_TOKEN_WORD = 2.0
#: Characters above the limit after which a stretch of tokens is over.
MOST_DROP = 6.0


def load_vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches that are long enough."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def badly_packed(string: str, vocabulary) -> bool:
    return len(string) <= MOST_CHARS_PER_TOKEN * len(vocabulary.encode_ordinary(string))


def made_of_words(string: str, vocabulary) -> bool:
    """Half of the letters and digits or more are numbers and words, in any case, that are packed well."""
    bad = total = 0
    for piece in PIECE.findall(string):
        total += len(piece)
        if not FORM.fullmatch(piece):
            bad += len(piece)
            continue
        words = WORD.findall(piece)
        for word in words:
            n = len(vocabulary.encode_ordinary(word.lower()))
            if (n > 1 and len(word) <= MOST_CHARS_PER_TOKEN_WORD * n) or (len(words) > 1 and len(word) < 3):
                bad += len(word)
    return 2 * bad <= total


def is_random(string: str, vocabulary) -> bool:
    if len(string) < LEAST_RANDOM or DIGEST.fullmatch(string) or UUID.fullmatch(string):
        return False
    return badly_packed(string, vocabulary) and not made_of_words(string, vocabulary)


def stretches(run: str, vocabulary) -> list[tuple[int, int]]:
    """Stretches of the run's tokens that are short on the whole, without digests and UUIDs."""
    sizes = [len(vocabulary.decode_single_token_bytes(t)) for t in vocabulary.encode_ordinary(run)]
    aside = [m.span() for m in SET_ASIDE.finditer(run)]
    out, k, at, next_aside = [], 0, 0, 0
    while k < len(sizes):
        # From the token k at the character ``at``: up to where the sum is greatest.
        total = best = 0.0
        end, after, i, place = at, k, k, at
        while i < len(sizes) and total > best - MOST_DROP and total >= 0:
            while next_aside < len(aside) and aside[next_aside][1] <= at:
                next_aside += 1
            if next_aside < len(aside) and place + sizes[i] > aside[next_aside][0]:
                break
            total, place, i = total + MOST_CHARS_PER_TOKEN - sizes[i], place + sizes[i], i + 1
            if total >= best:
                best, end, after = total, place, i
        if after == k:
            at, k = at + sizes[k], k + 1
            continue
        lo = at + len(run[at:end]) - len(run[at:end].lstrip("/_=-"))
        hi = lo + len(run[lo:end].rstrip("/_-"))
        if hi - lo >= LEAST_RANDOM and not made_of_words(run[lo:hi], vocabulary):
            out.append((lo, hi))
        at, k = end, after
    return out


def random_spans(text: str, vocabulary) -> list[tuple[int, int, int]]:
    """Spans of strings that the vocabulary packs badly: whole runs, or what of a run is so."""
    out = []
    for m in CANDIDATE.finditer(text):
        run, start = m.group(), m.start()
        if DIGEST.fullmatch(run) or UUID.fullmatch(run):
            continue
        if is_random(run, vocabulary):
            out.append((start, 3, m.end()))
            continue
        found = [p.span() for p in PART.finditer(run) if is_random(p.group(), vocabulary)]
        last = -1
        for a, b in sorted(found + stretches(run, vocabulary)):
            if a < last:
                last = max(b, last)
                out[-1] = (out[-1][0], 3, start + last)
            else:
                out.append((start + a, 3, start + b))
                last = b
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def outside(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that lie inside none of ``base``: of the base spans that start no later, the
    furthest end decides."""
    base = sorted(base)
    starts, reach = [a for a, _, _ in base], [0, *accumulate((b for _, _, b in base), max)]
    return [s for s in spans if reach[bisect_right(starts, s[0])] < s[2]]


def scan(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random, a row per input row.

    Positions count code points, ends are exclusive; an assignment's span is the whole
    match. A random string inside a base span is not listed again. A null text is taken
    as empty and has no spans. Repeated rows and null ids each get a row; other columns
    are not read. Texts are handled one by one in the batch that Spark sends.
    """

    def run(batches):
        known = load_vocabulary(vocabulary)
        for batch in batches:
            counts, digests, listed = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = outside(random_spans(text, known), base)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                counts.append([*n, len(more)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                listed.append(written(sorted(base + more)))
            cols = list(zip(*counts)) if counts else [[]] * 4
            arrays = [pa.array(c, pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:3], pa.array(digests, pa.string()), pa.array(listed, pa.string()), arrays[3]],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    taken = docs.select(named(id_col, "doc_id").cast("long").alias("doc_id"), named(text_col, "text"))
    return taken.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
