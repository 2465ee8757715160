"""Text predicates and tokenisers as Column expressions: all stay in the JVM."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the two tokenisers and of the follow-up rule.
LEXICAL_STOP = (
    "the a an is are was were be been have has had do does did will would could should may might shall can about what "
    "which who whom this that these those and or for with from its tell please kindly give show list"
).split()
LEXICAL_EXCLUDED = ["chuti", "bhatta", "beton", "eid", "puja"]
SELECTION_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can need "
    "dare ought used to of in for on with at by from as into through during before after above below between out off "
    "over under again further then once here there when where why how all each every both few more most other some such "
    "no not only own same so than too very just about what which who whom this that these those and but or if because "
    "until while i me my we our you your he him his she her it its they them their ie e.g"
).split()


def trim(x: Column) -> Column:
    """Both ends without characters up to U+0020."""
    return F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def squeeze(x: Column) -> Column:
    """Lower case, white space runs one space, none at the ends: the form in which lines are compared."""
    return F.lower(F.regexp_replace(trim(x), r"\s+", " "))


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lexical_keywords(q: Column, limit: int = 12) -> Column:
    """Distinct keywords in order: words of 3 to 40 characters and dotted codes, without stop words."""
    tokens = F.split(F.regexp_replace(F.lower(q), r"[^a-z0-9.\s-]", " "), r"\s+")
    good = F.filter(
        tokens,
        lambda t: ((F.length(t) >= 3) | t.rlike(r"\A\d+(\.\d+)+\z")) & (F.length(t) <= 40) & ~t.isin(LEXICAL_EXCLUDED + LEXICAL_STOP),
    )
    return F.slice(F.array_distinct(good), 1, limit)


def selection_words(q: Column, extra_stop: tuple[str, ...] = ()) -> Column:
    """Words of three characters or more that carry meaning; punctuation is deleted, not split at."""
    tokens = F.split(F.regexp_replace(F.lower(q), r"[^a-z0-9\s-]", ""), r"\s+")
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(SELECTION_STOP + list(extra_stop)))


def selection_keywords(q: Column, extra_stop: tuple[str, ...] = ()) -> Column:
    """The words, then pairs of neighbouring ones, each once."""
    w = selection_words(q, extra_stop)
    pairs = F.when(F.size(w) >= 2, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_union(F.array_distinct(w), pairs)


def is_list_question(q: Column) -> Column:
    return F.lower(q).rlike(r"\b(types?|kinds?|lists?|all|various|each)\b")


def stem(w: Column) -> Column:
    """Light suffix rules; words of four characters or fewer stay."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when(n <= 4, w)
        .when(w.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us"), cut(1))
        .when(w.endswith("ing") & (n > 7), cut(3))
        .when(w.endswith("ed") & (n > 6), cut(2))
        .when(w.endswith("ion") & (n > 7), cut(3))
        .when(w.endswith("ary") & (n > 6), cut(3))
        .otherwise(w)
    )


def trigrams(x: Column) -> Column:
    """Distinct character trigrams of the lower-cased text with single spaces; none below three characters."""
    t = F.lower(F.regexp_replace(x, r"\s+", " "))
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: t.substr(i, F.lit(3)))
    return F.when(F.length(t) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


class Grams(NamedTuple):
    """Distinct character trigrams of some texts: how many each text has, the sorted vocabulary, and for each text in turn its trigrams' places there."""

    sizes: np.ndarray
    vocabulary: np.ndarray
    places: np.ndarray

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def trigram_codes(t: str) -> np.ndarray:
    """A text's distinct character trigrams as sorted numbers."""
    c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
    # A code point has 21 bits.
    return np.unique(c[:-2] | c[1:-1] << 21 | c[2:] << 42) if len(c) >= 3 else c[:0]


def trigram_table(codes: list[np.ndarray]) -> Grams:
    vocabulary, places = np.unique(np.concatenate(codes), return_inverse=True)
    return Grams(np.array([len(x) for x in codes], np.int64), vocabulary, places)


def shared_trigrams(a: Grams, b: Grams, share: float = 0.005, columns: int = 4096, most: int = 1 << 22) -> np.ndarray:
    """How many trigrams each text of a shares with each of b.

    Trigrams that at least `share` of all pairs have in common are counted as a product of matrices of so many columns,
    the others pair by pair, at most about `most` at once.
    """
    n = np.zeros((len(a.sizes), len(b.sizes)), np.int32)
    both, in_a, in_b = np.intersect1d(a.vocabulary, b.vocabulary, assume_unique=True, return_indices=True)
    sides = []
    for x, inside in ((a, in_a), (b, in_b)):
        to = np.full(len(x.vocabulary), -1)
        to[inside] = np.arange(len(both))
        gram = to[x.places]
        sides.append((x.texts()[gram >= 0], gram[gram >= 0]))
    held = [np.bincount(gram, minlength=len(both)) for _, gram in sides]
    common = held[0] * held[1] > share * n.size
    column = np.where(common, np.cumsum(common) - 1, -1)
    for lo in range(0, int(common.sum()), columns):
        width = min(columns, int(common.sum()) - lo)
        m = []
        for (text, gram), rows in zip(sides, n.shape, strict=True):
            c = column[gram] - lo
            on = (c >= 0) & (c < width)
            m.append(np.zeros((rows, width), np.float32))
            m[-1][text[on], c[on]] = 1
        n += (m[0] @ m[1].T).astype(np.int32)
    (left, gram), (right, other) = ((text[~common[g]], g[~common[g]]) for text, g in sides)
    right = right[np.argsort(other, kind="stable")]
    held = np.where(common, 0, held[1])
    first, times = (np.cumsum(held) - held)[gram], held[gram]
    done = np.cumsum(times)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + most, "right")))
        t = times[lo:hi]
        at = np.repeat(first[lo:hi] - np.cumsum(t) + t, t) + np.arange(t.sum())
        n += np.bincount(np.repeat(left[lo:hi], t) * n.shape[1] + right[at], minlength=n.size).reshape(n.shape)
        lo = hi
    return n


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def is_toc_line(t: Column) -> Column:
    """t: a stripped line. Leaders or a wide gap before a page number at its end."""
    n = F.length(t)
    gapped = (n < 180) & (n > 20) & t.rlike("[A-Za-z]") & t.rlike(r"\s{2,}\d+\s*\z")
    return (n > 0) & (n <= 220) & t.rlike(r"\d\s*\z") & (t.rlike(r"\.{2,}\s*\d+\s*\z") | t.rlike(r"-{2,}\s*\d+\s*\z") | gapped)


def is_toc_title(t: Column) -> Column:
    return (F.length(t) <= 120) & (t.rlike(r"(?i)\A(chapter|section|part|annex|appendix)\s+\d+") | t.rlike(r"\A\d+(\.\d+)*\s+[A-Z]"))


def loops(text: str, block: int = 20, times: int = 4) -> bool:
    """Whether a block of at least `block` characters stands `times` times on end, in time that grows as n log n.

    In such a stretch of smallest period d the next place of each gram is d further on, so it is a run of places with
    one and the same distance. A shorter period counts by its multiples.
    """
    s = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(s) - block + 1
    if len(s) < block * times:
        return False
    h = np.zeros(n, np.uint64)
    for k in range(block):
        h = h * np.uint64(0x9E3779B97F4A7C15) + s[k : k + n]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    ahead = np.zeros(n, np.int64)
    ahead[order[again]] = order[again + 1] - order[again]
    edge = np.concatenate([[0], np.flatnonzero(ahead[1:] != ahead[:-1]) + 1, [n]])
    d, run = ahead[edge[:-1]], np.diff(edge)
    whole = d * -(-block // np.maximum(d, 1))
    return bool(((d > 0) & (run >= times * whole - d - block + 1)).any())


def has_loop(text: Column) -> Column:
    return F.pandas_udf(lambda x: x.fillna("").map(loops).astype(bool), "boolean")(text)


def is_toc_chunk(text: Column) -> Column:
    """Mangled or looping text, a contents heading, or lines of contents that dominate. One Arrow call looks for loops."""
    t = F.filter(F.transform(lines(text), trim), lambda s: s != "")
    toc = lambda s: (
        s.rlike(r"\.{2,}\s*\d+\s*\z") | s.rlike(r"-{2,}\s*\d+\s*\z") | ((F.length(s) < 180) & s.rlike("[A-Za-z]") & s.rlike(r"\s{2,}\d+\s*\z"))
        | ((F.length(s) < 150) & s.rlike(r"\d+\.\d+\s+.*\.\.{2,}")) | s.rlike(r"\A\[.*\]\(#.*\)\z")
    )
    n, k = F.size(t), F.size(F.filter(t, toc))
    mangled = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit(""))) >= 3
    heading = F.exists(t, lambda s: s.rlike(r"(?i)\A#{0,4}\s*(table of contents|contents)\s*\z"))
    return F.coalesce(F.trim(text) != "", F.lit(False)) & (mangled | has_loop(text) | heading | (k >= 3) | ((k > 0) & (k / n >= 0.3)))


def section_header(text: Column) -> Column:
    """The first Markdown heading, else the first numbered one."""
    md = F.regexp_extract(text, r"(?m)^#{1,4}\s+(.*)$", 1)
    numbered = F.regexp_extract(text, r"(?m)^(\d{1,2}\.\d{1,2}\.?\s+[A-Za-z].{0,110})$", 1)
    return trim(F.when(md != "", md).otherwise(numbered))


def with_section_prefix(text: Column, header: Column) -> Column:
    label = F.concat(F.lit("["), header, F.lit("]"))
    return F.when(F.coalesce(header, F.lit("")) == "", text).when(text.startswith(label), text).otherwise(F.concat(label, F.lit("\n"), text))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n{2,}"), lambda s: F.trim(s) != "")


def question_parts(q: Column) -> Column:
    """Up to three parts: at question marks, then at the first join word that leaves two real halves."""

    def halves(t: Column, join: str) -> Column:
        at = F.instr(F.lower(t), join)
        left, right = trim(t.substr(F.lit(1), at - 1)), trim(t.substr(at + len(join), F.length(t)))
        real = lambda s: (F.length(s) >= 20) & (F.size(F.split(s, r"\s+")) >= 3)
        return F.when((at > 0) & real(left) & real(right), F.array(left, right))

    pieces = F.filter(F.transform(F.split(q, r"\?"), trim), lambda t: t != "")
    parts = F.flatten(F.transform(pieces, lambda t: F.coalesce(halves(t, " and "), halves(t, " also "), halves(t, ";"), F.array(t))))
    return F.when(F.size(parts) == 0, F.array(q)).otherwise(F.slice(parts, 1, 3))
