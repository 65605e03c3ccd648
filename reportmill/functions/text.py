"""Text functions as column expressions: normalization, terms, spans, tokens, language, hashes."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportmill.functions.vocabulary import LANGUAGE_MARKERS

#: Letters that canonical decomposition leaves whole or that fold to two letters, applied before lower case.
SINGLE_FOLD = {"ı": "i", "İ": "i", "đ": "d", "Đ": "d", "ø": "o"}
DOUBLE_FOLD = {"ß": "ss", "æ": "ae"}
DASHES = "-‐‑‒–—―"


def let(value: Column, body) -> Column:
    """Binds a value once for use in a lambda body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, longer) for characters of the basic plane outside Hangul: what they are without marks."""
    one, gone, longer = [], [], []
    for code in range(0x80, min(0x10000, sys.maxunicode)):
        if 0xAC00 <= code < 0xE000:
            continue
        ch = chr(code)
        plain = _plain(ch)
        if plain == ch:
            continue
        if not plain:
            gone.append(ch)
        elif len(plain) == 1:
            one.append((ch, plain))
        elif code < 0x530 or 0x2100 <= code < 0x2190 or 0xFB00 <= code < 0xFB10:
            longer.append((ch, plain))
    source = "".join(a for a, _ in one) + "".join(gone)
    return source, "".join(b for _, b in one), tuple(longer)


FOREIGN = r"[^\x00-\x7F]"


def _one_of(letters: str) -> str:
    """A pattern of one of some letters beyond ASCII; ASCII fails it at the first test."""
    return rf"{FOREIGN}(?<=[{letters}])"


def _is_ascii(t: Column) -> Column:
    return F.octet_length(t) == F.length(t)


def fold_marks(c: Column, also: dict[str, str] | None = None) -> Column:
    """Without combining marks and compatibility forms, in one pass over texts beyond ASCII. also: what becomes of more letters after that."""
    source, target, longer = fold_table()
    also = also or {}
    plain = dict(zip(source, target.ljust(len(source), "\0"), strict=True))  # \0: goes
    table = {a: also.get(b, b) or "\0" for a, b in plain.items()}
    table |= {a: b or "\0" for a, b in also.items() if a not in table}
    kept, gone = [a for a, b in table.items() if b != "\0"], [a for a, b in table.items() if b == "\0"]

    def folded(t: Column) -> Column:
        spelt = t
        for a, b in longer:
            spelt = F.replace(spelt, F.lit(a), F.lit(b))
        spelt = F.when(t.rlike(_one_of("".join(a for a, _ in longer))), spelt).otherwise(t)
        return F.translate(spelt, "".join(kept + gone), "".join(table[a] for a in kept))

    return let(c, lambda t: F.when(_is_ascii(t), t).otherwise(folded(t)))


def normalize(c: Column) -> Column:
    """Folded, lower case, without marks, with single blanks; line breaks stay. Null becomes the empty text."""
    def single(t: Column) -> Column:
        for a, b in (DOUBLE_FOLD | SINGLE_FOLD).items():
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    special = _one_of("".join(DOUBLE_FOLD | SINGLE_FOLD))
    c = let(F.coalesce(c, F.lit("")), lambda t: F.lower(F.when(_is_ascii(t) | ~t.rlike(special), t).otherwise(single(t))))
    c = fold_marks(c, {"\u00ad": ""} | {dash: "-" for dash in DASHES})
    return F.trim(F.regexp_replace(c, r"[-_/\\ \t]+", " "), F.lit(" \t\n\x0b\f\r"))


def term_pattern(terms) -> str:
    """A pattern of whole terms in list order; inner blanks match any white space."""
    def quoted(term: str) -> str:
        return r"\s+".join("".join(rf"\{ch}" if not (ch.isalnum() or ch == "_") else ch for ch in w) for w in term.split(" "))

    return r"(?U)(?<!\w)(?:" + "|".join(map(quoted, terms)) + r")(?!\w)"


def contains_terms(c: Column, terms) -> Column:
    return c.rlike(term_pattern(terms))


BLOCK = 16


def sums_before(a: Column, levels: int = 2) -> Column:
    """For each number of an array the sum of those before it, by blocks and blocks of blocks, so that work grows with the array and not with its square."""
    total = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x)
    within = lambda b, start: F.transform(b, lambda x, i: start + total(F.slice(b, 1, i)))
    if not levels:
        return within(a, F.lit(0))

    def summed(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, sums_before(F.transform(blocks, total), levels - 1), within))

    def split(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(a), F.lit(BLOCK)), lambda i: F.slice(a, i, BLOCK))

    return let(a, lambda a: F.when(F.size(a) <= BLOCK, within(a, F.lit(0))).otherwise(let(split(a), summed)))


def spans(c: Column, pattern: str) -> Column:
    """array<struct<s,e,t>> of the non-empty matches of a pattern; ends are exclusive."""
    def pieces(t: Column) -> Column:
        hits, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        piece = lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("n"), h.alias("t"))
        return let(hits, lambda h: F.zip_with(h, F.slice(gaps, 1, F.size(h)), piece))

    def place(p: Column) -> Column:
        def one(x: Column, at: Column) -> Column:
            return F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["t"].alias("t"))

        return F.zip_with(p, sums_before(F.transform(p, lambda x: x["gap"] + x["n"])), one)

    return let(c, lambda t: let(pieces(t), place))


def span_gap(a: Column, b: Column) -> Column:
    """Characters between two spans; 0 where they touch or overlap."""
    return F.greatest(F.lit(0), b["s"] - a["e"], a["s"] - b["e"])


def merge_spans(*arrays: Column) -> Column:
    """Distinct spans of all arrays in order."""
    return let(F.sort_array(F.concat(*arrays)), lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\b\d+(?:[.,]\d+)*\b", "<num>")


def single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""
    def runs(w: Column) -> Column:
        if n == 1:
            return w
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))

    return let(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(runs(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def count_of(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


def language_group(normalized: Column) -> Column:
    """A reproducible script or vocabulary group of a normalized text; ties go to the largest name."""
    def score(padded: Column) -> Column:
        scores = [F.struct(sum((count_of(padded, m) for m in marks), F.lit(0)).alias("n"), F.lit(name).alias("name")) for name, marks in LANGUAGE_MARKERS.items()]
        return let(F.array_max(F.array(*scores)), lambda b: F.when(b["n"] > 0, b["name"]).otherwise("latin_other"))

    def group(t: Column) -> Column:
        letters = F.greatest(F.lit(1), F.regexp_count(t, F.lit(r"\p{L}")))
        share = lambda script: F.when(t.rlike(rf"\p{{Is{script}}}"), F.regexp_count(t, F.lit(rf"\p{{Is{script}}}")) / letters).otherwise(0.0)
        named = F.when(share("Greek") >= 0.08, "greek_script").when(share("Cyrillic") >= 0.08, "cyrillic_script")
        return F.when(F.length(t) == 0, "empty").otherwise(named.otherwise(let(F.concat(F.lit(" "), t, F.lit(" ")), score)))

    return let(normalized, group)


def language_hypotheses(normalized: Column) -> Column:
    """The group first, then any script present, then English where imported terms are likely."""
    def ranked(t: Column, g: Column) -> Column:
        found = F.array(
            g, F.when(t.rlike(r"\p{IsGreek}"), F.lit("greek_script")), F.when(t.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic_script")),
            F.when(~g.isin("greek_script", "cyrillic_script", "english"), F.lit("english")),
        )
        return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))

    return let(normalized, lambda t: let(language_group(t), lambda g: ranked(t, g)))
