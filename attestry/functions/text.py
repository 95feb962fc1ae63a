"""Column functions for text: strip, lines, accent folding, literal tables, folds.

Everything here is a JVM expression.  ``bind`` keeps an expensive value from being
evaluated once per reference inside lambdas, and ``scan`` is an ordered fold that
emits rows while staying inside one record, so it needs no shuffle.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space and as line ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
SPACE_RUN = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BETWEEN_WORDS = r"[^\p{L}\p{N}]+"


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the plain letters they fold to."""
    pairs = []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        if letter != letter.lower():
            continue
        base = unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isalpha():
            pairs.append((letter, base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, PLAIN = _accent_table()


def strip(text) -> Column:
    """Both-side trim of every white-space character."""
    return F.trim(_c(text), F.lit(WHITESPACE))


def rstrip(text) -> Column:
    return F.rtrim(_c(text), F.lit(WHITESPACE))


def lstrip_chars(text, chars: str) -> Column:
    return F.ltrim(_c(text), F.lit(chars))


def squeeze(text) -> Column:
    """White-space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(_c(text), SPACE_RUN, " "))


def remove_spaces(text) -> Column:
    return F.regexp_replace(_c(text), SPACE_RUN, "")


def lines_of(text) -> Column:
    """Text as an array of lines; a final line end adds no empty line."""
    parts = F.split(_c(text), LINE_END)
    return bind(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def fold_case(text) -> Column:
    """Lower case without diacritics, the form index terms are kept in."""
    return F.translate(F.lower(_c(text)), ACCENTED, PLAIN)


def words_of(text) -> Column:
    """Distinct index terms of a text: folded runs of letters and digits.

    Cut between the words: extracting all matches copies the text once per match.
    """
    return F.array_distinct(F.filter(F.split(fold_case(text), BETWEEN_WORDS), lambda w: w != ""))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether any literal word occurs in the text; false for an empty list."""
    words = [w for w in words if w]
    if not words:
        return F.lit(False)
    if len(words) <= 8:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        return hit
    return bind(text, lambda t: F.exists(strings(words), lambda w: F.contains(t, w)))


def strings(values: Iterable[str]) -> Column:
    """A literal array<string>, also when empty."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.lit(values)


def pairs(items: Iterable[tuple[str, str]]) -> Column:
    """A literal array of (src, dst) structs."""
    payload = json.dumps([{"src": a, "dst": b} for a, b in items], ensure_ascii=False)
    return F.from_json(F.lit(payload), "array<struct<src:string,dst:string>>")


def replace_all(text: Column, items: list[tuple[str, str]]) -> Column:
    """Literal replacements applied one after another."""
    if not items:
        return text
    if len(items) <= 16:
        for src, dst in items:
            text = F.replace(text, F.lit(src), F.lit(dst))
        return text
    return F.aggregate(pairs(items), text, lambda acc, p: F.replace(acc, p["src"], p["dst"]))


def drop_all(text: Column, words: Iterable[str], by: str = " ") -> Column:
    return replace_all(text, [(w, by) for w in words])


def non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def distinct_clean(values: Column) -> Column:
    """Squeezed, non-empty and distinct, in first-seen order."""
    return F.array_distinct(non_empty(F.transform(values, squeeze)))


def char_grams(text, length: int) -> Column:
    """Distinct character n-grams, built from one pass over the characters."""
    return bind(
        F.split(_c(text), ""),
        lambda c: F.when(
            F.size(c) >= length,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(c) - length, F.lit(0))),
                    lambda i: F.concat(*[F.get(c, i + k) for k in range(length)]),
                )
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def occurrences(text: Column, word: Column) -> Column:
    """1-based positions of every (also overlapping) occurrence of a word."""
    return F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.substring(text, i, F.length(word)) == word,
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(
    items: Column,
    state: Column,
    state_type: str,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
    finish: Callable[[Column], Column] | None = None,
    block: int = 256,
) -> Column:
    """Ordered fold over an array that emits an array.

    ``step(state, item)`` gives the next state and an array of emitted values.  Output is
    gathered block by block, so appending stays near-linear for very long arrays.
    """
    empty = F.array().cast(f"array<{out_type}>")

    def fold_block(st: Column, blk: Column) -> Column:
        def merge(acc, item):
            nxt, out = step(acc["st"], item)
            return F.struct(nxt.cast(state_type).alias("st"), F.concat(acc["out"], out.cast(f"array<{out_type}>")).alias("out"))

        return F.aggregate(blk, F.struct(st.alias("st"), empty.alias("out")), merge)

    def over(arr: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.expr("0") + F.floor((F.greatest(F.size(arr), F.lit(1)) - 1) / block).cast("int")),
            lambda b: F.slice(arr, b * block + 1, F.lit(block)),
        )
        start = F.struct(state.cast(state_type).alias("st"), F.array().cast(f"array<array<{out_type}>>").alias("out"))

        def merge(acc, blk):
            return bind(
                fold_block(acc["st"], blk),
                lambda r: F.struct(r["st"].alias("st"), F.concat(acc["out"], F.array(r["out"])).alias("out")),
            )

        total = F.aggregate(blocks, start, merge)
        if finish is None:
            return F.flatten(F.aggregate(blocks, start, merge)["out"])
        return bind(total, lambda r: F.concat(F.flatten(r["out"]), finish(r["st"]).cast(f"array<{out_type}>")))

    return bind(items, over)


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
