"""Shared parts of the comparison SQL: named common table expressions put together on demand."""

from __future__ import annotations

import re

from attestry.functions.text import ACCENTED, LINE_END, PLAIN, SPACE_RUN, WHITESPACE

PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _raw(pattern: str) -> str:
    """Java character escapes as the characters themselves."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), pattern)


WS = lit(WHITESPACE)
LINES = lit(_raw(LINE_END))
SPACES = lit(_raw(SPACE_RUN))


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {SPACES}, ' ', 'g'))"


def no_space(x: str) -> str:
    return f"regexp_replace({x}, {SPACES}, '', 'g')"


def line_list(x: str) -> str:
    return f"(CASE WHEN string_split_regex({x}, {LINES})[-1] = '' THEN string_split_regex({x}, {LINES})[:-2] ELSE string_split_regex({x}, {LINES}) END)"


def fold(x: str) -> str:
    return f"translate(lower({x}), {lit(ACCENTED)}, {lit(PLAIN)})"


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all({fold(x)}, '[\\p{{L}}\\p{{N}}]+'))"


def any_of(x: str, values) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(v)})" for v in values) + ")" if values else "FALSE"


def replaces(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


def with_parts(sql: str) -> str:
    """The query with the parts it needs, in dependency order."""
    order: list[str] = []

    def need(text: str, seen: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in PARTS and word not in order and word not in seen:
                need(PARTS[word], (*seen, word))
                order.append(word)

    need(sql, ())
    if not order:
        return sql
    own = ""
    if sql.startswith("WITH "):
        own, sql = "," + sql[5:], ""
    parts = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" if not PARTS[n].lstrip().startswith("RECURSIVE") else f"{n} AS ({PARTS[n].lstrip()[9:]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{own or sql}"
