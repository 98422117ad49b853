"""The Porter stemmer, for lower-cased words that are met once each.

A ``y`` at the start of a word or after a vowel is a consonant; it is written ``Y`` while the
rules run, so that conditions on a stem are patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm: suffixes and what replaces them, by step. Of the
# suffixes that fit, the longest counts, whether or not its condition holds.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
REPAIRS = {"at": "ate", "bl": "ble", "iz": "ize"}
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()

#: What a stem must hold: a vowel, a vowel and a consonant, that twice; how a short one ends.
VOWEL, ONCE, TWICE = "[aeiouy]", "[aeiouy][^aeiouy]", "[aeiouy][^aeiouy].*[aeiouy][^aeiouy]"
SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$"
#: Words of fewer letters stay.
LEAST = 3

_vowel, _once, _twice, _short = (re.compile(p, re.S) for p in (VOWEL, ONCE, TWICE, SHORT))


def _suffix(word: str, suffixes: Iterable[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _replaced(word: str, rules: dict[str, str], condition: re.Pattern | None) -> str:
    suffix = _suffix(word, rules)
    stem = word[: len(word) - len(suffix)]
    return stem + rules[suffix] if suffix and (not condition or condition.search(stem)) else word


def _past(word: str) -> str:
    """Without -ed and -ing, mended at the end; -eed becomes -ee."""
    suffix = _suffix(word, ("eed", "ed", "ing"))
    stem = word[: len(word) - len(suffix)]
    if suffix == "eed":
        return stem + "ee" if _once.search(stem) else word
    if not suffix or not _vowel.search(stem):
        return word
    if mended := _suffix(stem, REPAIRS):
        return stem[: -len(mended)] + REPAIRS[mended]
    if stem[-1:].lower() == stem[-2:-1].lower() and not re.match("[aeiouylsz]", stem[-1:]):
        return stem[:-1]
    return stem + "e" if _once.search(stem) and not _twice.search(stem) and _short.search(stem) else stem


def stem(word: str) -> str:
    if len(word) < LEAST:
        return word
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    w = _past(_replaced(w, PLURALS, None))
    if w[-1:] in ("y", "Y") and _vowel.search(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, SECOND, _once), THIRD, _once)
    last = _suffix(w, FOURTH)
    own = w[: len(w) - len(last)] + (last[0] if last in ("sion", "tion") else "")
    if last and _twice.search(own):
        w = own
    if w.endswith("e") and _once.search(w[:-1]) and (_twice.search(w[:-1]) or not _short.search(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _twice.search(w):
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(words: Column) -> Column:
    """Each of an array's words as its stem; every word of a batch is worked out once."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        for own in lists:
            for w in own:
                if w not in known:
                    known[w] = stem(w)
        return lists.map(lambda own: [known[w] for w in own])

    return run(words)


def stem_sql(words: str) -> str:
    """CTEs for DuckDB that give ``stems`` (word, stem) of the distinct words of the table ``words`` (word)."""
    pick = lambda rules: f"coalesce([x FOR x IN {sorted(rules, key=len, reverse=True)} IF ends_with(w, x)][1], '')"
    new = lambda rules: "CASE f " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in rules.items()) + " END"
    has = lambda x, p: f"regexp_matches({x}, '{p}')"
    once = lambda x: f"{has(x, ONCE)} AND NOT {has(x, TWICE)}"

    def step(n: int, rules, expr: str) -> str:
        """``expr`` of the word w, its longest suffix f and its stem t."""
        return f"""
p{n} AS (SELECT word, {expr} AS w FROM (SELECT word, w, f, left(w, length(w) - length(f)) AS t FROM (SELECT word, w, {pick(rules)} AS f FROM p{n - 1}))),"""

    fourth = "concat(t, CASE WHEN f IN ('sion', 'tion') THEN left(f, 1) ELSE '' END)"
    return f"""
p0 AS (SELECT word, CASE WHEN length(word) < {LEAST} THEN word ELSE regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') END AS w FROM (SELECT DISTINCT word FROM {words})),{
    step(1, PLURALS, f"CASE WHEN f = '' OR length(word) < {LEAST} THEN w ELSE concat(t, {new(PLURALS)}) END")}{
    step(2, ["eed", "ed", "ing"], f"CASE WHEN length(word) < {LEAST} OR f = '' THEN w WHEN f = 'eed' THEN CASE WHEN {has('t', ONCE)} THEN concat(t, 'ee') ELSE w END WHEN NOT {has('t', VOWEL)} THEN w WHEN {has('t', '(at|bl|iz)$')} THEN concat(t, 'e') WHEN lower(right(t, 1)) = lower(left(right(t, 2), 1)) AND length(t) > 1 AND NOT {has('t', '[aeiouylsz]$')} THEN left(t, length(t) - 1) WHEN {once('t')} AND {has('t', SHORT)} THEN concat(t, 'e') ELSE t END")}{
    step(3, ["y", "Y"], f"CASE WHEN length(word) >= {LEAST} AND f <> '' AND {has('t', VOWEL)} THEN concat(t, 'i') ELSE w END")}{
    step(4, SECOND, f"CASE WHEN length(word) >= {LEAST} AND f <> '' AND {has('t', ONCE)} THEN concat(t, {new(SECOND)}) ELSE w END")}{
    step(5, THIRD, f"CASE WHEN length(word) >= {LEAST} AND f <> '' AND {has('t', ONCE)} THEN concat(t, {new(THIRD)}) ELSE w END")}{
    step(6, FOURTH, f"CASE WHEN length(word) >= {LEAST} AND f <> '' AND {has(fourth, TWICE)} THEN {fourth} ELSE w END")}{
    step(7, ["e"], f"CASE WHEN length(word) >= {LEAST} AND f <> '' AND {has('t', ONCE)} AND ({has('t', TWICE)} OR NOT {has('t', SHORT)}) THEN t ELSE w END")}
stems AS (SELECT word, replace(CASE WHEN length(word) >= {LEAST} AND ends_with(w, 'll') AND {has('w', TWICE)} THEN left(w, length(w) - 1) ELSE w END, 'Y', 'y') AS stem FROM p7)"""
