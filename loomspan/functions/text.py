"""Text expressions: normal forms, hashes, tokens, sentences, chunks, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens a word counts for in estimates, and the most a chunk may hold.
TOKENS_A_WORD, CHUNK_TOKENS = 1.7, 480
#: First line of an answer that abstains.
ABSTAIN = "INSUFFICIENT_CONTEXT"
#: White space as Unicode has it, for Java's patterns and for RE2's.
SPACES = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Fixed values of English analysis: words that are left out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def squeezed(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    # single spaces, nearly all of it, are left as they are
    odd = SPACES.replace("\x1c-\x20", "\x1c-\x1f")
    return F.trim(F.regexp_replace(text, f"{SPACES}{SPACES}+|{odd}", " "))


def title_of(text: Column) -> Column:
    return squeezed(F.split_part(text, F.lit("\n"), F.lit(1)))


def abstract_of(text: Column) -> Column:
    return squeezed(F.when(F.instr(text, "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit("")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.concat(title_of(text), F.lit("\n\n"), abstract_of(text)), 256)


def n_words(text: Column) -> Column:
    return words_of_squeezed(squeezed(text))


def words_of_squeezed(s: Column) -> Column:
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " "))).cast("long")


def token_estimate(text: Column) -> Column:
    return F.ceil(n_words(text) * TOKENS_A_WORD).cast("long")


def snippet(text: Column, n: int = 300) -> Column:
    """The text if it is short; else cut before the word that would pass ``n``."""
    cut = F.regexp_replace(F.substring(text, 1, n), " [^ ]*$", "")
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(cut, F.lit("...")))


#: Letters of scripts written without spaces: each is a word. Then what words hold otherwise.
LONE, WORD = r"[\p{IsHan}\p{IsHiragana}]", r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
#: Words of English analysis keep marks between letters, as in o'clock and U.S.A.
JOINED = WORD + "(?:['\u2019.\u00b7_]" + WORD + ")*"


def _words(text: Column, pattern: str) -> Column:
    apart = F.when(text.rlike(LONE), F.regexp_replace(text, f"({LONE})", " $1 ")).otherwise(text)
    return F.regexp_extract_all(F.lower(apart), F.lit(f"({pattern})"), 1)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return _words(text, WORD)


def english_words(text: Column) -> Column:
    """Lower-cased words without possessive endings and stop words."""
    bare = F.transform(_words(text, JOINED), lambda w: F.regexp_replace(w, "['\u2019]s$", ""))
    return F.filter(bare, lambda w: ~w.isin(STOP_WORDS))


def sentences(text: Column) -> Column:
    return sentences_of_squeezed(squeezed(text))


def sentences_of_squeezed(s: Column) -> Column:
    return F.filter(F.split(s, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda x: F.trim(x) != "")


def chunks(text: Column, ceiling: int = CHUNK_TOKENS) -> Column:
    """Sentences packed greedily; the last sentence of a chunk opens the next one too.

    A text within the ceiling is one chunk, and so is a sentence beyond it.
    """
    # the open chunk's first sentence, its words, the last sentence's, and its number
    start = F.expr("named_struct('done', cast(array() as array<struct<a:int,b:int>>), 'first', 1, 'held', 0, 'last', 0, 'i', 0)")

    def add(state: Column, own: Column) -> Column:
        i = state["i"] + 1
        full = (i > state["first"]) & (F.ceil((state["held"] + own) * TOKENS_A_WORD) > ceiling)
        carry = full & (i - state["first"] > 1)
        closed = F.concat(state["done"], F.array(F.struct(state["first"].alias("a"), state["i"].alias("b"))))
        return F.struct(
            F.when(full, closed).otherwise(state["done"]).alias("done"),
            F.when(carry, state["i"]).when(full, i).otherwise(state["first"]).alias("first"),
            F.when(carry, state["last"] + own).when(full, own).otherwise(state["held"] + own).alias("held"),
            own.alias("last"),
            i.alias("i"),
        )

    def joined(parts: Column) -> Column:
        words = F.transform(parts, lambda s: F.size(F.split(s, " ")))
        spans = F.aggregate(words, start, add, lambda s: F.concat(s["done"], F.array(F.struct(s["first"].alias("a"), s["i"].alias("b")))))
        return F.transform(spans, lambda x: F.array_join(F.slice(parts, x["a"], x["b"] - x["a"] + 1), " "))

    # lists of one, so that a text is squeezed once and its sentences are split once
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    fits = lambda s: F.ceil(words_of_squeezed(s) * TOKENS_A_WORD) <= ceiling
    return once(squeezed(text), lambda s: F.when(fits(s), F.array(s)).otherwise(once(sentences_of_squeezed(s), joined)))


def citations(answer: Column) -> Column:
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("long"))


def abstained(answer: Column) -> Column:
    """Whether the first line that isn't blank, without quotes, stars and stops, abstains."""
    bare = F.regexp_replace(answer, f"^{SPACES}+|{SPACES}+$", "")
    first = F.regexp_replace(F.split_part(F.regexp_replace(bare, r"\r\n?", "\n"), F.lit("\n"), F.lit(1)), f"^{SPACES}+|{SPACES}+$", "")
    return F.upper(F.regexp_replace(first, "^[`*. ]+|[`*. ]+$", "")) == ABSTAIN


def versioned(name: Column) -> Column:
    """struct(base, version): a trailing v and digits are the version; 1 without."""
    version = F.regexp_extract(name, "^.+v([0-9]+)$", 1)
    return F.struct(
        F.when(version == "", name).otherwise(F.regexp_extract(name, "^(.+)v[0-9]+$", 1)).alias("base"),
        F.when(version == "", F.lit(1)).otherwise(version.try_cast("long")).cast("long").alias("version"),
    )


def timestamp_of(value: Column) -> Column:
    """An ISO 8601 time; without zone it is UTC, and anything else is null."""
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?$")
    zoned = F.when(value.rlike("(Z|[+-]\\d{2}:\\d{2})$") & value.contains(":"), value).otherwise(F.concat(value, F.lit("Z")))
    dated = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(value, F.lit("T00:00:00Z"))).otherwise(zoned)
    return F.when(iso, F.try_to_timestamp(dated))


def byline(authors: Column, shown: int = 3) -> Column:
    """The first authors, and how many more there are."""
    n = F.size(authors)
    first = F.array_join(F.slice(authors, 1, shown), ", ")
    return F.when(n == 0, "Unknown authors").when(n > shown, F.concat(first, F.lit(" +"), (n - shown).cast("string"))).otherwise(first)
