"""Words, lexemes and other small text functions, as columns.

Lower case is Spark's ``lower``; queries that are compared with other engines
keep to ASCII words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from packsieve.operators.predicates import NAME, NAME_BYTES

# TCP flags by bit, lowest first; the ninth is the nonce sum.
TCP_FLAGS = ("fin", "syn", "reset", "push", "ack", "urg", "ece", "cwr", "ns")
# What a word, a lexeme and the bounds of a mention are.
WORD, LEXEME = r"[\p{L}\p{N}]+", r"[a-z0-9]+(?:[._-][a-z0-9]+)*"
MENTION_FROM, MENTION_TO = r"(?i)(?<![0-9A-Za-z_.:/-])", r"(?![0-9A-Za-z_:/-]|\.[0-9A-Za-z])"


def unicode_words(x: Column) -> Column:
    """letters and digits of any script, lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def lexemes(x: Column) -> Column:
    """F2: words with inner dots, underscores and hyphens kept: field names as people write them."""
    return F.regexp_extract_all(F.lower(x), F.lit(LEXEME), F.lit(0))


def ascii_words(x: Column, stop: Sequence[str] = ()) -> Column:
    """runs of a-z and 0-9 of the lower-cased text, stop words left out."""
    found = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def ngrams(words: Column, n: int) -> Column:
    """the different runs of n words."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def initials(words: Column) -> Column:
    """the first letters of words, numbers whole."""
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[0-9]+$"), w).otherwise(F.substr(w, F.lit(1), F.lit(1)))), "")


def singular(word: Column) -> Column:
    """``ies`` at the end of a word of over four letters becomes ``y``."""
    return F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.substr(word, F.lit(1), F.length(word) - 3), F.lit("y"))).otherwise(word)


def abbreviates(token: Column, word: Column, least: int = 3, most: int = 32) -> Column:
    """same first letter, and the token's letters occur in the word in order; token shorter, of ``least`` letters or more."""
    pattern = F.concat(F.lit("^"), F.array_join(F.split(token, ""), ".*"))
    return (F.length(token) >= least) & (F.length(token) < F.length(word)) & (F.length(word) <= most) & F.rlike(word, pattern)


def mentions(x: Column, token: Column) -> Column:
    """F8: the token stands in the text as a whole, whatever its case; a sentence's full stop may follow."""
    quoted = F.regexp_replace(token, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    return F.rlike(x, F.concat(F.lit(MENTION_FROM), quoted, F.lit(MENTION_TO)))


def integer_literal(x: Column) -> Column:
    """the value of a literal: 0x hexadecimal, 0b binary, leading 0 octal, else decimal."""
    low = F.lower(x)
    tail = lambda n: F.substr(low, F.lit(n), F.length(low))
    return (
        F.when(low.startswith("0x"), F.conv(tail(3), 16, 10)).when(low.startswith("0b"), F.conv(tail(3), 2, 10))
        .when(low.startswith("0") & (F.length(low) > 1), F.conv(low, 8, 10)).otherwise(low).try_cast("long")
    )


def flag_names(word: Column, names: Sequence[str] = TCP_FLAGS) -> Column:
    """the names of the bits set, lowest first."""
    return F.filter(F.array(*[F.when(F.getbit(word.cast("long"), F.lit(i)) == 1, F.lit(n)) for i, n in enumerate(names)]), lambda n: n.isNotNull())


def flag_word(flags: Column, names: Sequence[str] = TCP_FLAGS) -> Column:
    """F12, back: the number whose bits are named."""
    values = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, 1 << i)])
    return F.aggregate(flags, F.lit(0), lambda a, n: a.bitwiseOR(F.element_at(values, n)))


def cut_bytes(x: Column, most: int) -> Column:
    """the longest prefix of whole characters within ``most`` UTF-8 bytes.

    Cuts the bytes, then drops the start of a character that was cut in two.
    """
    raw = F.substring(F.encode(x, "UTF-8"), 1, most)
    tries = F.array(*[F.substring(F.encode(x, "UTF-8"), 1, most - k) for k in range(min(4, most + 1))])
    valid = F.filter(tries, lambda b: F.is_valid_utf8(b.cast("string")))
    return F.when(F.octet_length(x) <= most, x).otherwise(F.coalesce(F.element_at(valid, 1), raw).cast("string"))


def leading_verdict(x: Column, names: Sequence[str]) -> Column:
    """the verdict that a text begins with, or null."""
    found = F.regexp_extract(x, r"^\s*(" + "|".join(names) + r")\b", 1)
    return F.when(found != "", found)


def lexical_score(raw: Column, unmatched: Column, verbatim: Column, slack: int = 2, bonus: int = 10**9) -> Column:
    """weight per thousand over what the name has besides, plus a bonus for a name written out."""
    base = F.when(raw > 0, F.floor(raw * 1000 / (unmatched + slack)).cast("long") + F.when(verbatim, F.lit(bonus)).otherwise(0))
    return F.coalesce(base, F.lit(0)).cast("long")


def is_field_name(x: Column) -> Column:
    """F26."""
    return x.rlike(f"^(?:{NAME.pattern})$") & (F.octet_length(x) <= NAME_BYTES)
