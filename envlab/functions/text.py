"""Text expressions: whitespace tokenising (F1), case folding (F2), spurious-prefix injection (F3, F4),
blank-line predicate (P3). All are JVM expressions (no Python UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from envlab.functions.draws import draw

# Fixed values of the reference.
# Words that receive a prefix (compared case-insensitively):
TARGET_TOKENS = ("the", "a", "and", "to", "of", "in", "for", "is", "with")
# The two spurious prefixes; group 0 is aligned with the first, group 1 with the second:
PREFIX_GROUP0 = "<AAA>"
PREFIX_GROUP1 = "<BBB>"
# Characters Python's str.split() treats as whitespace (str.isspace), as one regex class that
# Java regex and RE2 read the same way:
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WHITESPACE_RUN = WHITESPACE_CLASS + "+"
NON_WHITESPACE = WHITESPACE_CLASS.replace("[", "[^", 1)
# The same set for Java regex, written with the Unicode White_Space class (about 3x faster to
# split with than the explicit list above, which is kept for RE2-based engines):
JAVA_WHITESPACE_RUN = r"(?U)[\s\x1C-\x1F]+"
JAVA_NON_WHITESPACE = r"(?U)[^\s\x1C-\x1F]"
MAX_TARGET_LEN = max(len(t) for t in TARGET_TOKENS)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """``text.split()``: split on runs of whitespace, no empty tokens."""
    return F.filter(F.split(col_(text), JAVA_WHITESPACE_RUN), lambda x: x != F.lit(""))


def is_target(token: Column) -> Column:
    """Case-insensitive membership in the target words (a length test first skips long words)."""
    return (F.length(token) <= MAX_TARGET_LEN) & F.lower(token).isin(*TARGET_TOKENS)


def inject_prefix(text, group, p_align, key, seed: int, tag: str = "inj") -> Column:
    """before every target token put ``<AAA>`` or ``<BBB>``.

    With probability ``p_align`` (an independent draw per token, keyed by the row ``key`` and
    the token position) the prefix agrees with the row's group (group 0 -> ``<AAA>``), otherwise
    it is flipped. Tokens are re-joined by single spaces.
    """
    g, p, k = col_(group), col_(p_align), col_(key)

    def one(w, i):
        aligned = draw(seed, tag, k, i) < p
        pref = F.when(aligned == (g == 0), F.lit(PREFIX_GROUP0 + " ")).otherwise(F.lit(PREFIX_GROUP1 + " "))
        return F.when(is_target(w), F.concat(pref, w)).otherwise(w)

    return F.array_join(F.transform(tokens(text), one), " ")


def toy_text(y, p_align, key, seed: int, tag: str = "toy") -> Column:
    """``"<prefix> <letter>"``; y = 1 -> 'a', y = 0 -> 'b'; aligned prefix <BBB> for y = 1, <AAA> for y = 0."""
    yc = col_(y)
    aligned = draw(seed, tag, col_(key)) < col_(p_align)
    letter = F.when(yc == 1, F.lit("a")).otherwise(F.lit("b"))
    pref = F.when(aligned == (yc == 1), F.lit(PREFIX_GROUP1)).otherwise(F.lit(PREFIX_GROUP0))
    return F.concat(pref, F.lit(" "), letter)


def non_blank(text) -> Column:
    """Keep lines that are not empty and not only whitespace."""
    t = col_(text)
    return t.isNotNull() & t.rlike(JAVA_NON_WHITESPACE)


def count_prefix(text, prefix: str) -> Column:
    """Number of tokens equal to ``prefix`` in a whitespace-tokenised text."""
    return F.size(F.filter(tokens(text), lambda x: x == F.lit(prefix)))
