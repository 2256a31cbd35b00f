"""Caption text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"\p{Punct}"
SPACE = r"(?U)\s"


def py_strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"{SPACE}+$|^\s+", "")


def prepend_if_missing(c: Column, phrase: str) -> Column:
    """phrase before c unless c starts with it; null stays null."""
    return F.when(c.startswith(phrase), c).otherwise(F.concat(F.lit(phrase), c))


def remove_literal(c: Column, phrase: str) -> Column:
    """Without any occurrence of phrase."""
    return F.replace(c, F.lit(phrase), F.lit(""))


def normal_caption(c: Column) -> Column:
    """For the no-op test: stripped, without .!? at the ends, in lower case."""
    return F.lower(F.btrim(py_strip(c), F.lit(".!?")))


def clean_tokens(c: Column) -> Column:
    """Words without ASCII punctuation, case kept."""
    return F.filter(F.split(F.regexp_replace(c, PUNCTUATION, ""), rf"{SPACE}+"), lambda w: w != "")


def words_added(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(clean_tokens(after), clean_tokens(before)))


def words_removed(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(clean_tokens(before), clean_tokens(after)))


def words_shared(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_intersect(clean_tokens(before), clean_tokens(after)))


def phrase_position(tokens: Column, phrase: Column) -> Column:
    """First 0-based start of the token sequence phrase in tokens; null if there is none or phrase is empty."""
    n = F.size(phrase)
    last = F.size(tokens) - n
    starts = F.when((n > 0) & (last >= 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
    return F.get(F.filter(starts, lambda i: F.slice(tokens, i + 1, n) == phrase), F.lit(0))


def word_positions(caption: Column, word: Column) -> Column:
    """All 0-based positions of word among the parts between single spaces."""
    parts = F.split(caption, " ", -1)
    return F.filter(F.transform(parts, lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())


def replaced_words(before: Column, after: Column) -> Column:
    """(position, old, new) where two captions of equally many words differ; null for unequal lengths."""
    a, b = F.split(before, " ", -1), F.split(after, " ", -1)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("old"), y.alias("new")))
    placed = F.transform(pairs, lambda p, i: F.struct(i.alias("position"), p["old"].alias("old"), p["new"].alias("new")))
    return F.when(F.size(a) == F.size(b), F.filter(placed, lambda p: p["old"] != p["new"]))


def highlight(c: Column, term: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Each literal match of term, in any case, between two strings; an empty term changes nothing."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(c, f"(?i)({quoted})", f"{before}$1{after}") if term else c


def folder_key(idx: Column) -> Column:
    """Zero-padded to seven digits; longer indexes keep all theirs."""
    return F.format_string("%07d", idx)


def persona_name(persona: Column) -> Column:
    """What stands before the first comma."""
    return py_strip(F.split_part(persona, F.lit(","), F.lit(1)))
