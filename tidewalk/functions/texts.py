"""Text as columns: cleaning, tokens, bigrams, statistics, lemmas. Built-in expressions, but for character references, of which there are thousands."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .exprs import c

#: Stop words of this engine (a documented list of its own), and words of the lending trade (fixed values).
STOP_WORDS = tuple("a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its just me more my no not of on one only or other our out over she so some than that the their them then there these they this to up us was we were what when which who will with would you your".split())
DOMAIN_WORDS = ("added", "borrower", "loan", "lending", "club", "thanks", "thank", "quot", "consideration", "time", "just", "like", "want", "make", "need", "br")
#: What the form puts before a text of its own (fixed values).
BOILERPLATE = r"^\s*borrower\s+added\s+on\s+\d{2}/\d{2}/\d{2}\s*>\s*"
BOILERPLATE_ANYWHERE = r"(?i)(?:borrower\s+|\d+\s+)?added\s+on\s+\d{2}/\d{2}/\d{2}\s*>?"
#: All blanks of Unicode and the separators of ASCII.
BLANKS = r"(?U)[\s\x1C-\x1F]+"
#: Endings of inflected words and what they stand for, verbs and nouns (fixed values).
VERB_ENDINGS = (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""))
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def letters(x: Column | str, boilerplate: bool = True) -> Column:
    """Lower-case a-z and single blanks; null counts as empty."""
    out = F.lower(F.coalesce(c(x), F.lit("")))
    if boilerplate:
        out = F.regexp_replace(out, BOILERPLATE, "")
    return F.trim(F.regexp_replace(out, r"[^a-z]+", " "))


def tokens(cleaned: Column | str) -> Column:
    """Words of a cleaned text; none if it is empty."""
    return F.array_remove(F.split(c(cleaned), " "), "")


def content_words(words: Column, stop: tuple[str, ...] = STOP_WORDS + DOMAIN_WORDS, least: int = 2) -> Column:
    """Words of `least` letters that aren't in the list (a hash set, whatever its length)."""
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def cleaned(x: Column | str, boilerplate: bool = True, stop: tuple[str, ...] = STOP_WORDS + DOMAIN_WORDS) -> Column:
    """Cleaned text without stop words and single letters."""
    return F.array_join(content_words(tokens(letters(x, boilerplate)), stop), " ")


def lemmatised(words: Column, lemmas: dict[str, str]) -> Column:
    """Words by their lemmas, where the given table has one; an empty table changes nothing."""
    if not lemmas:
        return words
    table = F.create_map(*[F.lit(v) for pair in lemmas.items() for v in pair])
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))


def by_rules(word: Column, known: list[str], endings: tuple[tuple[str, str], ...], exceptions: dict[str, str]) -> Column:
    """The shortest of the known words that a word stands for (itself, or itself with an ending taken back; of equal lengths the first); exceptions go before, unknown words stay."""
    forms = [F.when(word.isin(*known), word)] if known else []
    for ending, instead in endings if known else ():
        form = F.concat(F.substring(word, 1, F.length(word) - len(ending)), F.lit(instead))
        forms.append(F.when(word.endswith(ending) & (F.length(word) > len(ending)) & form.isin(*known), form))
    found = F.array_compact(F.array(*forms)) if forms else F.array().cast("array<string>")
    best = F.array_min(F.transform(found, lambda f: F.struct(F.length(f).alias("n"), (F.array_position(found, f)).alias("place"), f.alias("form"))))["form"]
    special = F.try_element_at(F.create_map(*[F.lit(x) for pair in exceptions.items() for x in pair]), word) if exceptions else F.lit(None).cast("string")
    return F.coalesce(special, best, word)


def lemmas_by_rules(words: Column, verbs: list[str], nouns: list[str], exceptions: tuple[dict[str, str], dict[str, str]] = ({}, {})) -> Column:
    """Words as verbs, and what that gives as nouns: endings are taken back where that gives a known word."""
    return F.transform(words, lambda w: by_rules(by_rules(w, verbs, VERB_ENDINGS, exceptions[0]), nouns, NOUN_ENDINGS, exceptions[1]))


@F.pandas_udf(StringType())
def unescaped(x: pd.Series) -> pd.Series:
    """Named and numeric character references resolved, longest names first, in one pass."""
    return x.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def natural(x: Column | str) -> Column:
    """Natural text for a language model: references resolved first, then boilerplate out, line breaks, blanks collapsed."""
    out = F.regexp_replace(unescaped(F.coalesce(c(x), F.lit(""))), BOILERPLATE_ANYWHERE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?iU)<\s*br\s*/?\s*>", " "), BLANKS, " "))


def long_words(cleaned_: Column | str, least: int = 3) -> Column:
    return F.regexp_extract_all(c(cleaned_), F.lit(f"([a-zA-Z]{{{least},}})"), 1)


def bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def joined(*columns: str) -> Column:
    """Columns with one blank between them, then trimmed; a null column leaves its blank."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(c(x), F.lit("")) for x in columns]))


def statistics(raw: str, cleaned_: str) -> dict[str, Column]:
    """char_len, uniq_words, avg_word_len, removed_words, ttr."""
    before, after = F.array_remove(F.split(F.trim(F.regexp_replace(F.coalesce(c(raw), F.lit("")), r"\s+", " ")), " "), ""), tokens(cleaned_)
    n = F.size(after)
    letters_ = F.aggregate(after, F.lit(0), lambda acc, w: acc + F.length(w))
    return {
        "char_len": F.length(F.coalesce(c(raw), F.lit(""))), "uniq_words": F.size(F.array_distinct(after)),
        "avg_word_len": F.when(n > 0, letters_ / n).otherwise(0.0), "removed_words": F.greatest(F.size(before) - n, F.lit(0)), "ttr": F.when(n > 0, F.size(F.array_distinct(after)) / n).otherwise(0.0),
    }
