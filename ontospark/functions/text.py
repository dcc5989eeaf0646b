"""Column functions on annotation literals, identifiers and templates. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_literal(text: Column, lower: bool = False, split_identifiers: bool = False) -> Column:
    """Underscores become spaces, first of all; identifiers may be split and letters lower-cased."""
    out = F.replace(text, F.lit("_"), F.lit(" "))
    if split_identifiers:
        is_identifier = out.rlike(r"^[A-Z][A-Za-z0-9]*$")
        out = F.when(is_identifier, split_identifier(out)).otherwise(out)
    return F.lower(out) if lower else out


def split_identifier(text: Column) -> Column:
    """``SuperNaturalPower`` to ``Super Natural Power``; runs of single characters stay together.

    What stands before the first capital or digit is no part of a word and is lost.
    """
    parts = F.regexp_extract_all(text, F.lit(r"([0-9A-Z][a-z]*)"), F.lit(1))
    marked = F.transform(parts, lambda p: F.when(F.length(p) == 1, p).otherwise(F.concat(F.lit("\u0001"), p, F.lit("\u0001"))))
    return F.trim(F.regexp_replace(F.array_join(marked, ""), "\u0001+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def strip_marks(text: Column) -> Column:
    """Without the angle brackets or quotes around it, and without backslashes."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^<(.*)>$", "$1"), r'^"(.*)"$', "$1")
    return F.replace(bare, F.lit("\\"), F.lit(""))


def is_a(text: Column, first: bool = True) -> Column:
    """``It is a X`` (not ``first``: ``it is a X``) with the article that X asks for: ``an`` before a small vowel, none before ``something``."""
    article = F.when(text.startswith("something"), F.lit("")).when(text.rlike("^[aeiou]"), F.lit("an ")).otherwise(F.lit("a "))
    return F.concat(F.lit("It is " if first else "it is "), article, text)


def as_clause(text: Column, first: bool = False) -> Column:
    """Without closing punctuation, the first letter in lower case (``first``: as it is)."""
    bare = F.rtrim(text, F.lit(PUNCTUATION))
    return bare if first else F.concat(F.lower(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))


def strip_preposition(text: Column) -> Column:
    """A noun phrase without a trailing preposition."""
    return F.regexp_replace(text, r" (%s)$" % "|".join(PREPOSITIONS), "")


def verb_phrase(text: Column) -> Column:
    """``is`` before a property's label that begins like a participle: a rule and its exceptions in place of a tagger."""
    first = F.substring_index(text, " ", 1)
    return F.when(first.rlike("^[a-z]+ed$") & ~first.isin(NO_PARTICIPLES), F.concat(F.lit("is "), text)).otherwise(text)


#: English prepositions that may close a property's label.
PREPOSITIONS = ["about", "above", "across", "after", "against", "along", "among", "around", "at", "before", "behind", "below", "beneath", "beside", "between", "by", "during", "for", "from", "in", "into", "like", "near", "of", "off", "on", "over", "through", "to", "under", "up", "with", "without"]
#: Verbs in the present that end like a participle.
NO_PARTICIPLES = ["bed", "bleed", "breed", "embed", "exceed", "feed", "heed", "need", "proceed", "seed", "shed", "shred", "speed", "succeed", "wed", "weed"]
#: The ASCII punctuation that templates cut off.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
