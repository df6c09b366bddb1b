"""Token analyses: summaries, glosses beside words, and parts of speech."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type of an analysed sentence: an array of its tokens.
TOKENS = "array<struct<word:string,lemma:string,upos:string,tag:string,morph:map<string,string>>>"
#: Morphological keys that prompts show (fixed values).
SHOWN = ("Case", "Number", "Gender")


def _feature(token: Column, key: str) -> Column:
    return F.try_element_at(token["morph"], F.lit(key))


def summary(tokens: Column) -> dict[str, Column]:
    """tense (first), number (first; any later Plur overrides), plural_word (last token that did), genders (all).

    The number's first token never counts as plural word.
    """
    numbered = F.filter(tokens, lambda t: F.coalesce(_feature(t, "Number"), F.lit("")) != "")
    later = F.filter(F.slice(numbered, F.lit(2), F.greatest(F.size(numbered) - 1, F.lit(0))), lambda t: _feature(t, "Number") == "Plur")
    first = F.try_element_at(numbered, F.lit(1))
    return {
        "tense": F.try_element_at(F.filter(F.transform(tokens, lambda t: _feature(t, "Tense")), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1)),
        "number": F.when(F.size(later) > 0, "Plur").otherwise(_feature(first, "Number")),
        "plural_word": F.try_element_at(later, F.lit(-1))["word"],
        "genders": F.filter(F.transform(tokens, lambda t: _feature(t, "Gender")), lambda x: F.coalesce(x, F.lit("")) != ""),
    }


def shown(tokens: Column) -> Column:
    """A line a token with its lemma and the features that prompts show."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("- "), t["lemma"], F.lit(": "), F.to_json(F.map_filter(t["morph"], lambda k, v: k.isin(*SHOWN))), F.lit("\n"))), "")


def pos_of_gloss(tokens: Column, gloss: Column, default: Column | str) -> Column:
    """The class of the first token whose lemma equals the gloss, both stripped and lower-cased."""
    want = F.lower(F.btrim(gloss))
    hit = F.try_element_at(F.filter(tokens, lambda t: F.lower(F.btrim(t["lemma"])) == want), F.lit(1))
    return F.coalesce(hit["upos"], F.lit(default) if isinstance(default, str) else default)


def gloss_of(word: Column, sentence: Column, gloss: Column) -> Column:
    """The gloss token at the place of the first sentence token that contains the word; empty when there is none."""
    pieces = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    at = F.array_position(F.transform(pieces(sentence), lambda t: F.lower(t).contains(F.lower(word))), True)
    return F.coalesce(F.when(at > 0, F.get(pieces(gloss), (at - 1).cast("int"))), F.lit(""))


def base_of(gloss: Column) -> Column:
    """The first piece of a gloss, split at = . and -."""
    return F.get(F.split(gloss, r"[=.\-]"), 0)
