"""Scalar text functions as Column expressions; nothing here leaves the JVM.

Each function states the null rule: unless it says otherwise a null argument gives null.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists whose values must equal the ones that results are compared with (fixed values).
TOKEN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"
LEADING_MARK = r"^\s*\([a-zA-Z0-9]+\)\s*"
LETTER_LABEL = r"\b[a-zA-Z][\.:]\s*"
QUOTE_PAIRS = (("'", "'"), ('"', '"'), ("‘", "’"), ("“", "”"))
EDGE_QUOTES = "“”‘’\"'"
TRAILING_NOTES = (r"\s*\[[^\]]*\]\s*$", r"\s*\(see [^\)]*\)\s*$", r"\s*\([^\)]*et al\)\s*$", r"\s*\([^\)]*202[0-9][^\)]*\)\s*$")
GLOSS_RULES = (
    (r"(?i)\bk\.?\s*o\.?\b", "kind of"),
    (r"(?i)\bsp\.?\b", "species"),
    (r"(?i)\((1|2|3)?(sg|pl)?( poss| pron| refl)?\)", ""),
    (r"\b1sg\b", "first person singular"),
    (r"\b2sg\b", "second person singular"),
    (r"\([^a-zA-Z]*\)", ""),
)
GLOSS_EDGE = " .;:,-"
TRANSLATION_LEADS = ("translation:", "translation -", "translation in english:")
FINETUNE_PAIRS = (("“", "”"), ("‘", "’"), ("“", "”"), ("'", "'"))
GLOSS_ABBREVIATIONS = "sg pl du pst prs fut ipfv pfv prog hab nom acc erg gen dat loc all abl ins com ben top foc caus pass mid refl recip aux cop neg cond imp subj ind".split()
ENGLISH_WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which".split()


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once: bound as a lambda variable, so that chains of conditions don't multiply the expression."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at either end (all kinds, unlike trim)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Pieces between runs of white space, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def tokens(c: Column) -> Column:
    """Lower-cased ASCII word tokens, with inner apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def normalised(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def phrase_count(c: Column, phrase: str) -> Column:
    """Occurrences of a phrase of word characters in normalised text."""
    return F.regexp_count(normalised(c), F.lit(rf"\b{phrase}\b")).cast("long")


def estimated_tokens(c: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(c) / 4).cast("long")


def before(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def first_translation(c: Column) -> Column:
    """What stands before the first comma, then slash, then opening bracket."""
    return strip(functools.reduce(before, (",", "/", "("), c))


def after_colon(c: Column) -> Column:
    """Text after the first colon if there is one; always stripped."""
    return strip(F.regexp_replace(c, r"(?s)^[^:]*:", ""))


def senses(c: Column) -> Column:
    """Comma-separated senses, stripped, none empty."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda s: s != "")


def clean_gloss(c: Column) -> Column:
    out = strip(collapse(c))
    for pattern, to in GLOSS_RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.btrim(out, F.lit(GLOSS_EDGE))


def grammar(c: Column) -> dict[str, Column]:
    """number, person, possessive, clusivity told by marks in a gloss; later marks win."""
    return {
        "number": F.when(c.contains("(pl"), "Plur").when(c.contains("(sg"), "Sing"),
        "person": F.when(c.contains("3sg"), "3").when(c.contains("2sg"), "2").when(c.contains("1sg"), "1"),
        "possessive": F.when(c.contains("1sg"), F.lit(True)),
        "clusivity": F.when(c.contains("excl"), "Exclusive").when(c.contains("incl"), "Inclusive"),
    }


def clean_source(c: Column) -> Column:
    """A source sentence: one line, without a leading (x) and single-letter labels."""
    out = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    out = strip(F.regexp_replace(out, LEADING_MARK, " "))
    return collapse(strip(F.regexp_replace(out, LETTER_LABEL, " ")))


def _last(c: Column, mark: str) -> Column:
    """1-based position of the last occurrence, 0 if there is none."""
    found = F.instr(F.reverse(c), mark)
    return F.when(found == 0, 0).otherwise(F.length(c) - found + 1)


def widest_quote(c: Column) -> Column:
    """The stripped text inside the widest pair of quotes (the first of equals), null without a pair."""

    def inside(x: Column) -> Column:
        spans = F.array(*[F.struct((_last(x, b) - F.instr(x, a)).alias("width"), F.lit(-i).alias("first"), F.instr(x, a).alias("at")) for i, (a, b) in enumerate(QUOTE_PAIRS)])
        best = F.array_max(F.filter(spans, lambda s: (s["at"] > 0) & (s["width"] > 0)))
        return let(best, lambda m: F.when(m.isNotNull(), strip(F.substring(x, m["at"] + 1, m["width"] - 1))))

    return let(c, inside)


def clean_translation(c: Column) -> Column:
    """The widest quoted part or else the text without edge quotes, one line, without notes at its end."""
    line = F.replace(strip(c), F.lit("\n"), F.lit(" "))

    def unquoted(x: Column) -> Column:
        bare = strip(F.regexp_replace(F.regexp_replace(x, f"^[{EDGE_QUOTES}]+", ""), f"[{EDGE_QUOTES}]+$", ""))
        return F.coalesce(widest_quote(x), bare)

    out = collapse(let(line, unquoted))
    for pattern in TRAILING_NOTES:
        out = strip(F.regexp_replace(out, pattern, " "))
    return strip(collapse(out))


def between_single_quotes(c: Column) -> Column:
    """The stripped text from the first ‘ to the first ’ if both stand in it."""

    def cut(x: Column) -> Column:
        a, b = F.instr(x, "‘"), F.instr(x, "’")
        return F.when((a > 0) & (b > 0), strip(F.when(b > a, F.substring(x, a + 1, b - a - 1)).otherwise(""))).otherwise(x)

    return let(c, cut)


def _unpaired(c: Column, pairs) -> Column:
    def bare(a: str, b: str):
        return lambda x: F.when((F.length(x) > 1) & x.startswith(a) & x.endswith(b), strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)

    for a, b in pairs:
        c = let(c, bare(a, b))
    return c


def finetune_source(c: Column) -> Column:
    """The text between single quotes if there is one, without a pair of quotes around it."""
    return _unpaired(between_single_quotes(c), FINETUNE_PAIRS)


def finetune_translation(c: Column) -> Column:
    """As finetune_source, without words that announce a translation."""
    def led(lead: str):
        return lambda x: F.when(F.lower(x).startswith(lead), strip(F.substring(x, F.lit(len(lead) + 1), F.length(x)))).otherwise(x)

    out = between_single_quotes(c)
    for lead in TRANSLATION_LEADS:
        out = let(out, led(lead))
    return _unpaired(out, FINETUNE_PAIRS)


def structure(c: Column) -> dict[str, Column]:
    """Eight surface features of a line; those of an empty line are 0."""
    n = F.length(c)
    parts = words(c)
    count = F.size(parts)
    lengths = F.transform(parts, lambda w: F.length(w).cast("double"))
    mean = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / count
    square = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x) / count
    ascii_chars = F.regexp_count(c, F.lit(r"[\x00-\x7F]"))
    none = F.lit(0.0)
    return {
        "length": n.cast("double"),
        "num_tokens": count.cast("double"),
        "ascii_ratio": F.when(n > 0, ascii_chars / n).otherwise(none),
        "non_ascii": (n - ascii_chars).cast("double"),
        "digit_ratio": F.when(n > 0, F.regexp_count(c, F.lit(r"[0-9]")) / n).otherwise(none),
        "has_marks": c.rlike(r"[=~\-]").cast("double"),
        "token_mean": F.when(count > 0, mean).otherwise(none),
        "token_std": F.when(count > 0, F.sqrt(F.greatest(none, square - mean * mean))).otherwise(none),
    }


def igt_class(c: Column) -> Column:
    """reject, IGT, English or unknown. A gloss token weighs two; English is told by the share of its function words."""
    parts = F.filter(F.split(c, r"[\s.\-=:/]+"), lambda t: t != "")
    gloss = F.filter(parts, lambda t: F.lower(t).isin(GLOSS_ABBREVIATIONS) | F.lower(t).rlike("^[123](sg|pl|du)$"))
    bare = F.regexp_replace(c, r"\[.*?\]", "")
    seen = tokens(bare)
    english = F.size(F.filter(seen, lambda t: t.isin(ENGLISH_WORDS))) / F.greatest(F.size(seen), F.lit(1))
    return (
        F.when(c.isNull() | (F.size(parts) <= 0), "reject")
        .when(2 * F.size(gloss) / F.greatest(F.size(parts), F.lit(1)) > 0.10, "IGT")
        .when((F.length(bare) >= 20) & (english >= 0.2), "English")
        .when((F.length(bare) >= 40) & (english >= 0.15), "English")
        .otherwise("unknown")
    )


def penn_to_wordnet(tag: Column) -> Column:
    """Word class of a part-of-speech tag: first letters decide, noun by default."""
    return (
        F.when(tag.startswith("J"), "a").when(tag.startswith("V"), "v").when(tag.startswith("N"), "n").when(tag.startswith("R") | tag.isin("IN", "CC"), "r").when(tag == "DT", "a").otherwise("n")
    )


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def sentences(c: Column) -> Column:
    """Stripped sentences: runs up to . ! or ? with closing marks, or up to the end."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"""[^.!?]+[.!?]*["')\]]*"""), F.lit(0)), strip), lambda s: s != "")


def gloss_pieces(c: Column) -> Column:
    return F.split(c, r"[=.\-]")


def highlighted(c: Column, query: str, before_: str = "<mark>", after: str = "</mark>") -> Column:
    """Every case-insensitive match of a non-empty query wrapped."""
    if not query:
        return c
    quoted = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(c, f"(?iu)({quoted})", f"{before_}$1{after}")


def quoted_final(c: Column, group: int) -> Column:
    """The first (1) or second (2) quoted part after "Final Output:", stripped; null without one."""
    found = F.regexp_extract(c, r'(?s)Final Output:\s*"(.*?)"\s*"(.*?)"', group)
    return F.when(c.rlike(r'(?s)Final Output:\s*"(.*?)"\s*"(.*?)"'), strip(found))


def parsed_translation(c: Column) -> Column:
    """What follows "english_translation:" up to a code fence or the end, else the last non-empty line."""
    found = F.regexp_extract(c, r"(?is)english_translation:\s*(.*?)(?:```|$)", 1)
    last = F.try_element_at(F.filter(F.transform(lines(c), strip), lambda x: x != ""), F.lit(-1))
    return F.when(strip(found) != "", strip(found)).otherwise(F.coalesce(last, F.lit("")))


def score_band(c: Column) -> Column:
    return F.when(c >= 90, "green").when(c >= 70, "orange").otherwise("red")


def border_width(confidence: Column) -> Column:
    return 0.4 + 1.6 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(1.0))))
