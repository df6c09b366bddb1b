"""Parsing free-text model responses, and the results' bookkeeping."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import lines, strip

try:
    import yaml
except ImportError:  # a flat subset is parsed without it
    yaml = None

#: Words that lead the two answers (fixed values).
SOURCE_KEYS = ("final_sentence", "final sentence", "final output", "source", "sentence", "final fragment", "result")
TRANSLATION_KEYS = ("english_translation", "english translation", "translation")
#: Words of reasoning; a source with one of them and twenty words or more is no answer. The second line is our own.
REASONING = ("modifies", "modifying", "context", "clitic", "inflection", "replace") + (
    "the", "this", "should", "because", "rule", "sentence")


def response_text(kind: str, c: str) -> Column:
    """The answer in a batch (candidates) or chat (choices) response given as JSON; empty when missing."""
    path = "$.candidates[0].content.parts[0].text" if kind == "batch" else "$.choices[0].message.content"
    return F.coalesce(F.get_json_object(c, path), F.lit(""))


def _flat(block: str) -> dict | None:
    if yaml is not None:
        try:
            got = yaml.safe_load(block)
        except yaml.YAMLError:
            return None
        return got if isinstance(got, dict) else None
    pairs = [x.split(":", 1) for x in block.splitlines() if ":" in x]
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs} or None


def _cleaned(value: str) -> str:
    return re.sub(r"\*\*|Rule #\d+|\[[^\]]*\]", "", value).strip().strip("\"'`*").strip()


def _is_reasoning(value: str) -> bool:
    words = value.lower().split()
    return "original sentence" in value.lower() or (len(words) >= 20 and any(w in words for w in REASONING))


def _after(rows: list[str], keys: tuple[str, ...], guarded: bool) -> str:
    """The value of the first line that names a key and gives one: after its colon or star, or on the next line."""
    for i, line in enumerate(rows):
        low = line.lower()
        for key in keys:
            if key in low:
                rest = re.split(r"[:*]", line[low.index(key) + len(key) :], maxsplit=1)
                value = _cleaned(rest[1]) if len(rest) > 1 else ""
                if len(rest) > 1 and not value and i + 1 < len(rows):
                    value = _cleaned(rows[i + 1])
                if value and not (guarded and _is_reasoning(value)):
                    return value
    return ""


def final_answer(text: str | None) -> tuple[str, str]:
    """(source, translation) of a response: from the last fenced YAML block that is a mapping, else from the lines that
    name them (value after a colon or star, or on the next line). Missing parts are empty."""
    for block in reversed(re.findall(r"```(?:yaml)?\s*\n(.*?)(?:```|\Z)", text or "", re.S)):
        got = _flat(block)
        if got:
            low = {str(k).lower(): v for k, v in got.items()}
            s = next((str(low[k]) for k in SOURCE_KEYS if low.get(k)), "")
            t = next((str(low[k]) for k in TRANSLATION_KEYS if low.get(k)), "")
            if s or t:
                return s.strip(), t.strip()
    rows = [x.strip() for x in (text or "").splitlines() if x.strip() and not x.strip().startswith("```")]
    return _after(rows, SOURCE_KEYS, True), _after(rows, TRANSLATION_KEYS, False)


def final_answers(responses: DataFrame, text: str = "text") -> DataFrame:
    """Adds source and translation. Responses are parsed as they come, a hundred to a batch: a batch of Arrow has up to 10,000
    whole texts, and twice again as their answers, in every worker."""
    parse = F.udf(final_answer, "source string, translation string", useArrow=False)
    return responses.withColumn("_a", parse(F.col(text))).withColumns({"source": F.col("_a.source"), "translation": F.col("_a.translation")}).drop("_a")


def yaml_rows(text: str | None, fields: tuple[str, ...]) -> list[dict]:
    """The mappings of all YAML documents in a response; a list gives its mappings, an error gives none."""
    body = re.sub(r"```(?:yaml)?", "", text or "")
    if yaml is None:
        got = [_flat(body)]
    else:
        try:
            got = [y for d in yaml.safe_load_all(body) for y in (d if isinstance(d, list) else [d])]
        except yaml.YAMLError:
            return []
    return [{f: None if g.get(f) is None else ", ".join(sorted(map(str, g[f]))) if isinstance(g[f], list) else str(g[f]) for f in fields} for g in got if isinstance(g, dict)]


def extracted_rules(responses: DataFrame, fields: tuple[str, ...], text: str = "text") -> DataFrame:
    """One row a mapping, with ordinal `ord` in its response and the other columns of the response."""

    @F.pandas_udf("array<map<string,string>>")
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([yaml_rows(t, fields) for t in texts])

    keep = [c for c in responses.columns if c != text]
    return responses.select(*keep, F.posexplode(parse(F.col(text))).alias("ord", "_m")).select(*keep, "ord", *[F.try_element_at("_m", F.lit(f)).alias(f) for f in fields])


def last_two_lines(c: Column) -> tuple[Column, Column]:
    """(source, translation) from the last two lines if the last names a translation: the text after each first colon."""
    two = F.slice(F.filter(F.transform(lines(c), strip), lambda x: x != ""), -2, 2)
    ok = (F.size(two) == 2) & F.lower(F.get(two, 1)).contains("translation")
    value = lambda i: F.when(ok, strip(F.regexp_replace(F.get(two, i), "^[^:]*:", "")))
    return F.when(F.size(F.filter(F.transform(lines(c), strip), lambda x: x != "")) >= 2, value(0)), F.when(F.size(F.filter(F.transform(lines(c), strip), lambda x: x != "")) >= 2, value(1))


def last_labelled(c: Column, label: str) -> Column:
    """The value of the last line that begins with the label and a colon; null without one."""
    found = F.filter(F.transform(lines(c), strip), lambda x: F.lower(x).startswith(label + ":"))
    return strip(F.regexp_replace(F.try_element_at(found, F.lit(-1)), "^[^:]*:", ""))


def parse_outcomes(parsed: DataFrame, group: str) -> DataFrame:
    """Counts of failures, of answers that lack one part, and of successes."""
    s, t = F.coalesce("source", F.lit("")) != "", F.coalesce("translation", F.lit("")) != ""
    return parsed.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~s & ~t).alias("failed"), F.count_if(~s & t).alias("no_source"), F.count_if(s & ~t).alias("no_translation"), F.count_if(s & t).alias("complete")
    )
