"""Expressions over texts, prompts and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, digits and underscores of any script.
TOKEN = r"(?U)\w+"
NO_LABEL = "[no label generated]"
#: Seconds to wait when an error message names none.
DEFAULT_WAIT = 60.0


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def is_not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def truncated(text: Column, max_words: int = 300) -> Column:
    """The first words joined by single spaces, with ``...`` behind them if there are more."""
    w = words(text)
    return F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.when(F.size(w) > max_words, F.lit("...")).otherwise(F.lit("")))


def prompt_entry(rank: Column, text: Column, max_words: int = 300) -> Column:
    return F.concat(F.lit("Document "), rank.cast("string"), F.lit(":\n"), truncated(text, max_words))


def filled(template: str, k: Column, block: Column) -> Column:
    """A template with ``{k}`` and ``{documents_block}`` replaced."""
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), k.cast("string")), F.lit("{documents_block}"), block)


#: A wait in a rate limit's message: minutes, which may be missing, and seconds.
WAIT = r"again in (?:([0-9]+) ?m)? ?([0-9]+(?:\.[0-9]*)?) ?s"


def wait_seconds(message: Column) -> Column:
    """Seconds named in a rate limit's message, as ``again in 7.5s`` or ``again in 1m30s``; else a minute."""
    minutes, seconds = (F.regexp_extract(message, WAIT, g) for g in (1, 2))
    named = F.when(minutes != "", minutes).otherwise("0").cast("double") * 60 + F.when(seconds != "", seconds).otherwise("0").cast("double")
    return F.when(seconds != "", named).otherwise(F.lit(DEFAULT_WAIT))


def wait_of(message: str) -> float:
    """wait_seconds() of one message, without Spark."""
    found = re.search(WAIT, message)
    return float(found[1] or 0) * 60 + float(found[2]) if found else DEFAULT_WAIT


def shown(name: Column, names: dict[str, str]) -> Column:
    """The name to display; a name that has no other is shown as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[name], name) if names else name


def cleaned_label(label: Column) -> Column:
    return F.coalesce(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""), F.lit(NO_LABEL))


def _set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def token_f1(truth: Column, generated: Column) -> Column:
    """F1 of token sets; ``_`` and ``.`` separate the truth's tokens only. No tokens on either side: 0."""
    t, g = _set(F.translate(truth, "_.", "  ")), _set(generated)
    common = F.size(F.array_intersect(t, g)).cast("double")
    # 2PR / (P + R) with P = c / |g| and R = c / |t| is 2c / (|g| + |t|).
    return F.when(common > 0, 2 * common / (F.size(g) + F.size(t))).otherwise(F.lit(0.0))
