"""Scalar text operators on columns."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The most characters of a request's fields.
LIMITS = {"task": 10000, "title": 500, "action": 2000, "object": 5000, "purpose": 5000}


def normalize_ws(c: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


#: What case folding makes of characters that lower-casing leaves as they are, by Unicode's rule as Python has it.
FOLDED = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.lower() == c != c.casefold()}


def casefold(c: Column) -> Column:
    """Unicode case folding; texts without a character of ``FOLDED`` are only lower-cased."""
    low = F.lower(c)
    table = F.create_map(*[F.lit(x) for pair in FOLDED.items() for x in pair])
    each = F.transform(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.when(low.rlike("[" + "".join(FOLDED) + "]"), F.array_join(each, "")).otherwise(low)


def casefold_key(c: Column) -> Column:
    return casefold(normalize_ws(c))


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


class _Plain(dict):
    """Of a character's number what its compatibility decomposition has beside marks that combine with the one before."""

    def __missing__(self, number: int) -> str:
        self[number] = "".join(c for c in unicodedata.normalize("NFKD", chr(number)) if not unicodedata.combining(c))
        return self[number]


PLAIN = _Plain()
#: So many different characters are replaced one after the other; a text with more is translated in one go.
EACH = 32


def without_marks(s: str) -> str:
    """A decomposition only puts marks into another order, so characters can be taken one by one."""
    if s.isascii():
        return s
    changed = [c for c in set(s) if c > "\x7f" and PLAIN[ord(c)] != c]
    if len(changed) > EACH:
        return s.translate(PLAIN)
    for c in changed:
        s = s.replace(c, PLAIN[ord(c)])
    return s


@F.pandas_udf(StringType())
def _without_marks(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else without_marks(s))


def nfkc_key(c: Column) -> Column:
    """Compatibility-composed, lower-cased, collapsed; through an Arrow UDF, so best on distinct values."""
    return F.lower(normalize_ws(_nfkc(F.coalesce(c, F.lit("")))))


def strip_accents(c: Column) -> Column:
    return _without_marks(F.coalesce(c, F.lit("")))


def compose_tagged(parts: list[tuple[str, Column]]) -> Column:
    """``[TAG] text`` of the parts that have text, joined by spaces."""
    one = lambda tag, c: F.when(normalize_ws(c) != "", F.concat(F.lit(f"[{tag}] "), normalize_ws(c)))
    return F.concat_ws(" ", *[one(tag, c) for tag, c in parts])


def compose_aop(action: Column, object_: Column, purpose: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(normalize_ws(c), F.lit("")) for c in (action, object_, purpose)])


def joined_lines(*parts: Column) -> Column:
    return F.trim(F.concat_ws("\n", *[normalize_ws(c) for c in parts]))


def entity_token(prefix: str, c: Column) -> Column:
    """One token for a whole phrase."""
    return F.concat(F.lit(prefix), F.regexp_replace(normalize_ws(c), r"\s+", "_"))


def lexical_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))


def stable_id(parts: list[Column], chars: int = 20) -> Column:
    """An id of several keys; a null key keeps its place by a mark of its own, so (a, null, b) and (a, b) differ."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]), 256), 1, chars)


def digest(c: Column) -> Column:
    """128 bits that stand for a text as a key, so that whole texts need not be shuffled to be compared."""
    return F.unhex(F.md5(c))


def rendered(template: str, **values: Column) -> Column:
    """A template with ``{name}`` replaced by columns."""
    out = F.lit(template)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def parsed_label(raw: Column, classes=("E0", "E1", "E2", "E3")) -> Column:
    """The label of an answer: from JSON as it is, else, in either case and with marks of bold type, from its label line or from the
    first line that begins with one; null if there is none."""
    names, upper = "|".join(classes), F.upper(raw)
    known = F.create_map(*[F.lit(c) for c in classes for _ in range(2)])
    of = lambda pattern: F.try_element_at(known, F.regexp_extract(upper, pattern, 1))
    found = F.coalesce(
        F.when(F.contains(raw, F.lit("{")), F.get_json_object(raw, "$.label")),  # a parser that fails is slow
        of(rf"LABEL\s*\({'/'.join(classes)}\)\s*:\s*\**\s*({names})\b"),
        of(rf"(?m)^\s*\**\s*({names})\b"),
    )
    return F.try_element_at(known, found)  # each pattern is looked for once, and only where those before it found nothing


def answer_reason(raw: Column, most: int = 500) -> Column:
    """An answer's reason: from JSON, else the beginning of the answer."""
    return F.coalesce(F.get_json_object(raw, "$.truncated_reason"), F.left(raw, F.lit(most)))


def request_error(task: Column, action: Column, object_: Column, purpose: Column, title: Column) -> Column:
    """What is wrong with a request, or null: too long a field, or neither a task nor an action with an object."""
    given = lambda c: normalize_ws(c) != ""
    fields = {"task": task, "title": title, "action": action, "object": object_, "purpose": purpose}
    out = F.when(~given(task) & ~(given(action) & given(object_)), "missing_task")
    for name, c in fields.items():
        out = F.when(F.length(F.coalesce(c, F.lit(""))) > LIMITS[name], f"{name}_too_long").otherwise(out)
    return out
