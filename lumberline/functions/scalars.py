"""Scalar functions as Column builders."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FIELDS_PER_ENTRY, KEY_BYTES, LEVEL_WORDS, LEVELS, SEVERITIES, SEVERITY_WORDS, VALUE_BYTES

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def strings(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def severity_name(severity: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITIES)), severity), F.when(severity.isNotNull(), "unknown"))


def level_label(severity: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), F.least(severity, F.lit(7)))


def parse_severity(word: Column, levels: bool = False) -> Column:
    known = {n: i for i, n in enumerate(SEVERITIES)} | SEVERITY_WORDS | {str(i): i for i in range(8)} | (LEVEL_WORDS if levels else {})
    return F.try_element_at(strings(known), F.lower(F.trim(word)))


def number(text: Column) -> Column:
    """A finite plain or exponent number, else null."""
    bare = F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")
    value = F.when(bare.rlike(_NUMBER), bare.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def truncated(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8, never part of a character."""
    raw = text.cast("binary")
    cuts = (F.try_validate_utf8(F.substring(raw, 1, max(0, most - i)).cast("string")) for i in range(4))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts))


def sanitized_key(key: Column) -> Column:
    return F.substring(F.regexp_replace(key, "[^A-Za-z0-9_.-]", "_"), 1, KEY_BYTES)


def clipped(value: Column) -> Column:
    return truncated(value, VALUE_BYTES)


def at_most(fields: Column, n: int = FIELDS_PER_ENTRY) -> Column:
    """The first n entries of a map in the order of their keys."""
    return F.when(F.size(fields) > n, F.map_from_entries(F.slice(F.array_sort(F.map_entries(fields)), 1, n))).otherwise(fields)


def canonical_json(fields: Column) -> Column:
    """A map as JSON text with its keys in order; null for no fields."""
    return F.when(F.size(fields) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))))


# ---- templates ----
_OPEN, _CLOSE = r"\(\[\{\"'<", r",;:.)\]}\"'>!?"
_TOKEN = rf"^((?:[{_OPEN}]*+[^={_OPEN}][^=]*=)*+[{_OPEN}]*+)(?=.*[0-9].*?[{_CLOSE}]*$)(.*?[0-9].*?)([{_CLOSE}]*$)"
TOKENS = 48


def template(message: Column) -> Column:
    """The first line with every token that holds a digit as <*>; values of k=v alone, punctuation around tokens kept."""
    line = F.regexp_replace(F.split(message, "\n", 2)[0], r"\r$", "")
    tokens = F.slice(F.filter(F.split(line, r"(?U)\s+"), lambda x: x != ""), 1, TOKENS)
    return F.array_join(F.transform(tokens, lambda x: F.regexp_replace(x, _TOKEN, "$1<*>$3")), " ")


def search_hint(of: Column) -> Column:
    """Up to six plain words of a template."""
    words = F.transform(F.split(of, r"(?U)\s+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    plain = F.filter(words, lambda x: (F.octet_length(x) >= 3) & x.rlike(r"^[\p{L}\p{N}_]+\z"))
    return F.array_join(F.slice(plain, 1, 6), " ")


# ---- full text ----
def _folds() -> tuple[str, str]:
    """Latin letters with one combining mark, and their base letters."""
    pairs = [(chr(c), unicodedata.decomposition(chr(c)).split()) for c in range(0xC0, 0x250)]
    chosen = [(c, chr(int(d[0], 16))) for c, d in pairs if len(d) == 2 and not d[0].startswith("<") and unicodedata.combining(chr(int(d[1], 16)))]
    return "".join(c for c, _ in chosen), "".join(b for _, b in chosen)


FROM, TO = _folds()


def folded(text: Column) -> Column:
    """Tokens in lower case without diacritics, between single spaces, with one at either end."""
    bare = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}", ""), FROM.lower() + FROM.upper(), TO.lower() + TO.upper())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}\p{Co}]+", " ")), F.lit(" "))


def folded_term(text: str) -> str:
    """The same for a term, without the spaces around."""
    bare = "".join(c for c in text.lower() if unicodedata.category(c) != "Mn").translate(str.maketrans(FROM, TO))
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in bare).split())


# ---- globs ----
def is_glob(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def glob_regex(pattern: str) -> str:
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c) for c in re.sub(r"\*+", "*", pattern)) + r"\z"


def globs(column: Column, patterns: list[str]) -> Column:
    """One of the names or globs; none of them for an empty list."""
    names = [p for p in patterns if not is_glob(p)]
    found = column.isin(*names) if names else F.lit(False)
    for p in patterns:
        if is_glob(p):
            found = found | column.rlike(glob_regex(p))
    return found


def tags_of(host: Column, tags: dict[str, list[str]]) -> Column:
    """The tags of a host, in the order of the configuration."""
    return F.array_compact(F.array(*(F.when(globs(host, patterns), F.lit(name)) for name, patterns in tags.items()))) if tags else F.array().cast("array<string>")


def number_text(value: Column) -> Column:
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def duration_text(seconds: Column) -> Column:
    """Seconds under two minutes, minutes under two hours, else hours and minutes."""
    s = seconds.cast("string")
    hours = F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"), F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("string"), F.lit("m"))
    return F.when(seconds < 120, F.concat(s, F.lit("s"))).when(seconds < 7200, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).otherwise(hours)


def one_line(text: Column, chars: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), r"(?U)\s+", " "), 1, chars)
