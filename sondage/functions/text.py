"""Text functions of the survey (SF1-SF10, SF13, SF19-SF29) as native Column expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Irregular plurals (SF3) and cardinalities of the many side (SF4).
IRREGULAR = {
    "people": "person",
    "children": "child",
    "men": "man",
    "women": "woman",
    "data": "datum",
    "indices": "index",
    "statuses": "status",
    "aircraft": "aircraft",
    "series": "series",
}
MANY = ("n", "0..n", "1..n", "*", "0..*", "1..*", "m", "many")
GENERIC_TOKENS = ("id", "code", "number", "n", "key", "num")

#: White space as Unicode regular expressions see it; the Java default is ASCII only.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(1)
def _compatibility() -> tuple[str, str, dict[str, str], str]:
    """From the Unicode tables: characters with a one-character NFKC form, these forms, the longer forms, and a pattern of composing ASCII pairs."""
    one, forms, longer = [], [], {}
    for point in range(0x80, 0x1FFFF):
        if 0xD800 <= point < 0xE000 or 0xAC00 <= point < 0xD7B0:
            continue
        char = chr(point)
        form = unicodedata.normalize("NFKC", char)
        if form == char:
            continue
        if len(form) == 1 and point < 0x10000 and ord(form) < 0x10000:
            one.append(char)
            forms.append(form)
        elif any(c.isascii() and c.isalnum() or c in ' ./_-' for c in form):
            longer[char] = form
    marks: dict[str, list[str]] = {}
    for mark in map(chr, range(0x300, 0x370)):
        bases = "".join(c for c in map(chr, range(65, 123)) if c.isalpha() and len(unicodedata.normalize("NFKC", c + mark)) == 1)
        if bases:
            marks.setdefault(bases, []).append(mark)
    pairs = "|".join(f"[{bases}][{''.join(found)}]" for bases, found in marks.items())
    return "".join(one), "".join(forms), longer, pairs


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def nfkc(text: Column) -> Column:
    """NFKC as far as ASCII letters, digits and separators in the outcome go; other characters keep or take their one-character form. Null stays null."""
    one, forms, longer, pairs = _compatibility()
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    expanded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    wide = F.when(text.rlike("[" + "".join(sorted(longer)) + "]"), expanded).otherwise(text)
    composed = F.regexp_replace(F.translate(wide, one, forms), pairs, "é")
    return F.when(text.rlike(r"[^\x00-\x7f]"), composed).otherwise(text)


def tokens(name: Column) -> Column:
    """SF2: NFKC, camel humps and separators split, lower case, no empty tokens."""
    split = F.split(F.regexp_replace(nfkc(name), "(?<=[a-z0-9])(?=[A-Z])", " "), rf"[{SPACE}_\-./]+")
    return F.transform(F.filter(split, lambda t: t != ""), F.lower)


def singular(token: Column) -> Column:
    """SF3: irregular forms, then ies, ses and s endings in this order."""
    table = F.from_json(F.lit(json.dumps(IRREGULAR)), "map<string,string>")
    size = F.length(token)
    return (
        F.when(F.map_contains_key(table, token), F.try_element_at(table, token))
        .when(token.endswith("ies") & (size > 4), F.concat(token.substr(F.lit(1), size - 3), F.lit("y")))
        .when(token.endswith("ses") & (size > 4), token.substr(F.lit(1), size - 2))
        .when(token.endswith("s") & ~token.endswith("ss") & (size > 3), token.substr(F.lit(1), size - 1))
        .otherwise(token)
    )


def canon(name: Column) -> Column:
    """SF1: the name's tokens, the last one in the singular, joined, without anything but a-z and 0-9. Null stays null; a name without such characters gives ''."""

    def joined(parts: Column) -> Column:
        last = let(F.element_at(parts, -1), singular)
        return F.when(F.size(parts) > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ""), last)).otherwise(F.lit(""))

    return F.when(name.isNotNull(), F.regexp_replace(let(tokens(name), joined), "[^a-z0-9]", ""))


def multiplicity(card: Column) -> Column:
    """SF4: 'many' for the many-side spellings, 'one' for anything else."""
    return F.when(F.lower(F.replace(F.trim(card), F.lit(" "), F.lit(""))).isin(*MANY), "many").otherwise("one")


def relation_class(parent: Column, child: Column) -> Column:
    """SF5: class of a relationship from parents per child and children per parent."""
    return (
        F.when((parent == "one") & (child == "many"), "1:N")
        .when((parent == "one") & (child == "one"), "1:1")
        .when((parent == "many") & (child == "many"), "M:N")
        .otherwise("N:1")
    )


def entity_name(column: Column) -> Column:
    """SF13: a column's name as an entity's: generic tokens dropped, the rest capitalized; all tokens if nothing else is left."""
    parts = F.filter(F.split(column, r"(?U)[_\W]+"), lambda t: t != "")
    own = F.filter(parts, lambda t: ~F.lower(t).isin(*GENERIC_TOKENS))
    chosen = F.when(F.size(own) > 0, own).otherwise(parts)
    return F.array_join(F.transform(chosen, lambda t: F.concat(F.upper(t.substr(1, 1)), F.lower(t.substr(F.lit(2), F.length(t))))), "")


def header(column: Column, position: Column, mode: str) -> Column:
    """SF14: a column's header as it is, by position (from 1), or as a code from its digest."""
    if mode == "meaningful":
        return column
    if mode == "none":
        return F.concat(F.lit("c"), position.cast("string"))
    return F.concat(F.lit("C_"), F.upper(F.substring(F.sha2(column, 256), 1, 6)))


def temperature_tag(temperature: Column) -> Column:
    """SF19: two digits of ten times the temperature."""
    return F.lpad(F.round(temperature * 10).cast("int").cast("string"), 2, "0")


def run_id(dataset: Column, model: Column, cond: Column, temperature: Column, replicate: Column) -> Column:
    """SF21: the identifier of a run."""
    tags = (F.concat(F.lit("t"), temperature_tag(temperature)), F.concat(F.lit("r"), replicate.cast("string")))
    return F.concat_ws("__", dataset, model, cond, *tags)


def unordered_pair(a: Column, b: Column) -> Column:
    """SF29: the pair without its order; one element if both are the same."""
    return F.array_sort(F.array_distinct(F.array(a, b)))
