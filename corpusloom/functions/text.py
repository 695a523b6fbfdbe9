"""Column functions on text. Lengths are in code points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of one estimated token, and the end of a sentence.
CHARS_PER_TOKEN = 4
SENTENCE_END = r"(?U)(?<=[.;:])\s+|\n{2,}"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_page(text: Column, footers: Sequence[str] = ()) -> Column:
    """Footers removed in order, words joined over hyphenated line breaks, runs of blank lines cut to one, ends stripped."""
    for pattern in footers:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(text, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END, -1), strip), lambda s: s != "")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, " > ", -1)


def path_of(*parts: Column) -> Column:
    """Null parts are left out, empty ones stay."""
    return F.concat_ws(" > ", *parts)


def captured_int(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def first_filled(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def first_class(text: Column, classes: Mapping[str, Sequence[str]], other: str | None = None) -> Column:
    """The first class of which a keyword occurs in the lower-cased text."""
    low, out = F.lower(text), None
    for name, words in classes.items():
        hit = any_of(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if other is None else out.otherwise(other)


def any_of(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w.lower()))
    return hit


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A template with {name} fields and doubled braces for plain ones. Fields are filled from the pieces between them, so braces in values stay as they are."""
    import re

    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece[:1] == "{":
            parts.append(values[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def json_payload(reply: Column) -> Column:
    """The JSON text in a model's reply: thoughts dropped, then a fenced object, else the widest braces, else all of it."""
    bare = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return first_filled(fenced, F.regexp_extract(bare, r"(?s)\{.*\}", 0), strip(bare))


def namespaced(doc: Column, own_doc: Column, chunk_id: Column) -> Column:
    return F.concat_ws("_", F.coalesce(own_doc, doc), chunk_id.cast("string"))


def shown(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def label_of(key: Column, labels: Mapping[str, str], default: str | None = None) -> Column:
    """The label of a key; ``default`` for others, which are an error without one."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    other = F.lit(default) if default is not None else F.raise_error(F.concat(F.lit("no label for "), F.coalesce(key, F.lit("null")))).cast("string")
    return F.when(F.map_contains_key(known, key), F.element_at(known, key)).otherwise(other)
