"""Text normalisation, stable ids and search predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curveframe.functions.numeric import column

# Spellings of an absent text cell.
EMPTY_TEXTS = ("", "nan", "none")


def slug(text: str | Column, fallback: str = "item") -> Column:
    """Lower-case, runs of other characters become one dash, none at the ends."""
    dashed = F.regexp_replace(F.lower(column(text)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit(fallback))


def column_slug(text: str | Column) -> Column:
    return F.replace(slug(text), F.lit("-"), F.lit("_"))


def strip(text: str | Column) -> Column:
    """Remove white space (not only blanks) at both ends."""
    return F.regexp_replace(column(text), r"^\s+|\s+$", "")


def squish(text: str | Column) -> Column:
    return F.btrim(F.regexp_replace(column(text), r"\s+", " "))


def non_empty(text: str | Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def first_text(*candidates: str | Column) -> Column:
    """First candidate with visible text; give a literal last for a default."""
    return F.coalesce(*[non_empty(item) for item in candidates])


def is_empty_text(text: str | Column) -> Column:
    text = column(text)
    return text.isNull() | F.lower(strip(text)).isin(*EMPTY_TEXTS)


def channel_id(position: str | Column, mnemonic: str | Column, prefix: Column | None = None) -> Column:
    """``curve-<position>-<slug>``, with the dataset id in the middle when given."""
    parts = [F.lit("curve")]
    if prefix is not None:
        parts.append(prefix)
    return F.concat_ws("-", *parts, column(position).cast("string"), slug(mnemonic))


def document_id(path: str | Column) -> Column:
    """Reproducible document key: a rerun over the same folder gives the same ids."""
    return F.left(F.sha2(column(path), 256), F.lit(32))


def file_name(path: str | Column) -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(column(path), "/"), -1), F.lit("+"), F.lit("%2B")))


def file_stem(name: str | Column) -> Column:
    return F.regexp_replace(column(name), r"(?<=.)\.[^.]*$", "")


def suffix(name: str | Column) -> Column:
    """Lower-case file suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(column(name), r"[^/](\.[^./]*)$", 1))


def _holds_pieces(text: Column, pieces: list[str]) -> Column:
    """Whether the pieces occur one after the other, without overlap."""
    if len(pieces) == 1:
        return F.contains(text, F.lit(pieces[0]))
    found = F.position(F.lit(pieces[0]), text)
    for before, piece in zip(pieces, pieces[1:], strict=False):
        found = F.when(found > 0, F.position(F.lit(piece), text, found + len(before))).otherwise(0)
    return found > 0


def like_anywhere(term: str, *fields: str | Column) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the term stay wildcards.

    Literal pieces between ``%`` are looked up one after the other, which stays
    linear on long texts. Only ``_`` needs LIKE; a backslash is no escape here,
    hence it is doubled.
    """
    pieces = [piece for piece in term.lower().split("%") if piece]
    match = F.lit(False)
    for field in fields:
        if "_" in term:
            hit = column(field).ilike("%" + term.replace("\\", "\\\\") + "%")
        elif pieces:
            hit = _holds_pieces(F.lower(column(field)), pieces)
        else:
            hit = column(field).isNotNull()
        match = match | F.coalesce(hit, F.lit(False))
    return match


def contains_words(term: str, *fields: str | Column) -> Column:
    """Literal case-insensitive substring of the fields joined by blanks."""
    haystack = F.lower(F.concat_ws(" ", *[column(field) for field in fields]))
    return F.contains(haystack, F.lower(F.btrim(F.lit(term))))


