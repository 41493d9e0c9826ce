"""Whitespace normalisation, tokens, title flags, chunking, n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalumen.functions.vectors import let

# Fixed values.
# Whitespace as str.split() sees it: Unicode White_Space plus U+001C..U+001F.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
WHITESPACE_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
WORD_RUN = r"[\p{L}\p{N}_]+"
REPLACEMENT_CHARACTER = "�"
SHORT_TITLE_LENGTH = 3
CHUNK_TOKENS = 254
WINDOW_TOKENS = 256
LENGTH_LIMITS = (128, 256, 512, 1024)
CHUNK_LIMITS = (1, 2, 3, 4, 5, 8, 10, 16)


def squeeze_spaces(text: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITESPACE_RUN, " "))


def strip_ends(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE_ENDS, "")


def word_tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Non-space tokens; an empty or missing text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITESPACE_RUN), "")


def squeeze_values(items: Column) -> Column:
    """Normalise the ``value`` of each ``{language_tag, value}`` item only."""
    return F.transform(items, lambda item: item.withField("value", squeeze_spaces(item["value"])))


def joined_values(items: Column) -> Column:
    """Text of a ``{language_tag, value}`` list: its values, space-joined."""
    return F.array_join(F.transform(items, lambda item: item["value"]), " ")


def field_token_block(fields: dict[str, Column]) -> Column:
    """Per-field tokens, their concatenation in field order, count and present fields.

    Fields without a token are left out of the map and the present list.
    """
    names = list(fields)
    token_map = F.map_from_arrays(
        F.array(*[F.lit(name) for name in names]),
        F.array(*[space_tokens(fields[name]) for name in names]),
    )
    present = F.map_filter(token_map, lambda _, tokens: F.size(tokens) > 0)
    combined = F.flatten(F.map_values(present))
    return F.struct(
        present.alias("field_tokens"),
        combined.alias("combined_tokens"),
        F.size(combined).alias("token_count"),
        F.map_keys(present).alias("present_text_fields"),
    )


def title_flags(text: Column) -> Column:
    """Replacement character seen, very short, changed by normalisation, lengths."""
    squeezed = squeeze_spaces(text)
    return F.struct(
        text.contains(REPLACEMENT_CHARACTER).alias("has_replacement"),
        (F.char_length(squeezed) <= SHORT_TITLE_LENGTH).alias("is_short"),
        (squeezed != text).alias("is_changed"),
        F.char_length(text).alias("raw_chars"),
        F.char_length(squeezed).alias("clean_chars"),
    )


def chunk_count(n_tokens: Column, size: int = CHUNK_TOKENS) -> Column:
    """At least one chunk, even for a record without tokens."""
    return F.greatest(F.lit(1), F.ceil(n_tokens / F.lit(size))).cast("int")


def window_excess(n_tokens: Column, window: int = WINDOW_TOKENS) -> Column:
    return F.greatest(F.lit(0), n_tokens - F.lit(window))


def chunks(tokens: Column, size: int = CHUNK_TOKENS) -> Column:
    """Consecutive slices of ``size`` tokens; order kept, nothing lost."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda start: F.slice(tokens, start, F.lit(size)))


def count_terms(terms: Column) -> Column:
    """``array<{term, tf}>`` of one record, counted inside its row.

    Sorting brings equal terms together; a run's length is the distance to the
    start of the next one. Nothing leaves the row, so no shuffle is needed.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1))),
            lambda i: (F.get(ordered, i - 1) != F.get(ordered, i - 2)) | (i == 1))
        return let(starts, lambda at: F.transform(at, lambda p, k: F.struct(
            F.get(ordered, p - 1).alias("term"),
            (F.coalesce(F.get(at, k + 1), F.size(ordered) + 1) - p).cast("long").alias("tf"))))

    return F.when(F.size(terms) > 0, let(F.sort_array(terms), runs))


def bigrams(tokens: Column) -> Column:
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def text_available(columns: Sequence[Column]) -> Column:
    """At least one of the columns has a non-space character."""
    checks = [F.coalesce(strip_ends(c) != "", F.lit(False)) for c in columns]
    result = checks[0]
    for check in checks[1:]:
        result = result | check
    return result
