"""Label extraction and canonical forms, aliases, buckets and CASE rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalumen.functions.jsontext import object_keys, strict_json
from catalumen.functions.text import squeeze_spaces, strip_ends

# Fixed values.
SPLIT_ALIASES = {"train": "train", "val": "validation", "dev": "validation",
                 "validation": "validation", "test": "test"}
SUPPORT_BUCKETS = ((0, "0"), (5, "1-5"), (10, "6-10"), (25, "11-25"), (50, "26-50"),
                   (100, "51-100"), (500, "101-500"))
SUPPORT_BUCKET_ABOVE = "501+"


def fold_label(label: Column) -> Column:
    return F.lower(squeeze_spaces(label))


def first_value(items: Column) -> Column:
    """First non-empty string of an ``array<struct<value>>`` column."""
    trimmed = F.transform(items, lambda item: strip_ends(item["value"]))
    return F.try_element_at(F.filter(trimmed, lambda v: v.isNotNull() & (v != "")), F.lit(1))


def _variant_kind(variant: Column) -> Column:
    """Schema text of a variant value: ``ARRAY<...>``, ``OBJECT<...>``, ``STRING`` ..."""
    return F.schema_of_variant(variant)


def strict_label(raw: Column) -> Column:
    """Exactly ``[{"value": text}]``: the stripped text, and how it was judged."""
    raw = strict_json(raw)
    parsed = F.try_parse_json(raw)
    item = F.try_variant_get(parsed, "$[0]", "variant")
    inner = F.try_variant_get(parsed, "$[0].value", "variant")
    text = strip_ends(F.try_variant_get(parsed, "$[0].value", "string"))
    keys = F.json_object_keys(F.get_json_object(raw, "$[0]"))
    method = (
        F.when(parsed.isNull() | ~_variant_kind(parsed).startswith("ARRAY"), "not_list")
        .when(F.json_array_length(raw) != 1, "list_length_not_one")
        .when(~F.coalesce(_variant_kind(item).startswith("OBJECT"), F.lit(False)), "list_item_not_dict")
        .when(~F.coalesce(keys == F.array(F.lit("value")), F.lit(False)), "unexpected_dict_keys")
        .when(F.coalesce(_variant_kind(inner), F.lit("VOID")) != "STRING", "value_not_string")
        .when(text == "", "empty_value")
        .otherwise("list_dict_value")
    )
    return F.struct(F.when(method == "list_dict_value", text).alias("value"), method.alias("method"))


def presence_kind(raw_object: Column, key: str) -> Column:
    """Absent, null and unparseable are three different findings."""
    keys = object_keys(raw_object)
    value = F.try_variant_get(F.try_parse_json(raw_object), f"$.{key}", "variant")
    return (
        F.when(keys.isNull(), "unparseable")
        .when(~F.array_contains(keys, key), "absent")
        .when(F.coalesce(F.is_variant_null(value), F.lit(True)), "null")
        .otherwise("present")
    )


def lenient_label(raw: Column) -> Column:
    """Also accepts an object, a JSON string holding either, or a plain text."""
    outer = F.try_parse_json(strict_json(raw))
    # A JSON string may itself hold a list or an object: look one level deeper.
    text = F.coalesce(
        F.when(F.coalesce(_variant_kind(outer), F.lit("")) == "STRING",
               F.try_variant_get(outer, "$", "string")),
        F.when(outer.isNull(), raw),
    )
    body = strip_ends(text)
    nested_text = F.when(body.rlike(r"(?s)^\[.*\]$") | body.rlike(r"(?s)^\{.*\}$"), body)
    nested = F.try_parse_json(strict_json(nested_text))
    document = F.coalesce(nested, F.when(text.isNull(), outer))
    document_text = F.when(nested.isNotNull(), nested_text).otherwise(raw)
    kind = F.coalesce(_variant_kind(document), F.lit(""))
    from_list = F.when(
        kind.startswith("ARRAY") & (F.json_array_length(document_text) == 1),
        _text_at(document, "$[0].value"),
    )
    from_object = F.when(kind.startswith("OBJECT"), _text_at(document, "$.value"))
    from_text = F.when(nested.isNull(), body)
    return F.nullif(F.coalesce(from_list, from_object, from_text), F.lit(""))


def _text_at(document: Column, path: str) -> Column:
    value = F.try_variant_get(document, path, "variant")
    return F.when(
        F.coalesce(_variant_kind(value), F.lit("")) == "STRING",
        strip_ends(F.try_variant_get(document, path, "string")),
    )


def split_name(value: Column) -> Column:
    """Canonical split name, null for an unknown one."""
    aliases = F.create_map(*[F.lit(x) for pair in SPLIT_ALIASES.items() for x in pair])
    return F.try_element_at(aliases, value)


def support_bucket(n: Column) -> Column:
    result = None
    for upper, name in SUPPORT_BUCKETS:
        result = F.when(n <= upper, name) if result is None else result.when(n <= upper, name)
    return result.otherwise(SUPPORT_BUCKET_ABOVE)


def supervision_type(has_category: Column, has_attributes: Column, has_information: Column) -> Column:
    return (
        F.when(has_category & has_attributes, "category_and_attributes")
        .when(has_category, "category_only")
        .when(has_attributes, "attributes_only")
        .when(has_information, "information_only")
        .otherwise("none")
    )


def missing_fields(raw_object: Column, required: list[str]) -> Column:
    """Required keys an object lacks; null when the text is not a JSON object."""
    return F.array_except(F.array(*[F.lit(x) for x in required]), object_keys(raw_object))
