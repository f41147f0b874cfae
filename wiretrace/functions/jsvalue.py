"""JavaScript value rules on VARIANT columns, as built-in column expressions.

A captured parameter is dynamically typed. SQL NULL stands for "undefined" (the
key is absent); a JSON ``null`` is a VARIANT of type VOID.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

# What a JavaScript Number() accepts in a decimal string.
_DECIMAL_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NUMBER_TYPES = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


class Members(NamedTuple):
    """Members of an object, taken from its VARIANT at once: the name of a struct of VARIANTs. The
    functions below that take a member by its key take it from here as well."""

    column: str


def field(value: Column | Members, key: str) -> Column:
    """Member ``key`` of an object VARIANT, NULL when absent."""
    if isinstance(value, Members):
        return F.col(f"{value.column}.{key}")
    return F.try_variant_get(value, "$." + key if key.isidentifier() else f"$['{key}']", "variant")


def _type_text(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    kind = F.substring_index(_type_text(value), "(", 1)
    return F.coalesce(kind.isin(*_NUMBER_TYPES), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(_type_text(value) == "STRING", F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(_type_text(value).startswith("ARRAY"), F.lit(False))


def is_object(value: Column) -> Column:
    """``typeof value === 'object'`` and not null: objects and arrays alike."""
    return is_map(value) | F.try_variant_get(value, "$", "array<variant>").isNotNull()


def is_map(value: Column) -> Column:
    """An object that is not an array. Its members are not looked at, as its schema would have it."""
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def raw_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def raw_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_number(value: Column) -> Column:
    """The number, or NULL when the value is of another type."""
    return F.when(is_number(value), raw_double(value))


def as_string(value: Column) -> Column:
    """The string, or NULL when the value is of another type."""
    return F.when(is_string(value), raw_string(value))


def as_int(value: Column) -> Column:
    """The number truncated towards zero, or NULL."""
    return as_number(value).try_cast("bigint")


def as_elements(value: Column) -> Column:
    """``array<variant>``, or NULL when the value is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def text_to_number(text: Column) -> Column:
    """``text - 0``: blank is 0, non-numeric text is NULL."""
    trimmed = F.trim(text)
    return F.when(trimmed == "", F.lit(0.0)).when(trimmed.rlike(_DECIMAL_TEXT), trimmed.try_cast("double"))


def to_number(value: Column) -> Column:
    """``value - 0`` for a VARIANT; NULL where JavaScript gives NaN."""
    kind = _type_text(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(is_number(value), raw_double(value))
        .when(kind == "STRING", text_to_number(raw_string(value)))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(kind == "VOID", F.lit(0.0))
    )


def number_text(number: Column) -> Column:
    """Decimal text of a double: whole numbers without a fraction, no exponent for
    magnitudes from 1e-6 to 1e20."""
    size = F.abs(number)
    whole = (number == F.floor(number)) & (size < 9.0e15)
    plain = F.regexp_replace(number.try_cast("decimal(38,17)").cast("string"), r"\.?0+$", "")
    return (
        F.when(whole, number.try_cast("bigint").cast("string"))
        .when((size >= 1.0e-6) & (size < 1.0e20), plain)
        .otherwise(number.cast("string"))
    )


def _plain(value: Column) -> Column:
    """Strings, booleans and exact numbers: their text is what the VARIANT casts to."""
    return F.substring(_type_text(value), 1, 2).isin("ST", "BI", "BO", "DE")


def _scalar_text(value: Column) -> Column:
    # the usual kinds come first, so that most values are looked up once
    return (
        F.when(_plain(value), raw_string(value))
        .when(value.isNull(), F.lit(None).cast("string"))
        .when(_type_text(value) == "VOID", F.lit("null"))
        .when(is_number(value), number_text(raw_double(value)))
        .when(is_map(value), F.lit("[object Object]"))
    )


def _array_text(items: Column, inner) -> Column:
    # null elements print as the empty string inside a joined array
    return F.array_join(F.transform(items, lambda item: F.when(~F.is_variant_null(item), inner(item))), ",", "")


def to_text(value: Column) -> Column:
    """``String(value)``; NULL for undefined. An array inside an array prints as JSON."""
    inner = lambda item: F.coalesce(_scalar_text(item), F.to_json(item))
    listed = _array_text(F.try_variant_get(value, "$", "array<variant>"), inner)
    return F.when(_plain(value), raw_string(value)).when(is_array(value), listed).otherwise(_scalar_text(value))


def element_texts(value: Column) -> Column:
    """``array<string>`` of ``String(element)``, NULL when the value is no array."""
    return F.transform(as_elements(value), lambda item: to_text(item))


def truthy(value: Column) -> Column:
    """``!!value``: false for undefined, null, false, 0 and the empty string."""
    kind = _type_text(value)
    return F.coalesce(
        F.when(value.isNull(), F.lit(False))
        .when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", raw_string(value) != "")
        .when(is_number(value), raw_double(value) != 0.0)
        .when(value.isNotNull(), F.lit(True)),
        F.lit(False),
    )


# --- the getters the state tables are built from -------------------------------


def text_or_blank(value: Column | Members, key: str) -> Column:
    """String member, "" when absent or of another type."""
    return F.coalesce(as_string(field(value, key)), F.lit(""))


def shown(value: Column | Members, key: str) -> Column:
    """Any member as text, "" when absent."""
    return F.coalesce(to_text(field(value, key)), F.lit(""))


def joined(value: Column | Members, key: str) -> Column:
    """Array member as ", "-joined text, "" when it is no array."""
    return F.coalesce(F.array_join(element_texts(field(value, key)), ", ", "undefined"), F.lit(""))


def parsed(json_text: Column, name: str) -> Column:
    """Generator column: ``json_text`` parsed as VARIANT ``name``, NULL if malformed.

    A one-row generator, because the optimizer would copy a plain expression into
    every filter on a member of the value.
    """
    return F.inline(F.array(F.struct(F.try_parse_json(json_text).alias(name))))
