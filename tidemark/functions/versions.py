"""Version texts as exact numbers, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import messages as M
from tidemark.schemas import VERSION_TYPE

DEFAULT_BASE = 10000
# Base the publish path uses for the same texts.
PUBLISH_BASE = 1000
# Fixed value: digits one item may have.
ITEM_DIGITS = 18
ITEM_PATTERN = r"^ *[+-]?[0-9]+ *$"


def items_of(text: Column, delimiter: str = ".") -> Column:
    """Items between one-character delimiters; empty items are kept."""
    if len(delimiter) != 1:
        raise ValueError("the delimiter is exactly one character")
    return F.split(text, rf"\Q{delimiter}\E", -1)


def _padded(items: Column, pad_to: int | None) -> Column:
    if pad_to is None:
        return items
    short = F.greatest(F.lit(pad_to) - F.size(items), F.lit(0))
    return F.concat(items, F.array_repeat(F.lit("0"), short))


def _is_number(item: Column) -> Column:
    return item.rlike(ITEM_PATTERN)


def _digits(item: Column) -> Column:
    """Significant digits of a well-formed item."""
    return F.length(F.regexp_replace(F.trim(item), r"^[+-]?0*", ""))


def version_number(text: Column, weight_base: int = DEFAULT_BASE, pad_to: int | None = None) -> Column:
    """Fold `a.b.c` into ((a * base) + b) * base + c; bad text raises at run time."""
    base = F.lit(weight_base).cast(VERSION_TYPE)
    items = _padded(items_of(text), pad_to)

    def weigh(total: Column, item: Column) -> Column:
        value = F.when(_is_number(item), item.cast(f"decimal({ITEM_DIGITS},0)")).otherwise(
            F.raise_error(M.parse_error(text, F.lit(M.BAD_NUMBER)))
        )
        return (total * base + value).cast(VERSION_TYPE)

    folded = F.aggregate(items, F.lit(0).cast(VERSION_TYPE), weigh)
    return F.when(
        text.isNull(), F.raise_error(M.parse_error(text, F.lit(M.null_argument("version_text"))))
    ).otherwise(folded)


def version_number_or_null(text: Column, weight_base: int = DEFAULT_BASE, pad_to: int | None = None) -> Column:
    """Same fold; NULL when any item is bad or the sum does not fit."""
    base = F.lit(weight_base).cast(VERSION_TYPE)

    def weigh(total: Column, item: Column) -> Column:
        value = F.when(_is_number(item), item.try_cast(f"decimal({ITEM_DIGITS},0)"))
        return F.try_add(F.try_multiply(total, base), value).try_cast(VERSION_TYPE)

    return F.aggregate(_padded(items_of(text), pad_to), F.lit(0).cast(VERSION_TYPE), weigh)


def version_error(text: Column, weight_base: int = DEFAULT_BASE, pad_to: int | None = None) -> Column:
    """The message strict parsing would raise, NULL for good text."""
    items = items_of(text)
    reason = (
        F.when(text.isNull(), F.lit(M.null_argument("version_text")))
        .when(F.exists(items, lambda i: ~_is_number(i)), F.lit(M.BAD_NUMBER))
        .when(F.exists(items, lambda i: _digits(i) > ITEM_DIGITS), F.lit(M.TOO_LONG_NUMBER))
        .when(version_number_or_null(text, weight_base, pad_to).isNull(), F.lit(M.TOO_LARGE_SUM))
    )
    return F.when(reason.isNotNull(), M.parse_error(text, reason))


def version_warning(text: Column, weight_base: int = DEFAULT_BASE) -> Column:
    """Names an item that reaches the base and so carries into the one before it."""
    limit = F.lit(weight_base)
    rest = F.slice(items_of(text), 2, F.greatest(F.size(items_of(text)) - 1, F.lit(0)))
    carries = F.exists(rest, lambda i: i.try_cast(f"decimal({ITEM_DIGITS},0)") >= limit)
    return F.when(
        carries, F.concat(F.lit("item of "), text, F.lit(f" reaches the weight base {weight_base}"))
    )
