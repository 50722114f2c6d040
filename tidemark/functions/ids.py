"""Entity ids: parse, format, order. Every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import MAX_ENTITY_NUM, by_type


def parse_id(type_col: Column, id_col: Column) -> Column:
    """Number of an id such as Q42, or null when the prefix or the number is wrong.

    Leading zeros are accepted, a sign is not, and the number must fit 32 unsigned bits.
    """
    digits = F.substring(id_col, 2, 2147483647)
    number = digits.try_cast("bigint")
    well_formed = (F.substring(id_col, 1, 1) == by_type(type_col, "id_prefix")) & digits.rlike(r"^[0-9]+\z")
    return F.when(well_formed & (number <= F.lit(MAX_ENTITY_NUM)), number)


def parse_title(type_col: Column, title: Column) -> Column:
    """Number of the id in a page title; the type's title prefix must be there and is removed."""
    prefix = by_type(type_col, "title_prefix")
    rest = F.substring(title, F.length(prefix) + 1, F.lit(2147483647))
    return F.when(F.startswith(title, prefix), parse_id(type_col, rest))


def format_id(type_col: Column, num: Column) -> Column:
    return F.concat(by_type(type_col, "id_prefix"), num.cast("string"))


def next_id(num: Column) -> Column:
    return num + F.lit(1).cast("bigint")


def type_order(type_col: Column) -> Column:
    """Sort key of the type: ids are ordered by type first, then by number (Q2 before Q10)."""
    return by_type(type_col, "type_ord")
