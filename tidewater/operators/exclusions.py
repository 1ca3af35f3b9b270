"""Row exclusion rules: their JSON form, their validation, and filters made of them."""

from __future__ import annotations

import base64
import binascii
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators import scans

# What is always left out, and the prefixes of short-lived options.
DEFAULT_RULE = {"table_name_without_prefix": "postmeta", "column": "meta_key", "value_base64": "X2VkaXRfbG9jaw=="}
TRANSIENT = ("_transient", "_site_transient")


def checked(rule: Mapping[str, str]) -> tuple[str | None, str | None, str, str]:
    """(table, bare table, column, value) of a rule; exactly one of the tables, and strict base64."""
    if not isinstance(rule.get("column"), str) or not rule["column"] or not isinstance(rule.get("value_base64"), str):
        raise ValueError("a rule needs column and value_base64")
    if ("table" in rule) == ("table_name_without_prefix" in rule):
        raise ValueError("a rule names either table or table_name_without_prefix")
    try:
        value = base64.b64decode(rule["value_base64"], validate=True).decode()
    except (binascii.Error, ValueError) as e:
        raise ValueError("value_base64 is not base64 of text") from e
    return rule.get("table"), rule.get("table_name_without_prefix"), rule["column"], value


def apply_rules(df: DataFrame, table: str, rules: Sequence[Mapping[str, str]], prefix: str = "wp_") -> DataFrame:
    """Drop the rows of ``table`` that a rule names; nulls stay."""
    for full, bare, column, value in map(checked, [DEFAULT_RULE, *rules]):
        if table == (full if full is not None else prefix + bare):
            df = scans.exclude(df, column, value)
    return df


def lasting(option_name: Column) -> Column:
    """True for options that are no transients; null names last."""
    out = F.lit(True)
    for p in TRANSIENT:
        out = out & ~F.coalesce(F.startswith(option_name, F.lit(p)), F.lit(False))
    return out
