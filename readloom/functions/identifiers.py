"""Identifiers from SHA-256 digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IDENTIFIER_LENGTH, PATH_DIGITS, PATH_PREFIX


def _length(n: int | None) -> int:
    if n is not None and n <= 0:
        raise ValueError("an identifier needs at least one character")
    return IDENTIFIER_LENGTH if n is None else n


def numeric_identifier(text: Column, n: int | None = None) -> Column:
    """The digest's bytes as three decimal digits each, cut to ``n`` characters (64 by default)."""
    n = _length(n)
    digest = F.sha2(text, 256)
    need = min(32, -(-n // 3))
    byte = lambda i: F.lpad(F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10), 3, "0")
    return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(need - 1)), byte), ""), 1, n)


def hash_identifier(text: Column, n: int | None = None) -> Column:
    """The hexadecimal digest cut to ``n`` characters; a leading digit becomes ``a``."""
    return F.regexp_replace(F.substring(F.sha2(text, 256), 1, _length(n)), "^[0-9]", "a")


def path_identifier(nodes: Column) -> Column:
    """The identifier of a path: of its node ids joined by ``-``. Equal node lists in two graphs share it."""
    return F.concat(F.lit(PATH_PREFIX), numeric_identifier(F.array_join(nodes, "-"), PATH_DIGITS))
