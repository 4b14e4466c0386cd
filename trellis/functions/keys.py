"""The identity of an edge as one string, and plain names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument


def edge_key(source: Column, kind: Column, target: Column) -> Column:
    """Length-prefixed source, type and target ("3:ada7:FOLLOWS3:bob"), lengths in bytes: no
    two edges share a key, and keys give the order in which edges are visited."""
    parts = [p for c in (source, kind, target) for p in (F.octet_length(c).cast("string"), F.lit(":"), c)]
    return F.concat(*parts)


def identifier(name: str) -> str:
    """name, if it is a letter or _ and then letters, digits and _, at most 1024 of them."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,1023}", name):
        raise InvalidArgument(f"{name!r} is not an identifier")
    return name
