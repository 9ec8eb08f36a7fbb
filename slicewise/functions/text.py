"""Scalar functions on image bytes and artifact text; all are plain Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ANCHOR_DOMAIN, ANCHOR_LOCAL, address_class, default_tlds


#: bytes shown on either side of a match
CONTEXT = 16


def sql_literal(text: str) -> str:
    """A raw SQL string literal; the patterns of this package hold no single quote."""
    if "'" in text:
        raise ValueError("pattern must not contain a single quote")
    return f"r'{text}'"


def bind(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` bound to `value`, so that `value` is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def latin1(data: Column) -> Column:
    """Bytes as text, one character per byte."""
    return F.decode(data, "ISO-8859-1")


def latin1_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def escape(text: Column) -> Column:
    r"""Printable ASCII stays, any other byte and the backslash become \xHH."""
    escaped = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c: F.when(c.rlike(r"^[ -\[\]-~]$"), c).otherwise(
                F.concat(F.lit("\\x"), F.hex(latin1_bytes(c)))
            ),
        ),
        "",
    )
    return F.when(text.rlike(r"\A[ -\[\]-~]*\z"), text).otherwise(escaped)


def context(data: Column, position: Column, length: Column, pad: int = CONTEXT) -> Column:
    """Latin-1 text of a match with up to `pad` bytes on either side, cut at the buffer ends."""
    start = F.greatest(position - pad, F.lit(0).cast("long"))
    stop = F.least(position + length + pad, F.length(data).cast("long"))
    return latin1(F.substring(data, (start + 1).cast("int"), (stop - start).cast("int")))


def narrow16(text: Column) -> Column:
    """UTF-16LE text of Latin-1 characters as 8-bit text."""
    return F.translate(text, "\x00", "")


def tld_ok(address: Column, tlds: Iterable[str] | None = None) -> Column:
    """Whether the text after the last dot is a known top-level domain."""
    names = [n.upper() for n in tlds] if tlds is not None else list(default_tlds())
    return address.contains(".") & F.upper(F.substring_index(address, ".", -1)).isin(names)


def addr_ok(local: Column, domain: Column, allow_space: bool = False) -> Column:
    """Whether both parts hold valid bytes only and keep to the length limits."""
    valid = address_class(allow_space)
    return (
        local.rlike(rf"\A{valid}+\z")
        & domain.rlike(rf"\A{valid}+\z")
        & (F.length(local) <= ANCHOR_LOCAL)
        & (F.length(domain) <= ANCHOR_DOMAIN)
    )


def abs_offset(start: Column, position: Column) -> Column:
    return start + position


def child_path(parent: Column, artifact_class: Column, offset: Column) -> Column:
    """Forensic path of a buffer decoded out of `parent` at `offset`."""
    return F.concat(parent, F.lit("-"), F.upper(artifact_class), F.lit("-"), offset.cast("string"))
