"""Digests of data blocks and key shards."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: block width in bytes; file systems align to sectors of this size
BLOCK = 512
#: bytes of one image per row key of media_to_block
SHARD_BYTES = 10**9


def block_md5(block: Column) -> Column:
    return F.upper(F.md5(block))


def zero_block_md5(size: int = BLOCK) -> str:
    return hashlib.md5(bytes(size)).hexdigest().upper()


def not_zero_block(digest: Column, size: int = BLOCK) -> Column:
    return digest != F.lit(zero_block_md5(size))


def shard(offset: Column, k: int = SHARD_BYTES) -> Column:
    """Number of the k-byte range an offset lies in."""
    return F.call_function("div", offset, F.lit(k).cast("long"))
