"""Tokens, hash embeddings and vector arithmetic as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[a-z0-9]+(?:'[a-z]+)?"


def tokens(c: Column) -> Column:
    """Lower-case ASCII words, with an apostrophe part."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def hash_slot(token: Column, dim: int = 768) -> Column:
    """MD5 of the token as a number, modulo dim: folded over its eight-digit limbs."""
    digest = F.md5(token)
    shift = (1 << 32) % dim
    out = F.lit(0).cast("bigint")
    for k in range(4):
        limb = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
        out = F.pmod(out * shift + limb, F.lit(dim))
    return out.cast("int")


def hash_sign(token: Column) -> Column:
    """+1 or -1 from bit 16 of the token's MD5."""
    nibble = F.conv(F.substring(F.md5(token), 28, 1), 16, 10).cast("int")
    return F.when(nibble.bitwiseAND(1) == 1, 1.0).otherwise(-1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one is empty, lengths differ or a norm is next to nothing."""
    na, nb = norm(a), norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na >= 1e-12) & (nb >= 1e-12)
    return F.coalesce(F.when(usable, dot(a, b) / (na * nb)), F.lit(0.0))


def char_windows(c: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each beginning ``overlap`` before the end of the last; blank ones dropped."""
    step = max(size - overlap, 1)
    last = F.greatest(F.ceil((F.length(c) - size) / F.lit(step)), F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))
    return F.filter(cut, lambda w: w.rlike(r"\S"))


def clip(c: Column, size: int) -> Column:
    """The first characters, followed by three dots where there are more."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def percent(c: Column) -> Column:
    """A share as whole percent, halves to the even number."""
    return F.concat(F.bround(c * 100, 0).cast("bigint").cast("string"), F.lit("%"))
