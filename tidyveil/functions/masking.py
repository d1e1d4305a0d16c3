"""Value-by-value privacy expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyveil.errors import StepError

_SHA2_BITS = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}


def mask_text(text: Column, mask_char: str, show_last: int) -> Column:
    """All but the last ``show_last`` characters hidden; short values, and 0, hide everything."""
    size = F.char_length(text)
    if show_last <= 0:
        return F.repeat(F.lit(mask_char), size)
    return F.when(size <= show_last, F.repeat(F.lit(mask_char), size)).otherwise(
        F.concat(F.repeat(F.lit(mask_char), size - show_last), F.right(text, F.lit(show_last)))
    )


def hash_text(text: Column, algorithm: str, salt: Column | None) -> Column:
    salted = text if salt is None else F.concat(salt, text)
    name = algorithm.lower().replace("-", "")
    if name in _SHA2_BITS:
        return F.sha2(salted, _SHA2_BITS[name])
    if name == "md5":
        return F.md5(salted)
    if name == "sha1":
        return F.sha1(salted)
    raise StepError(f"hash algorithm {algorithm!r} is not available; use md5, sha1 or sha224/256/384/512")
