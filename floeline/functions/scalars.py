"""Scalar functions of the state engine, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first byte of a sealed payload; nonce (12 bytes), ciphertext and tag (16 bytes) follow.
SEAL_VERSION = "01"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def backoff_ns(attempt: Column | str, base: int = 500_000_000, factor: float = 2.0, most: int = 30_000_000_000) -> Column:
    """Delay before the next try: ``base * factor ** (attempt - 1)``, cut to whole nanoseconds at each step, at most ``most``."""
    steps = F.sequence(F.lit(1), F.greatest(_col(attempt).cast("int") - 1, F.lit(1)))
    grown = F.aggregate(steps, F.lit(base).cast("long"), lambda d, _: F.least(F.floor(d * F.lit(factor)).cast("long"), F.lit(most).cast("long")))
    return F.when(_col(attempt) <= 1, F.lit(min(base, most)).cast("long")).otherwise(grown)


def seal(payload: Column | str, key: bytes) -> Column:
    """AES-256-GCM: version byte, random nonce, ciphertext and tag."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    return F.concat(F.unhex(F.lit(SEAL_VERSION)), F.aes_encrypt(_col(payload).cast("binary"), F.lit(bytearray(key)), F.lit("GCM")))


def unseal(sealed: Column | str, key: bytes) -> Column:
    """The payload as text; null where the version differs or the tag does not fit."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    body = F.try_aes_decrypt(F.substring(_col(sealed), 2, 2**31 - 1), F.lit(bytearray(key)), F.lit("GCM"))
    return F.when(F.hex(F.substring(_col(sealed), 1, 1)) == SEAL_VERSION, body.cast("string"))


def short_label(text: Column | str, most: int) -> Column:
    """The text, or its first ``most - 1`` characters and an ellipsis."""
    c = _col(text)
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def labels_match(required: Column | str, offered: list[str]) -> Column:
    """Whether a worker that offers the labels may take a step that requires these (comma separated; none: any worker)."""
    wanted = F.filter(F.split(_col(required), ","), lambda x: x != "")
    return F.size(F.array_except(wanted, F.array(*[F.lit(x) for x in offered]).cast("array<string>"))) == 0
