"""Digests and tokens: expressions over the digests that Spark has; only scrypt is an Arrow-batched UDF."""

from __future__ import annotations

import base64
import hashlib
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_expiry(epoch_seconds: Column, window: int = 3600) -> Column:
    """The next full window after a time."""
    return (F.floor(epoch_seconds / window).cast("long") + 1) * window


def hmac_hex(key: bytes, algorithm: str = "sha256"):
    """Keyed digests by the definition of HMAC over the digests that Spark has: H(outer pad, H(inner pad, message))."""
    kinds = {"sha1": (64, F.sha1), "sha256": (64, lambda c: F.sha2(c, 256)), "sha512": (128, lambda c: F.sha2(c, 512))}
    if algorithm not in kinds:
        raise ValueError(f"algorithm must be one of {', '.join(kinds)}")
    size, digest = kinds[algorithm]
    key = (hashlib.new(algorithm, key).digest() if len(key) > size else key).ljust(size, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))

    def signature(message: Column | str) -> Column:
        return digest(F.concat(outer, F.unhex(digest(F.concat(inner, F.col(message).cast("binary") if isinstance(message, str) else message.cast("binary"))))))

    return signature


def scrypt_base64(salt: bytes, size: int = 64):
    @F.pandas_udf("string")
    def digest(secret: pd.Series) -> pd.Series:
        return secret.map(lambda s: None if s is None else base64.b64encode(hashlib.scrypt(s.encode(), salt=salt, n=16384, r=8, p=1, dklen=size)).decode())

    return digest


def _turned(hexed: Column) -> Column:
    """Eight hex digits, byte by byte from the back."""
    return F.concat(*[F.substring(hexed, k, 2) for k in (7, 5, 3, 1)])


def preview_token(salt: bytes):
    """First word of the SHA-1 of a salt whose first word is time ^ expiry ^ file, words being little-endian."""

    def token(time: Column, expiry: Column, file_id: Column) -> Column:
        word = F.lit(0xFFFFFFFF)
        mixed = (F.col(time) if isinstance(time, str) else time).cast("long").bitwiseAND(word)
        for x in (expiry, file_id):
            mixed = mixed.bitwiseXOR((F.col(x) if isinstance(x, str) else x).cast("long").bitwiseAND(word))
        size = F.when(mixed >= 1 << 31, F.lit(1 << 32) - mixed).otherwise(mixed)  # of a signed word
        first = F.unhex(_turned(F.lpad(F.hex(size), 8, "0")))
        return F.conv(_turned(F.sha1(F.concat(first, F.lit(salt[4:])))), 16, 10).cast("long")

    return token


def api_key(user_id: int, random: bytes) -> str:
    """Base64 of 32 bytes whose first two hold the id, letters and digits only."""
    raw = struct.pack("<H", user_id & 0xFFFF) + random[2:32]
    return "".join(c for c in base64.b64encode(raw).decode() if c.isalnum())


def token_status(expected: Column, given: Column, now: Column, expiry: Column, grace: int = 300) -> Column:
    """403 on another hash, 410 long after the expiry, else 200."""
    return F.when(expected != given, 403).when(now - expiry > grace, 410).otherwise(200)


#: Fixed value: the public scheme's default alphabet.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


class ShortIds:
    """Reversible short ids of lists of non-negative integers (the public Sqids scheme, without its word filter)."""

    def __init__(self, alphabet: str = ALPHABET):
        if len(set(alphabet)) != len(alphabet) or len(alphabet) < 3:
            raise ValueError("the alphabet needs three different characters at least")
        self.alphabet = self._mixed(alphabet)

    @staticmethod
    def salted(salt: str, alphabet: str = ALPHABET) -> ShortIds:
        """An alphabet in an order that depends on a salt."""
        return ShortIds("".join(sorted(alphabet, key=lambda c: hashlib.sha256((salt + c).encode()).digest())))

    @staticmethod
    def _mixed(alphabet: str) -> str:
        c, n = list(alphabet), len(alphabet)
        for i in range(n - 1):
            j = n - 1 - i
            r = (i * j + ord(c[i]) + ord(c[j])) % n
            c[i], c[r] = c[r], c[i]
        return "".join(c)

    def encode(self, numbers: list[int]) -> str:
        if not numbers:
            return ""
        if min(numbers) < 0:
            raise ValueError("numbers must not be negative")
        n = len(self.alphabet)
        at = (len(numbers) + sum(ord(self.alphabet[x % n]) + i for i, x in enumerate(numbers))) % n
        turned = self.alphabet[at:] + self.alphabet[:at]
        out, turned = turned[0], turned[::-1]
        for i, x in enumerate(numbers):
            digits, base = "", turned[1:]
            while True:
                digits = base[x % len(base)] + digits
                x //= len(base)
                if not x:
                    break
            out += digits
            if i < len(numbers) - 1:
                out += turned[0]
                turned = self._mixed(turned)
        return out

    def decode(self, text: str) -> list[int]:
        """The numbers, or none if the text isn't an id."""
        if not text or any(c not in self.alphabet for c in text):
            return []
        at = self.alphabet.index(text[0])
        turned = (self.alphabet[at:] + self.alphabet[:at])[::-1]
        rest, out = text[1:], []
        while rest:
            digits, found, rest = rest.partition(turned[0])
            if not digits:
                break
            base, x = turned[1:], 0
            for c in digits:
                x = x * len(base) + base.index(c)
            out.append(x)
            if found:
                turned = self._mixed(turned)
        return out if self.encode(out) == text else []
