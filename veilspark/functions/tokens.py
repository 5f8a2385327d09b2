"""Keys, keyed hashes, tokens, encryption and masking."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels for the two derived keys.
CIPHER_INFO, HASH_INFO = b"veilspark-cipher", b"veilspark-token-hash"


def hkdf(secret: bytes, salt: bytes, info: bytes, size: int = 32) -> bytes:
    """RFC 5869 with SHA-256."""
    key = hmac.new(salt or bytes(32), secret, hashlib.sha256).digest()
    out, block = b"", b""
    for i in range(1, -(-size // 32) + 1):
        block = hmac.new(key, block + info + bytes([i]), hashlib.sha256).digest()
        out += block
    return out[:size]


@dataclass(frozen=True)
class Keys:
    """Derived keys; they are literals of a plan, so treat explained plans as secret."""

    cipher: bytes
    digest: bytes

    @staticmethod
    def derive(secret: bytes, salt: bytes = b"") -> Keys:
        cipher = hkdf(secret, salt, CIPHER_INFO)
        return Keys(cipher, hkdf(cipher, b"", HASH_INFO))


def hmac_sha256(v: Column, key: bytes) -> Column:
    """Lowercase hex HMAC of a text's UTF-8 bytes, from two nested digests."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(v, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def mint(entity: Column, digest: Column) -> Column:
    return F.concat(F.lit("["), entity, F.lit("_"), F.substring(digest, 1, 16), F.lit("]"))


def token(entity: Column, v: Column, keys: Keys) -> Column:
    return mint(entity, hmac_sha256(v, keys.digest))


def encrypt(v: Column, keys: Keys) -> Column:
    """Hex of nonce, ciphertext and tag (AES-256-GCM). The nonce is random: write the result before using it twice."""
    return F.lower(F.hex(F.aes_encrypt(F.encode(v, "UTF-8"), F.lit(keys.cipher), F.lit("GCM"))))


def decrypt(c: Column, keys: Keys) -> Column:
    """The text, or null for anything that does not verify."""
    return F.decode(F.try_aes_decrypt(F.unhex(c), F.lit(keys.cipher), F.lit("GCM")), "UTF-8")


def bucket(v: Column, size: int) -> Column:
    """``lo-hi`` of the bucket of an integer text, counted from zero; other texts stay."""
    if size <= 0:
        raise ValueError("bucket size must be greater than zero")
    n = F.when(v.rlike(r"^[+-]?[0-9]{1,18}\z"), v.cast("long"))
    low = F.call_function("div", n, F.lit(size)) * size
    return F.when(n.isNull(), v).otherwise(F.concat_ws("-", low.cast("string"), (low + size).cast("string")))


def shift_digits(v: Column, keys: Keys) -> Column:
    """Digits moved by a keystream (AES counter mode from zero, as long as the text's bytes), other characters kept.

    The offset also depends on the digit itself, so this masks but cannot be undone.
    """
    pairs = lambda c: F.regexp_extract_all(F.hex(c), F.lit(".."), F.lit(0))
    own = pairs(F.encode(v, "UTF-8"))
    block = lambda i: F.substring(F.aes_encrypt(F.unhex(F.lpad(F.hex(i), 32, "0")), F.lit(keys.cipher), F.lit("ECB"), F.lit("PKCS")), 1, 16)
    stream = F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / 16).cast("int")), lambda i: pairs(block(i))))
    number = lambda c: F.conv(c, 16, 10).cast("int")
    moved = lambda b, k: F.hex(((number(b) - 48 + number(b).bitwiseXOR(number(k)) % 10) % 10 + 48).cast("long"))
    done = F.zip_with(own, F.slice(stream, F.lit(1), F.size(own)), lambda b, k: F.when(b.rlike("^3[0-9]$"), moved(b, k)).otherwise(b))
    return F.when(v == "", v).otherwise(F.decode(F.unhex(F.array_join(done, "")), "UTF-8"))
