"""RC4 and XOR obfuscation of binary word files."""

from __future__ import annotations

import hashlib

import numpy as np

from inkwell.sources.compound import BadFile

BLOCK = 512
DEFAULT_PASSWORD = "VelvetSweatshop"


def xored(data: bytes, key: int) -> bytes:
    """Each byte with the matching one of a four-byte key, over and over."""
    raw = np.frombuffer(data, np.uint8)
    return (raw ^ np.resize(np.frombuffer(key.to_bytes(4, "little"), np.uint8), len(raw))).tobytes()


def keystream(key: bytes, n: int) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(n), 0, 0
    for k in range(n):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = s[(s[i] + s[j]) & 255]
    return bytes(out)


def block_key(base: bytes, block: int, digest: str = "md5") -> bytes:
    made = hashlib.new(digest, base + block.to_bytes(4, "little")).digest()
    return made[:16]


def rc4(data: bytes, base: bytes, at: int = 0, clear: int = 0, digest: str = "md5") -> bytes:
    """data, which begins at byte `at` of its stream, with a new key for each 512 bytes of the stream; bytes before `clear` stay as they are."""
    out = bytearray(data)
    place = at
    while place < at + len(data):
        block, inside = divmod(place, BLOCK)
        end = min((block + 1) * BLOCK, at + len(data))
        stream = keystream(block_key(base, block, digest), end - block * BLOCK)[inside:]
        for k, b in enumerate(stream, place - at):
            if at + k >= clear:
                out[k] ^= b
        place = end
    return bytes(out)


def base_key(password: str, salt: bytes) -> bytes:
    """The five-byte base of block keys: the password's digest with the salt, sixteen times over."""
    first = hashlib.md5(password.encode("utf-16-le")).digest()[:5]
    return hashlib.md5((first + salt) * 16).digest()[:5]


def verified(password: str, salt: bytes, verifier: bytes, verifier_hash: bytes) -> bytes | None:
    """The base key if the password fits, else none."""
    base = base_key(password, salt)
    plain = rc4(verifier + verifier_hash, base)
    return base if hashlib.md5(plain[:16]).digest() == plain[16:32] else None


#: The first two bytes of files that aren't obfuscated.
PLAIN = (b"\xec\xa5", b"\xb3\xa5")


def looks_obfuscated(data: bytes) -> bool:
    """Whether data doesn't begin as a plain file does."""
    return data[:2] not in PLAIN


def telling_key(data: bytes, key: int) -> int:
    """The key, or the next one by which data doesn't turn into what begins as a plain file does: it could not be told from one."""
    while data and not looks_obfuscated(xored(data[:2], key)):
        key = key + 1 & 0xFFFF_FFFF
    return key


def provider_key(password: str, table: bytes) -> tuple[bytes, int]:
    """The base of block keys by a cryptographic provider's header, from the password's digest behind the salt, and where the header ends. The verifier isn't checked."""
    bits = int.from_bytes(table[20:24], "little") or 40
    at = 36
    while at + 2 <= len(table) and table[at : at + 2] != b"\0\0":
        at += 2
    at += 2
    at += -at % 4
    size, salt = int.from_bytes(table[at : at + 4], "little"), table[at + 4 : at + 20]
    if size != 16 or len(table) < at + 60 or not int.from_bytes(table[at + 36 : at + 40], "little"):
        raise BadFile("incomplete encryption header")
    return hashlib.sha1(salt + password.encode("utf-16-le")).digest()[: bits // 8], at + 60
