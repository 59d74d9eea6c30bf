"""Ciphers of stored secrets, in plain Python: the inputs are a few kilobytes an image. RC4, AES and DES."""

from __future__ import annotations

import struct


def rc4(key: bytes, data: bytes) -> bytes:
    """The stream cipher; the same for both directions."""
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out.append(byte ^ box[(box[i] + box[j]) & 255])
    return bytes(out)


# --- AES -------------------------------------------------------------------------------------------------------------


def _times(a: int, b: int) -> int:
    """A product in the field of AES."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = (a << 1) ^ (0x11B if a & 0x80 else 0), b >> 1
    return out


def _sbox() -> list[int]:
    """Inverses in the field, then the affine map."""
    out = []
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        turned = [(inverse << k | inverse >> (8 - k)) & 255 for k in range(5)]
        out.append(turned[0] ^ turned[1] ^ turned[2] ^ turned[3] ^ turned[4] ^ 0x63)
    return out


SBOX = _sbox()
UNBOX = [SBOX.index(x) for x in range(256)]
_UNMIX = {k: [_times(x, k) for x in range(256)] for k in (9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[bytes]:
    n = len(key) // 4
    words = [key[4 * i : 4 * i + 4] for i in range(n)]
    power = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(SBOX[w[(k + 1) % 4]] ^ (power if k == 0 else 0) for k in range(4))
            power = _times(power, 2)
        elif n > 6 and i % n == 4:
            w = bytes(SBOX[x] for x in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def aes_decrypt(key: bytes, data: bytes, iv: bytes | None = None) -> bytes:
    """CBC with an initial vector, block by block without one; a short last block is filled with zeros, no padding."""
    keys, out = _round_keys(key), bytearray()
    for at in range(0, len(data), 16):
        block = data[at : at + 16].ljust(16, b"\0")
        state = [a ^ b for a, b in zip(block, keys[-1], strict=True)]
        for k in range(len(keys) - 2, -1, -1):
            # Columns are four bytes; row r was shifted by r.
            state = [UNBOX[state[(i - 4 * (i % 4)) % 16]] ^ keys[k][i] for i in range(16)]
            if k:
                state = [_UNMIX[14][state[c + r]] ^ _UNMIX[11][state[c + (r + 1) % 4]] ^ _UNMIX[13][state[c + (r + 2) % 4]] ^ _UNMIX[9][state[c + (r + 3) % 4]] for c in (0, 4, 8, 12) for r in range(4)]
        out += bytes(a ^ b for a, b in zip(state, iv, strict=True)) if iv is not None else bytes(state)
        iv = block if iv is not None else None
    return bytes(out)


# --- DES: the tables of FIPS 46-3. Fixed values. ----------------------------------------------------------------------

EXPAND = [(4 * (i // 6) + i % 6 - 1) % 32 for i in range(48)]
INITIAL = [57 + 2 * (i // 8) - 8 * (i % 8) if i < 32 else 56 + 2 * ((i - 32) // 8) - 8 * (i % 8) for i in range(64)]
MIX = [15, 6, 19, 20, 28, 11, 27, 16, 0, 14, 22, 25, 4, 17, 30, 9, 1, 7, 23, 13, 31, 26, 2, 8, 18, 12, 29, 5, 21, 10, 3, 24]
KEY_BITS = [56, 48, 40, 32, 24, 16, 8, 0, 57, 49, 41, 33, 25, 17, 9, 1, 58, 50, 42, 34, 26, 18, 10, 2, 59, 51, 43, 35, 62, 54, 46, 38, 30, 22, 14, 6, 61, 53, 45, 37, 29, 21, 13, 5, 60, 52, 44, 36, 28, 20, 12, 4, 27, 19, 11, 3]
ROUND_BITS = [13, 16, 10, 23, 0, 4, 2, 27, 14, 5, 20, 9, 22, 18, 11, 3, 25, 7, 15, 6, 26, 19, 12, 1, 40, 51, 30, 36, 46, 54, 29, 39, 50, 44, 32, 47, 43, 48, 38, 55, 33, 52, 45, 41, 49, 35, 28, 31]
TURNS = (1, 1, 2, 2, 2, 2, 2, 2, 1, 2, 2, 2, 2, 2, 2, 1)
#: Four rows of sixteen for each of the eight boxes.
BOXES = (
    "e4d12fb83a6c5907 0f74e2d1a6cb9538 41e8d62bfc973a50 fc8249175b3ea06d",
    "f18e6b34972dc05a 3d47f28ec01a69b5 0e7ba4d158c6932f d8a13f42b67c05e9",
    "a09e63f51dc7b428 d709346a285ecbf1 d6498f30b12c5ae7 1ad069874fe3b52c",
    "7de3069a1285bc4f d8b56f03472c1ae9 a690cb7df13e5284 3f06a1d8945bc72e",
    "2c417ab6853fd0e9 eb2c47d150fa3986 421bad78f9c5630e b8c71e2d6f09a453",
    "c1af92680d34e75b af427c9561de0b38 9ef528c3704a1db6 432c95fabe17608d",
    "4b2ef08d3c975a61 d0b7491ae35c2f86 14bdc37eaf680592 6bd814a7950fe23c",
    "d2846fb1a93e50c7 1fd8a374c56b0e92 7b419ce206adf358 21e74a8dfc90356b",
)


def _boxes() -> list[list[int]]:
    """Each box by its six input bits: the outer two choose the row, the inner four the column."""
    rows = [[[int(c, 16) for c in r] for r in box.split()] for box in BOXES]
    return [[box[(x >> 4 & 2) | (x & 1)][x >> 1 & 15] for x in range(64)] for box in rows]


def _bits(data: bytes) -> list[int]:
    return [byte >> (7 - i) & 1 for byte in data for i in range(8)]


def des(key: bytes, block: bytes, decrypt: bool = True) -> bytes:
    """One block of eight bytes; the parity bits of the key do not matter."""
    chosen = _bits(key)
    c = [chosen[i] for i in KEY_BITS]
    left_key, right_key, keys = c[:28], c[28:], []
    for n in TURNS:
        left_key, right_key = left_key[n:] + left_key[:n], right_key[n:] + right_key[:n]
        both = left_key + right_key
        keys.append([both[i] for i in ROUND_BITS])
    bits = _bits(block)
    bits = [bits[i] for i in INITIAL]
    left, right = bits[:32], bits[32:]
    for k in reversed(keys) if decrypt else keys:
        mixed = [right[i] ^ b for i, b in zip(EXPAND, k, strict=True)]
        out: list[int] = []
        for j, box in enumerate(S):
            x = int("".join(map(str, mixed[6 * j : 6 * j + 6])), 2)
            out += [box[x] >> (3 - i) & 1 for i in range(4)]
        left, right = right, [a ^ out[i] for a, i in zip(left, MIX, strict=True)]
    last = right + left
    final = [0] * 64
    for to, i in enumerate(INITIAL):
        final[i] = last[to]
    return struct.pack(">Q", int("".join(map(str, final)), 2))


S = _boxes()


def spread_key(seven: bytes) -> bytes:
    """Seven bytes as the eight of a DES key: seven bits a byte, the lowest left out."""
    x = int.from_bytes(seven, "big")
    return bytes((x >> (49 - 7 * i) & 127) << 1 for i in range(8))
