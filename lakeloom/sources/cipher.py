"""RC4 and AES as PDF files use them, and the keys of their standard security handler (ISO 32000, 7.6)."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

from lakeloom.sources.package import Refused

# Fixed value: what short passwords are filled up with.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, x in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[n] = x ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """The product in the field of 256 elements."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[np.ndarray, np.ndarray]:
    """The substitution and its inverse: the reciprocal, turned and added up."""
    forward = np.zeros(256, np.uint8)
    power, logs = 1, {}
    for k in range(255):
        logs[power] = k
        power = _times(power, 3)
    powers = {k: x for x, k in logs.items()}
    for x in range(256):
        r = powers[(255 - logs[x]) % 255] if x else 0
        turned = r
        for k in range(1, 5):
            turned ^= (r << k | r >> 8 - k) & 255
        forward[x] = turned ^ 0x63
    return forward, np.argsort(forward).astype(np.uint8)


SUBSTITUTE, RESTORE = _boxes()
_BY = {k: np.array([_times(x, k) for x in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}
_ROWS = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])  # where each byte comes from as rows turn
_BACK = np.argsort(_ROWS)


def _round_keys(key: bytes) -> np.ndarray:
    n = len(key) // 4
    words, turn = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = list(words[-1])
        if i % n == 0:
            w = [int(SUBSTITUTE[x]) for x in w[1:] + w[:1]]
            w[0] ^= turn
            turn = _times(turn, 2)
        elif n > 6 and i % n == 4:
            w = [int(SUBSTITUTE[x]) for x in w]
        words.append([a ^ b for a, b in zip(w, words[i - n])])
    return np.array(words, np.uint8).reshape(-1, 16)


def _mixed(s: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    c = s.reshape(-1, 4, 4)
    by = lambda k, x: x if k == 1 else _BY[k][x]
    out = np.zeros_like(c)
    for row in range(4):
        for k in range(4):
            out[:, :, row] ^= by(factors[(k - row) % 4], c[:, :, k])
    return out.reshape(-1, 16)


def _decrypted(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(RESTORE[s[:, _BACK]] ^ k, (14, 11, 13, 9))
    return RESTORE[s[:, _BACK]] ^ keys[0]


def _columns() -> list[list[int]]:
    """Of each byte in each row: what substitution and mixing make of it in its column."""
    out = []
    for row in range(4):
        table = []
        for x in range(256):
            y = int(SUBSTITUTE[x])
            mixed = [_times(y, 2), y, y, _times(y, 3)]
            mixed = mixed[-row:] + mixed[:-row] if row else mixed
            table.append(int.from_bytes(bytes(mixed), "big"))
        out.append(table)
    return out


_MADE = _columns()


def aes_encrypt(key: bytes, data: bytes, start: bytes) -> bytes:
    """AES-CBC of whole blocks. A block waits for the one before, so columns are whole numbers here, with
    a table for each row."""
    keys = [[int.from_bytes(k[i : i + 4].tobytes(), "big") for i in range(0, 16, 4)] for k in _round_keys(key)]
    t0, t1, t2, t3 = _MADE
    box = SUBSTITUTE.tolist()
    last, out = struct.unpack(">4I", start), []
    for block in struct.iter_unpack(">4I", data):
        a, b, c, d = (x ^ y ^ k for x, y, k in zip(block, last, keys[0]))
        for k in keys[1:-1]:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0],
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2],
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        w = (a, b, c, d)
        last = tuple((box[w[i] >> 24] << 24 | box[w[(i + 1) % 4] >> 16 & 255] << 16 | box[w[(i + 2) % 4] >> 8 & 255] << 8 | box[w[(i + 3) % 4] & 255]) ^ keys[-1][i] for i in range(4))
        out.append(struct.pack(">4I", *last))
    return b"".join(out)


def aes_decrypt(key: bytes, data: bytes, start: bytes) -> bytes:
    whole = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(whole):
        return b""
    before = np.concatenate([np.frombuffer(start, np.uint8)[None], whole[:-1]])
    return (_decrypted(whole, _round_keys(key)) ^ before).tobytes()


def unpadded(data: bytes) -> bytes:
    return data[: -data[-1]] if data and 1 <= data[-1] <= 16 else data


def hardened(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    """The hash of revisions 5 and 6."""
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    turn = 0
    while True:
        e = aes_encrypt(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        turn += 1
        if turn >= 64 and e[-1] <= turn - 32:
            return k[:32]


class Security:
    """The standard handler of one file; an empty password is tried unless one is given."""

    def __init__(self, values: dict, file_id: bytes, password: str = ""):
        self.version, self.revision = values["V"], values["R"]
        self.method = values.get("method") or ("AESV3" if self.version >= 5 else "RC4")
        if self.version not in (1, 2, 4, 5) or self.method not in ("RC4", "AESV2", "AESV3", "Identity"):
            raise Refused(f"encryption of version {self.version}")
        if self.version >= 5:
            self.key = self._new_key(password.encode()[:127], values)
        else:
            self.key = self._old_key(password.encode("latin-1", "replace"), values, file_id)

    def _new_key(self, password: bytes, v: dict) -> bytes:
        o, u = v["O"][:48], v["U"][:48]
        for stored, user, wrapped in ((u, b"", v["UE"]), (o, u, v["OE"])):
            if hardened(password, stored[32:40], user, self.revision) == stored[:32]:
                return aes_decrypt(hardened(password, stored[40:48], user, self.revision), wrapped[:32], bytes(16))
        raise Refused("the file is encrypted with another password")

    def _old_key(self, password: bytes, v: dict, file_id: bytes) -> bytes:
        n = 5 if self.revision == 2 else v.get("Length", 40) // 8 if self.version < 4 else 16

        def key_of(plain: bytes) -> bytes:
            seed = (plain + PADDING)[:32] + v["O"][:32] + struct.pack("<i", v["P"]) + file_id
            k = hashlib.md5(seed + (b"\xff" * 4 if self.revision >= 4 and not v.get("metadata", True) else b"")).digest()
            for _ in range(50 if self.revision >= 3 else 0):
                k = hashlib.md5(k[:n]).digest()
            return k[:n]

        def user_value(k: bytes) -> bytes:
            if self.revision == 2:
                return rc4(k, PADDING)
            x = hashlib.md5(PADDING + file_id).digest()
            for i in range(20):
                x = rc4(bytes(b ^ i for b in k), x)
            return x

        k = hashlib.md5((password + PADDING)[:32]).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            k = hashlib.md5(k[:n]).digest()
        owner = v["O"][:32]
        for i in reversed(range(20 if self.revision >= 3 else 1)):
            owner = rc4(bytes(b ^ i for b in k[:n]), owner)
        for plain in (password, owner):
            k = key_of(plain)
            check = user_value(k)
            if v["U"][: len(check)] == check:
                return k
        raise Refused("the file is encrypted with another password")

    def stream(self, data: bytes, number: int, generation: int) -> bytes:
        if self.method == "Identity":
            return data
        if self.version >= 5:
            return unpadded(aes_decrypt(self.key, data[16:], data[:16])) if len(data) >= 32 else b""
        seed = self.key + struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if self.method == "AESV2" else b"")
        k = hashlib.md5(seed).digest()[: min(16, len(self.key) + 5)]
        if self.method == "AESV2":
            return unpadded(aes_decrypt(k, data[16:], data[:16])) if len(data) >= 32 else b""
        return rc4(k, data)
