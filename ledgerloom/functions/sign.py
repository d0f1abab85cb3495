"""Ed25519 (RFC 8032) signatures over hash strings, in plain Python as no crypto library is at hand."""

from __future__ import annotations

import hashlib

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
I = pow(2, (P - 1) // 4, P)  # noqa: E741
SCHEME = "sig:ed25519:"

Point = tuple[int, int, int, int]


def _x(y: int, sign: int) -> int | None:
    xx = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(xx, (P + 3) // 8, P)
    if (x * x - xx) % P:
        x = x * I % P
    if (x * x - xx) % P or (not x and sign):
        return None
    return P - x if x & 1 != sign else x


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


_Y = 4 * pow(5, P - 2, P) % P
BASE: Point = (_x(_Y, 0), _Y, 1, _x(_Y, 0) * _Y % P)


def _pack(p: Point) -> bytes:
    z = pow(p[2], P - 2, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(data: bytes) -> Point | None:
    n = int.from_bytes(data, "little")
    y, sign = n & (1 << 255) - 1, n >> 255
    x = _x(y, sign) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % L


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


def key_id(public: bytes) -> str:
    return "sha256:" + hashlib.sha256(public).hexdigest()


def sign(seed: bytes, message: str) -> str:
    a, prefix = _secret(seed)
    public, data = _pack(_times(a, BASE)), message.encode()
    r = _hash(prefix, data)
    point = _pack(_times(r, BASE))
    s = (r + _hash(point, public, data) * a) % L
    return SCHEME + (point + s.to_bytes(32, "little")).hex()


def verify(public_hex: str, message: str, signature: str) -> bool:
    """Whether a signature over the message's ASCII is the key's; False for anything malformed."""
    try:
        if not signature.startswith(SCHEME):
            return False
        data, public = bytes.fromhex(signature[len(SCHEME) :]), bytes.fromhex(public_hex)
    except ValueError:
        return False
    if len(data) != 64 or len(public) != 32:
        return False
    a, r, s = _unpack(public), _unpack(data[:32]), int.from_bytes(data[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, BASE), _add(r, _times(_hash(data[:32], public, message.encode()), a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 == (left[1] * right[2] - right[1] * left[2]) % P
