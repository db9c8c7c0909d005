"""SHA-256 whose state can be handed on, so that a digest of very long data is made by one bounded task after another."""

from __future__ import annotations

import ctypes
import ctypes.util
from functools import cache

#: Bytes of OpenSSL's public SHA256_CTX: eight words, the length in two, a block of sixteen words, two counters.
CONTEXT = 4 * (8 + 2 + 16 + 2)


@cache
def library() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib itself is linked to, or else the system's; None without one."""
    names = []
    try:
        import _hashlib

        names.append(_hashlib.__file__)
    except (ImportError, AttributeError):  # a Python without OpenSSL, or with it inside
        pass
    for name in [*names, ctypes.util.find_library("crypto")]:
        try:
            found = ctypes.CDLL(name) if name else None
            if found is not None:
                found.SHA256_Init.argtypes = [ctypes.c_void_p]
                found.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
                found.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
                return found
        except (OSError, AttributeError):
            continue
    return None


class Sha256:
    """As hashlib's, and begun from a state() of another one, in any process of machines of one kind."""

    def __init__(self, state: bytes | None = None) -> None:
        if state is not None and len(state) != CONTEXT:
            raise ValueError(f"a state has {CONTEXT} bytes, not {len(state)}")
        self._context = ctypes.create_string_buffer(state or bytes(CONTEXT), CONTEXT)
        if state is None:
            library().SHA256_Init(self._context)

    def update(self, data: bytes) -> None:
        library().SHA256_Update(self._context, data, len(data))

    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        last, out = ctypes.create_string_buffer(self.state(), CONTEXT), ctypes.create_string_buffer(32)
        library().SHA256_Final(out, last)
        return out.raw.hex()
