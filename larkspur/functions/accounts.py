"""Account records `name:salt:hash`, hexadecimal, joined by `|`."""

from __future__ import annotations

import hashlib
import hmac
import secrets

# Stored hashes depend on them.
ALGORITHM, ITERATIONS = "sha256", 600_000


def digest(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    return hashlib.pbkdf2_hmac(ALGORITHM, password.encode(), salt, iterations)


def record(name: str, password: str, salt: bytes | None = None, iterations: int = ITERATIONS) -> str:
    salt = secrets.token_bytes(16) if salt is None else salt
    return ":".join([name, salt.hex(), digest(password, salt, iterations).hex()])


def parse(text: str) -> dict[str, tuple[bytes, bytes]]:
    """Salt and hash by name; empty records are skipped."""
    fields = (part.split(":") for part in text.split("|") if part)
    return {name: (bytes.fromhex(salt), bytes.fromhex(known)) for name, salt, known in fields}


def admits(accounts: dict[str, tuple[bytes, bytes]], name: str, password: str, iterations: int = ITERATIONS) -> bool:
    """Whether the password is the account's; compared in constant time."""
    if name not in accounts:
        return False
    salt, known = accounts[name]
    return hmac.compare_digest(digest(password, salt, iterations), known)
