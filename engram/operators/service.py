"""Thin service helpers: token buckets, API keys and permissions."""

from __future__ import annotations

import hashlib
import secrets
from dataclasses import dataclass, field

from engram.schema import require

RATES = {"write": (1_000, 5_000), "read": (5_000, 10_000), "admin": (10, 20)}
READ, WRITE, ADMIN = 1, 2, 4


@dataclass
class RateLimiter:
    """A token bucket for each tenant and class of operation; the clock is an argument."""

    rates: dict[str, tuple[int, int]] = field(default_factory=lambda: dict(RATES))
    held: dict[tuple[str, str], tuple[float, int]] = field(default_factory=dict)

    def allow(self, tenant: str, kind: str, now_us: int, cost: float = 1.0) -> bool:
        rate, burst = self.rates[kind]
        tokens, last = self.held.get((tenant, kind), (float(burst), now_us))
        tokens = min(float(burst), tokens + max(0, now_us - last) * rate / 1e6)
        ok = tokens >= cost
        self.held[tenant, kind] = (tokens - cost if ok else tokens, now_us)
        return ok


def hash_key(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()


def generate_key() -> tuple[str, str]:
    """A new key, and the hash that is stored of it."""
    key = "eg_" + secrets.token_hex(24)
    return key, hash_key(key)


def authorize(permissions: int, needed: int) -> None:
    require(permissions & needed == needed, "the key lacks a permission")
