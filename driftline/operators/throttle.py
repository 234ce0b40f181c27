"""Token buckets over ordered events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..streaming.frames import by_key

SCHEMA = "key {kind}, seq long, ts long, bytes long, sent_at long"


class Bucket:
    """A bucket that starts full; times are microseconds."""

    def __init__(self, rate: int, burst: int):
        self.rate, self.cap, self.tokens, self.now = rate, float(burst), float(burst), None

    def step(self, row: dict) -> list[dict]:
        t, n = row["ts"], row["bytes"]
        start = t if self.now is None else max(t, self.now)
        tokens = self.cap if self.now is None else min(self.cap, self.tokens + (start - self.now) * self.rate / 1e6)
        need = min(float(n), self.cap)
        wait = 0 if tokens >= need else math.ceil((need - tokens) * 1e6 / self.rate)
        self.now = start + wait
        self.tokens = min(self.cap, tokens + wait * self.rate / 1e6) - n
        return [{"seq": row["seq"], "ts": t, "bytes": n, "sent_at": self.now}]


def throttled(events: DataFrame, rate: int, burst: int | None = None, key_type: str = "long") -> DataFrame:
    """When each event (key, seq, ts in microseconds, bytes) of a key may be sent, in order of seq.

    The bucket starts full with ``burst`` bytes (``max(rate, 64 KiB)`` if not
    given) and refills by ``rate`` bytes a second up to it. An item larger than
    the burst is sent once the bucket is full and leaves a debt: with the bucket
    capped at its burst it could never pass otherwise. With ``burst=rate`` and
    ``ts`` the time at which a local copy ends, ``sent_at`` is when the next one may begin.
    """
    cap = max(rate, 64 << 10) if burst is None else burst
    return by_key(events.select("key", "seq", "ts", "bytes"), "key", lambda: Bucket(rate, cap).step, SCHEMA.format(kind=key_type))
