"""Parameters shared by the catalogue's queries and their SQL counterparts."""

from __future__ import annotations

from tallyspark.sources.event_feed import AS_OF, nanos_literal

TZ = "UTC"
REFRESH_SECONDS = 86_400
STALE_NANOS = 2 * REFRESH_SECONDS * 1_000_000_000
AS_OF_SQL = nanos_literal(AS_OF, "duckdb")
AS_OF_SPARK = nanos_literal(AS_OF, "spark")
DAY_START_SQL = nanos_literal(f"{AS_OF[:10]} 00:00:00", "duckdb")

# model, tier, is_split, short (input, cached, output), long; USD per 1M tokens.
# m4 is unpriced, m2 has no cached rate, m3 has no long prices in fast.
PRICE_ROWS = (
    ("m0", "standard", False, (2.0, 0.5, 8.0), None),
    ("m0", "fast", False, (4.0, 1.0, 16.0), None),
    ("m0", "ultrafast", False, (8.0, 2.0, 32.0), None),
    ("m1", "standard", True, (1.25, 0.125, 10.0), (2.5, 0.25, 15.0)),
    ("m1", "fast", True, (2.5, 0.25, 20.0), (5.0, 0.5, 30.0)),
    ("m1", "ultrafast", True, (5.0, 0.5, 40.0), (10.0, 1.0, 60.0)),
    ("m2", "standard", False, (3.0, None, 12.0), None),
    ("m2", "fast", False, (6.0, None, 24.0), None),
    ("m3", "standard", True, (1.0, 0.1, 4.0), (2.0, 0.2, 6.0)),
    ("m3", "fast", True, (2.0, 0.2, 8.0), None),
)

# A later sheet: m4 gets standard and fast prices, m3 long prices in fast.
NEWER_PRICE_ROWS = (
    *PRICE_ROWS[:9],
    ("m3", "fast", True, (2.0, 0.2, 8.0), (4.0, 0.4, 12.0)),
    ("m4", "standard", False, (1.0, 0.1, 5.0), None),
    ("m4", "fast", False, (2.0, None, 10.0), None),
)
