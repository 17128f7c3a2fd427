"""Names shared by every operator: entity key, columns, bounded-size limits."""
from __future__ import annotations

PERSON = "person_composite_id"
VANTAGE = "vantage_date"
ENTITY = [PERSON, VANTAGE]
EFFECTIVE = "rec_eff_start_dt_mod"

# Largest table that may be pinned on the driver and broadcast from there.
SMALL_ROWS = 20_000

HORIZONS = [30, 90, 180, 365]
MAX_DAY = 365
