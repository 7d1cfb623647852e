"""The library's fixed vocabularies."""

from __future__ import annotations

#: What a citation can be for, its weight, and the six statuses of a work.
INTENT_WEIGHTS = {"method": 3.0, "extends": 2.5, "result_comparison": 2.0, "contrasts": 2.0, "uses_data": 1.5, "background": 1.0}
STATUSES = ("pending", "processing", "completed", "failed", "skipped", "degraded")
PRIORITIES = {"high": 3, "medium": 2, "low": 1}
