"""The definition of a corpus and of how it is fetched."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import date


@dataclass(frozen=True)
class IngestConfig:
    query: str
    ncbi_email: str
    ncbi_tool: str
    ncbi_api_key: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    max_records: int | None = None
    batch_size: int = 200
    pmc_batch_size: int = 20
    rate_limit: float = 1.0

    def __post_init__(self) -> None:
        wrong = [f"{n} is blank" for n in ("query", "ncbi_email", "ncbi_tool") if not (getattr(self, n) or "").strip()]
        if self.ncbi_api_key is not None and not self.ncbi_api_key.strip():
            wrong.append("ncbi_api_key is blank; leave it None")
        if self.year_min and self.year_max and self.year_min > self.year_max:
            wrong.append("year_min is after year_max")
        wrong += [f"{n} must be positive" for n in ("batch_size", "pmc_batch_size") if getattr(self, n) <= 0]
        if self.max_records is not None and self.max_records <= 0:
            wrong.append("max_records must be positive")
        if self.rate_limit < 0:
            wrong.append("rate_limit must not be negative")
        if wrong:
            raise ValueError("; ".join(wrong))

    def recorded(self) -> dict:
        """All settings but the key, which is nobody's business."""
        return {k: v for k, v in asdict(self).items() if k != "ncbi_api_key"}

    def config_hash(self) -> str:
        return hashlib.sha256(json.dumps(self.recorded(), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def build_query(config: IngestConfig, query: str | None = None, year_min: int | None = None, year_max: int | None = None) -> str:
    """The search term, with publication years if either bound is set (0 is none)."""
    low, high = year_min or config.year_min, year_max or config.year_max
    term = f"({query or config.query})"
    return f"{term} AND {low or 1800}:{high or 3000}[dp]" if low or high else term


def incremental_term(config: IngestConfig, since: date, until: date) -> str:
    return f"({config.query}) AND {since:%Y/%m/%d}:{until:%Y/%m/%d}[edat]"
