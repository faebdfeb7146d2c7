"""Settings of a profiling run, threshold presets and the run-level plan. Plain Python: a few numbers a run."""

from __future__ import annotations

import math
from dataclasses import dataclass

MODES = ("default", "recall", "precision")
#: Least aligned length for a genus fallback with short reads, and its least aligned fraction.
GENUS_MIN_MAPPED_ILLUMINA = 50
GENUS_MIN_FRACTION = 0.60
LOWER_RATIO, LOWER_RATIO_GENUS, UPPER_RATIO = 0.75, 0.65, 1.5
P_CUTOFF, P_CUTOFF_STRAIN = 1e-5, 1e-10
#: Reads counted for the chunk threshold of a low-mapping run.
LOW_MAP_SCALE = 1.5

# Identity, aligned length and aligned fraction by sequencer and mode (default, recall, precision).
PRESETS = {
    ("illumina", False): ((0.97, 50, 0.7), (0.95, 50, 0.6), (0.98, 50, 0.8)),
    ("illumina", True): ((0.98, 50, 0.8), (0.90, 40, 0.5), (0.96, 60, 0.7)),
    ("nanopore", False): ((0.86, 250, 0.6), (0.85, 250, 0.5), (0.90, 250, 0.6)),
    ("pacbio", False): ((0.86, 250, 0.6), (0.85, 250, 0.5), (0.90, 250, 0.6)),
    ("nanopore", True): ((0.86, 250, 0.6), (0.84, 200, 0.55), (0.87, 300, 0.7)),
    ("pacbio", True): ((0.86, 250, 0.6), (0.85, 200, 0.55), (0.87, 300, 0.7)),
    "assembly": ((0.93, 250, 0.6), (0.90, 200, 0.55), (0.95, 300, 0.7)),
    "other": ((0.86, 250, 0.6), (0.90, 200, 0.55), (0.87, 300, 0.7)),
}


def preset(sequencer: str, mode: str = "default", strain: bool = False) -> tuple[float, int, float]:
    """(identity, mapped_len, fraction); the sequencer's case doesn't matter."""
    name = sequencer.lower()
    row = PRESETS.get((name, strain)) or PRESETS["assembly" if name == "assembly" else "other"]
    return row[MODES.index(mode)]


def probability(value: str | float) -> float:
    x = float(value)
    if not 0 <= x <= 1:
        raise ValueError(f"{value} isn't within [0, 1]")
    return x


def non_negative(value: str | float) -> float:
    x = float(value)
    if not math.isfinite(x) or x < 0:
        raise ValueError(f"{value} isn't a finite number of at least 0")
    return x


@dataclass(frozen=True)
class ProfileConfig:
    sequencer: str = "Illumina"
    mode: str = "default"
    strain: bool = False
    is_paired: bool = False
    identity: float | None = None
    mapped_len: int | None = None
    fraction: float | None = None
    min_breadth: float = 0.0
    min_cbreadth: float | None = None
    min_reads: int | None = None
    min_oebr: float | None = None
    min_coebr: float | None = None
    lowbiomass: bool = False
    strict: bool = False
    keep_raw: bool = False
    by_aligned: bool = False
    genus_identity: float = 0.80
    low_map_rate_threshold: float = 0.30
    genus_fallback: bool = False
    host: int | None = None
    max_em_iterations: int = 1000

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        identity, mapped_len, fraction = preset(self.sequencer, self.mode, self.strain)
        for name, value in (("identity", identity), ("mapped_len", mapped_len), ("fraction", fraction)):
            if getattr(self, name) is None:
                object.__setattr__(self, name, value)
        if self.identity <= 0 or self.mapped_len <= 0 or self.fraction <= 0:
            raise ValueError("identity, mapped length and fraction must be above 0")
        for name in ("identity", "fraction", "min_breadth", "genus_identity", "low_map_rate_threshold"):
            probability(getattr(self, name))
        for name in ("min_oebr", "min_coebr", "min_cbreadth"):
            if getattr(self, name) is not None:
                non_negative(getattr(self, name))
        if self.host is not None and int(self.host) <= 0:
            raise ValueError("the host must be a taxid")

    @property
    def illumina(self) -> bool:
        return self.sequencer.lower() == "illumina"

    @property
    def chunk_flank(self) -> int:
        return 1000 if self.is_paired else 2000

    @property
    def genus_mapped_len(self) -> int:
        return GENUS_MIN_MAPPED_ILLUMINA if self.illumina else self.mapped_len


@dataclass(frozen=True)
class RunTotals:
    reads: int
    aligned_reads: int
    alignments: int

    @property
    def mapping_rate(self) -> float:
        return self.aligned_reads / self.reads if self.reads else 0.0


def low_map(cfg: ProfileConfig, rate: float) -> bool:
    """Short reads, no host, few of them aligned."""
    return cfg.illumina and cfg.host is None and math.isfinite(rate) and rate < cfg.low_map_rate_threshold


def fallback_mode(cfg: ProfileConfig, rate: float, subsampled: bool) -> bool:
    return cfg.genus_fallback or (low_map(cfg, rate) and not subsampled)


def round_half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def chunk_basis(cfg: ProfileConfig, totals: RunTotals, subsampled: bool) -> int:
    """The number of reads from which the chunk threshold is estimated."""
    pinned = cfg.by_aligned
    low = low_map(cfg, totals.mapping_rate)
    if subsampled and cfg.genus_fallback and not pinned:
        return totals.reads
    if not (pinned or low):
        return totals.reads
    if not pinned and low and not subsampled:
        return round_half_away(totals.aligned_reads * LOW_MAP_SCALE)
    return totals.aligned_reads


def chunk_threshold(reads: int, illumina: bool, lowbiomass: bool = False) -> float:
    if lowbiomass:
        return 0.0
    if illumina:
        r = reads / 1e6
        if reads <= 100_000:
            return r
        return 0.11 * r + 0.09 if reads <= 1_000_000 else min(0.2 + 0.382 * math.log10(r), 0.95)
    return 0.0 if reads <= 5000 else 0.3 if reads <= 1_000_000 else 0.5


def min_chunk_breadth(cfg: ProfileConfig, totals: RunTotals, subsampled: bool) -> float | None:
    """The least fixed-chunk breadth; None where a read minimum replaces it."""
    if cfg.min_cbreadth is not None:
        return cfg.min_cbreadth
    if cfg.min_reads is not None:
        return None
    return chunk_threshold(chunk_basis(cfg, totals, subsampled), cfg.illumina, cfg.lowbiomass)
