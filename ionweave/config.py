"""Search configuration: frozen values, TOML in and out, a hash that keys index caches."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tomllib
from dataclasses import dataclass

#: How TOML, which has no null, spells one (fixed value).
TOML_NULL = "__NONE__"


@dataclass(frozen=True)
class IndexConfig:
    """What decides the contents of a peptide index."""

    peptide_length_range: tuple[int, int] = (7, 25)
    peptide_mz_range: tuple[float, float] = (399.0, 1001.0)
    precursor_charges: tuple[int, ...] = (2, 3)
    ion_series: str = "by"
    ion_charges: tuple[int, ...] = (1, 2)
    ion_mz_range: tuple[float, float] = (250.0, 2000.0)
    db_enzyme: str = "[KR]"
    db_max_missed_cleavages: int = 2
    db_bucket_size: int = 32768
    #: Carbamidomethyl on every cysteine.
    fixed_cys_mod: bool = True
    #: Decoys that equal a target stay (both then count as targets).
    keep_colliding_decoys: bool = False

    def to_toml(self) -> str:
        def spell(v):
            if v is None:
                return json.dumps(TOML_NULL)
            return "[" + ", ".join(map(spell, v)) + "]" if isinstance(v, tuple) else json.dumps(v)

        return "".join(f"{k} = {spell(v)}\n" for k, v in dataclasses.asdict(self).items())

    @classmethod
    def from_toml(cls, text: str):
        plain = {k: None if v == TOML_NULL else tuple(v) if isinstance(v, list) else v for k, v in tomllib.loads(text).items()}
        known = {f.name for f in dataclasses.fields(cls)}
        if odd := set(plain) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
        return cls(**plain)

    def hash(self) -> str:
        """md5 of the canonical JSON of all values."""
        return hashlib.md5(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()

    def log(self, logger, level: int = 20) -> None:
        for k, v in dataclasses.asdict(self).items():
            logger.log(level, "%s: %s", k, v)


@dataclass(frozen=True)
class SearchConfig(IndexConfig):
    """Index settings and what a search does with an index."""

    g_tolerances: tuple[float, float] = (20.0, 20.0)
    g_tolerance_units: tuple[str, str] = ("ppm", "ppm")
    g_ims_tolerance: float = 0.03
    g_ims_tolerance_unit: str = "abs"
    scoring_score_function: str = "Hyperscore"
    run_max_peaks: int = 1_000_000
    run_max_peaks_per_spec: int = 5_000
    run_parallelism: int = -4
    run_deconvolute_spectra: bool = True
    run_min_peak_intensity: float = 100.0
    run_debug_log_frequency: int = 100
    run_allowed_fails: int = 700
    run_max_consecutive_fails: int = 1000
    run_window_size: int = 21
    run_max_peaks_per_window: int = 150
    run_min_intensity_ratio: float = 0.01
    run_min_correlation_score: float = 0.2
    run_scaling_ratio: float = 0.001
    run_scaling_limits: tuple[float, float] = (0.001, 0.999)
    #: Peaks below this are removed from a spectrum once it was scaled.
    run_intensity_floor: float = 10.0
    #: (first, last) of the isolation windows to search; all if None.
    window_subset: tuple[int, int] | None = None
    train_fdr: float = 0.01
    eval_fdr: float = 0.01

    def __post_init__(self):
        if not set(self.g_tolerance_units) <= {"da", "ppm"}:
            raise ValueError("mass tolerances are in da or ppm")
        if self.g_ims_tolerance_unit != "abs":
            raise NotImplementedError("ion-mobility tolerances are absolute")

    @property
    def index_config(self) -> IndexConfig:
        return IndexConfig(**{f.name: getattr(self, f.name) for f in dataclasses.fields(IndexConfig)})

    @property
    def chemistry(self) -> dict:
        """The settings that peptide chemistry depends on."""
        names = ("peptide_length_range", "precursor_charges", "ion_series", "ion_charges", "peptide_mz_range", "g_tolerances", "g_tolerance_units")
        return {n: getattr(self, n) for n in names}
