"""Parameters of a peak-estimation run, kept together and stored with the model."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

# Key of one series: one measured entity in one region during one stored year.
SERIES_KEY = ("region", "entity", "year")

# Key of one published result row.
RESULT_KEY = ("region", "entity", "measure", "year")


@dataclass(frozen=True)
class PeakConfig:
    """Run parameters; defaults are for ten-minute readings (144 per day)."""

    measure: str = "MVA"
    length: int = 144
    latent: int = 32
    channels: tuple[str, ...] = ("value", "derivative", "spread", "level", "level_delta")
    spread_width: int = 7
    level_mean: float = 0.0
    level_std: float = 1.0
    delta_std: float = 1.0
    peak_quantile: float = 0.999
    tau: float = 0.05
    seed: int = 42
    # synthetic contamination used while fitting
    plateau_probability: float = 0.5
    plateau_amplitude: float = 2.0
    spike_probability: float = 0.5
    spike_amplitude: float = 4.0
    noise: float = 0.05
    # fitting
    replicas: int = 2
    reweight_rounds: int = 3
    ridge: float = 1e-3
    sample_entities: int | None = None
    windows_per_series: int | None = None

    def with_(self, **changes) -> "PeakConfig":
        return replace(self, **changes)

    def to_dict(self) -> dict:
        out = asdict(self)
        out["channels"] = list(self.channels)
        return out

    @classmethod
    def from_dict(cls, values: dict) -> "PeakConfig":
        """Build from a stored mapping; keys this version does not know are ignored."""
        known = {f.name for f in fields(cls)}
        kept = {k: v for k, v in values.items() if k in known}
        if "channels" in kept:
            kept["channels"] = tuple(kept["channels"])
        return cls(**kept)
