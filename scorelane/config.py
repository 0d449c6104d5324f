"""Settings of the scoring engine."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

DIMS = 14
TRUE_WORDS = frozenset({"1", "true", "yes", "on"})

# Risk by merchant category code, and the limits that features are divided by.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}


def _whole(text: str | None, default: int) -> int:
    return int(text) if text is not None and text.isascii() and text.isdigit() else default


@dataclass(frozen=True)
class Limits:
    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0


@dataclass(frozen=True)
class Config:
    limits: Limits = field(default_factory=Limits)
    mcc_risk: Mapping[str, float] = field(default_factory=lambda: dict(MCC_RISK))
    default_risk: float = 0.5
    k: int = 5
    deny_from: int = 3  # as many frauds among k deny
    use_ivf: bool = True
    nprobe: int = 16
    most_probes: int = 64
    dataset_path: str = ""
    port: int = 9000
    socket_path: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        use = env.get("USE_IVF")
        return cls(
            use_ivf=True if use is None else use.lower() in TRUE_WORDS,
            nprobe=_whole(env.get("NPROBE"), 16),
            dataset_path=env.get("DATASET_PATH", ""),
            port=_whole(env.get("PORT"), 9000),
            socket_path=env.get("SOCKET_PATH", ""),
        )


    @classmethod
    def from_files(cls, mcc_risk: str, limits: str, **more: object) -> Config:
        """With the risks and limits of two JSON files: an object of risks by category code, and one of the limits by name. A limit that
        the file lacks is an error, as is a risk that is no number."""
        with open(mcc_risk, encoding="utf-8") as file:
            risks = {str(k): float(v) for k, v in json.load(file).items()}
        with open(limits, encoding="utf-8") as file:
            found = json.load(file)
        return cls(limits=Limits(**{f.name: float(found[f.name]) for f in fields(Limits)}), mcc_risk=risks, **more)


@dataclass(frozen=True)
class BuildConfig:
    dtype: str = "f16"
    nlist: int = 1024
    max_iter: int = 30
    tol: float = 0.0005
    seed: int = 42

    def __post_init__(self) -> None:
        if self.dtype not in ("f16", "f32"):
            raise ValueError(f"unknown dtype {self.dtype!r}: f16 or f32")
        if self.nlist < 0 or self.max_iter < 0:
            raise ValueError("nlist and max_iter can't be negative")
