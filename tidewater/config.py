"""Settings of a walk-forward study. The defaults are those of daily equity bars; the test tables have their own."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

# Quantiles of the standard normal, by probability.
NORMAL_Z = {0.95: 1.6448536269514722, 0.975: 1.959963984540054, 0.99: 2.3263478740408408, 0.995: 2.5758293035489004}
REGIMES = ("calm", "normal", "stressed")
# Pairs of regimes whose rates are compared, in the order of reports.
REGIME_PAIRS = (("normal", "calm"), ("normal", "stressed"), ("calm", "stressed"))


@dataclass(frozen=True)
class Study:
    """One study: dates of the split, regime cut-points, schedule, interval levels, smoothing and resampling."""

    # Settings of the study of daily equity bars.
    train_end: str = "2016-12-30"
    oos_start: str = "2017-01-03"
    calm_max: float = 15.0
    stressed_min: float = 25.0
    refit_every: int = 21
    levels: tuple[float, ...] = (0.90, 0.95, 0.99)
    var_level: float = 0.99
    ewma_lambda: float = 0.94
    fit_scale: float = 100.0
    trailing: int = 21
    block: int = 20
    replicates: int = 1000
    seed: int = 20240101
    min_regime: int = 30

    def __post_init__(self) -> None:
        if self.train_end >= self.oos_start:
            raise ValueError("training must end before the out-of-sample dates begin")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Study:
        """The study that to_json wrote; unknown settings are refused."""
        found = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})

    def differences(self, other: Study, ignore: tuple[str, ...] = ()) -> dict[str, tuple]:
        """Settings that differ; results of two studies can be put together only if there are none."""
        mine, theirs = asdict(self), asdict(other)
        return {k: (mine[k], theirs[k]) for k in mine if k not in ignore and mine[k] != theirs[k]}


#: For series made from the orders table.
ORDERS = Study(train_end="1997-12-31", oos_start="1998-01-01", calm_max=24.0, stressed_min=26.5, fit_scale=1.0, min_regime=5)


def level_key(level: float) -> str:
    """Suffix of a level's columns: 0.95 gives 95, 0.975 gives 975."""
    return f"{level:.4f}"[2:].rstrip("0").ljust(2, "0")


def interval_columns(levels: tuple[float, ...]) -> list[str]:
    return [f"{side}_{level_key(x)}" for x in levels for side in ("lo", "hi")]
