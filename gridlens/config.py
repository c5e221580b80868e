"""Settings and fixed lookup values shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Thresholds of a fleet. Pass a changed copy (``dataclasses.replace``) to any operator.

    ``tree_rows`` bounds the rows that a tree of the random forest draws, ``labelled_rows`` the labelled rows that
    models are trained on altogether, drawn by a hash evenly from all labels.
    """

    # fixed values: the defaults on which results depend
    voltage_nominal: float = 230.0
    voltage_high: float = 250.0
    voltage_low: float = 200.0
    current_max: float = 15.0
    power_max: float = 3000.0
    cost_per_kwh: float = 6.50
    currency: str = "₹"
    assumed_power_factor: float = 0.92
    contamination: float = 0.05
    window: int = 30
    sensitivity: float = 0.7
    lookback: int = 60
    horizon: int = 15
    trees: int = 200
    tree_depth: int = 15
    tree_rows: int = 100_000
    labelled_rows: int = 2_000_000
    test_share: float = 0.2
    health_weights: dict = field(
        default_factory=lambda: {
            "voltage_stability": 0.25,
            "current_safety": 0.20,
            "power_efficiency": 0.20,
            "anomaly_rate": 0.15,
            "power_factor": 0.10,
            "energy_trend": 0.10,
        }
    )


DEFAULTS = Settings()

# Fault ids, their names and severities.
FAULT_NAMES = {
    0: "Normal",
    1: "Overvoltage",
    2: "Undervoltage",
    3: "Overcurrent",
    4: "Overload",
    5: "Voltage Sag",
    6: "Voltage Swell",
    7: "Power Factor Issue",
    8: "Harmonic Distortion",
    9: "Phase Imbalance",
}
FAULT_SEVERITY = {
    "Normal": 0,
    "Voltage Sag": 1,
    "Power Factor Issue": 1,
    "Voltage Swell": 2,
    "Harmonic Distortion": 2,
    "Phase Imbalance": 3,
    "Overvoltage": 3,
    "Undervoltage": 3,
    "Overcurrent": 4,
    "Overload": 5,
}

# Health bands (lowest score, label, colour) and the three-colour variant.
HEALTH_BANDS = [
    (90.0, "Excellent", "#22c55e"),
    (75.0, "Good", "#34d399"),
    (60.0, "Fair", "#eab308"),
    (40.0, "Poor", "#f97316"),
]
HEALTH_FLOOR = ("Critical", "#ef4444")
HEALTH_COLORS3 = [(85.0, "#22c55e"), (60.0, "#eab308")]
HEALTH_COLORS3_FLOOR = "#ef4444"

# Calibration of the analogue front end.
ADC_VOLTS_PER_STEP = 3.3 / 4095.0
ADC_NOISE_VOLTS = 0.05
ADC_PEAK_TO_RMS = 0.707
ADC_CURRENT_GAIN = 20.61
ADC_VOLTAGE_GAIN = 462.32

# Accepted range of each incoming field.
FIELD_RANGES = {
    "voltage": (0.0, 500.0),
    "current": (0.0, 100.0),
    "power": (0.0, 50000.0),
    "energy_kwh": (0.0, 1e6),
    "score": (0.0, 1.0),
    "fault_id": (0.0, 9.0),
    "confidence": (0.0, 1.0),
    "health": (0.0, 100.0),
}
# Accepted range of each setting.
SETTING_RANGES = {
    "cost_per_kwh": (0.01, 100.0),
    "voltage_high": (100.0, 500.0),
    "voltage_low": (50.0, 400.0),
    "current_max": (1.0, 100.0),
    "power_max": (100.0, 50000.0),
}

SIGNALS = ("voltage", "current", "power")
KEYS = ("device_id",)
ORDER = ("ts", "seq")
