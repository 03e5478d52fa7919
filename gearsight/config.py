"""Frozen configuration shared by every operator.

All numbers below are fixed values that results depend on; they are kept
together, in natural order, so a reader can check them at a glance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: sensor catalogue (baseline, normal low, normal high) ---
SENSOR_CATALOG: dict[str, tuple[float, float, float]] = {
    "temperature": (65.0, 40.0, 90.0),
    "vibration_x": (0.5, 0.1, 2.0),
    "vibration_y": (0.5, 0.1, 2.0),
    "vibration_z": (0.3, 0.1, 1.5),
    "pressure": (2.5, 1.0, 4.0),
    "rotation_speed": (1800.0, 1500.0, 2100.0),
    "current": (15.0, 10.0, 25.0),
    "voltage": (220.0, 200.0, 240.0),
    "power_factor": (0.95, 0.8, 1.0),
    "noise_level": (45.0, 35.0, 65.0),
}

# --- fixed values: sensor-fault limits (inclusive normal interval) ---
# a sensor name equal to the key, or starting with it for "vibration", is checked
FAULT_LIMITS: dict[str, tuple[float, float]] = {
    "temperature": (0.0, 150.0),
    "vibration": (0.0, 10.0),
    "pressure": (0.0, 10.0),
    "current": (0.0, 50.0),
}

# --- fixed values: robot tag map (tag name -> sensor name), 29 entries ---
ROBOT_TAG_MAP: dict[str, str] = {
    "::[scararobot]Ax_J1.ActualPosition": "joint1_actual_pos",
    "::[scararobot]Ax_J1.PositionCommand": "joint1_cmd_pos",
    "::[scararobot]Ax_J1.PositionError": "joint1_pos_error",
    "::[scararobot]Ax_J1.TorqueCommand": "joint1_torque_cmd",
    "::[scararobot]Ax_J1.TorqueFeedback": "joint1_torque_feedback",
    "::[scararobot]Ax_J2.ActualPosition": "joint2_actual_pos",
    "::[scararobot]Ax_J2.PositionCommand": "joint2_cmd_pos",
    "::[scararobot]Ax_J2.PositionError": "joint2_pos_error",
    "::[scararobot]Ax_J2.TorqueCommand": "joint2_torque_cmd",
    "::[scararobot]Ax_J2.TorqueFeedback": "joint2_torque_feedback",
    "::[scararobot]Ax_J3.ActualPosition": "joint3_actual_pos",
    "::[scararobot]Ax_J3.PositionCommand": "joint3_cmd_pos",
    "::[scararobot]Ax_J3.PositionError": "joint3_pos_error",
    "::[scararobot]Ax_J3.TorqueCommand": "joint3_torque_cmd",
    "::[scararobot]Ax_J3.TorqueFeedback": "joint3_torque_feedback",
    "::[scararobot]Ax_J6.ActualPosition": "joint6_actual_pos",
    "::[scararobot]Ax_J6.PositionCommand": "joint6_cmd_pos",
    "::[scararobot]Ax_J6.PositionError": "joint6_pos_error",
    "::[scararobot]Ax_J6.TorqueCommand": "joint6_torque_cmd",
    "::[scararobot]Ax_J6.TorqueFeedback": "joint6_torque_feedback",
    "::[scararobot]CS_Cartesian.ActualPosition[0]": "cartesian_x",
    "::[scararobot]CS_Cartesian.ActualPosition[1]": "cartesian_y",
    "::[scararobot]CS_Cartesian.ActualPosition[2]": "cartesian_z",
    "::[scararobot]CS_Cartesian.ActualPosition[3]": "cartesian_rx",
    "::[scararobot]CS_Cartesian.ActualPosition[4]": "cartesian_ry",
    "::[scararobot]CS_Cartesian.ActualPosition[5]": "cartesian_rz",
    "::[scararobot]CS_SCARA.ActualPosition[0]": "scara_x",
    "::[scararobot]CS_SCARA.ActualPosition[1]": "scara_y",
    "::[scararobot]CS_SCARA.ActualPosition[2]": "scara_z",
}

# --- fixed values: tag pattern groups (case-insensitive substrings) ---
TAG_PATTERNS: tuple[str, ...] = (
    "scararobot", "position", "velocity", "torque", "error", "actual", "command",
)

# --- fixed values: alert priorities, severity order (0 = most severe) ---
PRIORITIES: tuple[str, ...] = ("critical", "high", "medium", "low")

# --- fixed values: alert types ---
ALERT_TYPES: tuple[str, ...] = (
    "health_low", "anomaly_high", "prediction_high", "sensor_fault",
    "maintenance_due", "system_error", "connection_lost",
)

# --- fixed values: advice text per prediction risk level ---
RISK_ADVICE: dict[str, str] = {
    "low": "normal operation; keep the regular schedule",
    "medium": "watch closely; plan an inspection",
    "high": "maintenance needed soon",
}


@dataclass(frozen=True)
class Thresholds:
    # generic status (>= cut): normal >= 70, warning >= 30
    health_normal: float = 70.0
    health_warning: float = 30.0
    # alert rules
    health_alert: float = 70.0
    health_critical_alert: float = 30.0
    anomaly_alert: float = 0.7
    cooldown_minutes: int = 15
    critical_cooldown_minutes: int = 5
    # stream threshold alert
    stream_anomaly: float = 0.7
    stream_anomaly_high: float = 0.9
    stream_health_critical: float = 30.0
    # prediction
    maintenance_threshold: float = 0.5
    risk_low: float = 0.3
    risk_medium: float = 0.7


@dataclass(frozen=True)
class ModelSettings:
    sequence_length: int = 60
    prediction_horizon: int = 10
    rolling_windows: tuple[int, ...] = (5, 15)
    validation_split: float = 0.2
    seed: int = 42
    max_features: int = 50
    classifier: str = "logistic"            # or "tree": gradient-boosted trees
    tree_rounds: int = 20
    tree_depth: int = 4


@dataclass(frozen=True)
class Settings:
    thresholds: Thresholds = field(default_factory=Thresholds)
    model: ModelSettings = field(default_factory=ModelSettings)
    buffer_size: int = 1000
    stream_buffer_size: int = 100
    history_size: int = 1000
    rolling_windows: tuple[int, ...] = (5, 15, 30)
    robot_rolling_windows: tuple[int, ...] = (5, 10, 20)


DEFAULT = Settings()
