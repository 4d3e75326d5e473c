"""Fixed values of the metric families; a recalibration changes data here and no plan."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # fixed values: keypoints and zones
    kp_conf: float = 0.35
    ankle_conf: float = 0.3
    wrist_pad: float = 0.015
    glove_extension: float = 0.35
    stomach_top: float = 0.25
    # fixed values: feet and scale
    upright: float = 0.7
    scale_torso: float = 2.2
    scale_shoulders: float = 2.6
    # fixed values: smoothing
    euro_min_cutoff: float = 1.0
    euro_beta: float = 0.40
    euro_d_cutoff: float = 1.0
    # fixed values: box tracking, in pixels (places, then speeds)
    kalman_noise: tuple = (25.0, 25.0, 100.0, 100.0)
    kalman_drift: tuple = (9.0, 9.0, 4.0, 4.0, 16.0, 16.0, 4.0, 4.0)
    kalman_start: tuple = (100.0, 100.0, 100.0, 100.0, 500.0, 500.0, 100.0, 100.0)
    least_box: float = 10.0
    damp_after: int = 3
    damping: float = 0.85
    coast_fade: float = 0.20
    # fixed values: punches
    punch_extension: float = 0.55
    punch_accel: float = 0.075
    punch_score: float = 0.070
    punch_separation_s: float = 0.18
    punch_direction_floor: float = 0.70
    punch_bbox_height: float = 0.70
    punch_zoom_cap: float = 2.5
    landed_extension: float = 0.50
    landed_clinch_iou: float = 0.55
    # fixed values: states and aggression
    clinch_iou: float = 0.40
    close_distance: float = 0.50
    occluded_fraction: float = 0.40
    decay_tau_s: float = 2.5
    advance_eps: float = 0.005
    aggression_open: tuple = (0.60, 0.30, 0.10)
    aggression_close: tuple = (0.50, 0.30, 0.20)
    aggression_clinch: tuple = (0.60, 0.20, 0.20)
    norm_punch: float = 0.20
    norm_wrist: float = 0.05
    norm_push: float = 0.02
    norm_head: float = 0.015
    # fixed values: defence
    defence_weights: tuple = (0.40, 0.25, 0.25, 0.10)
    defence_before: int = 2
    defence_after: int = 6
    defence_near: float = 1.3
    defence_far: float = 2.2
    defence_head_norm: float = 0.02
    defence_counter_norm: float = 0.04
    # fixed values: confidence tiers and visibility
    tier_weights: dict = field(default_factory=lambda: {"high": 1.0, "medium": 0.7, "low": 0.4, "none": 0.0})
    tier_limits: tuple = (("high", 0.75), ("medium", 0.40), ("low", 0.15))
    visibility_knee: float = 0.75
    # fixed values: second metric family
    v2_weights: tuple = (0.30, 0.70)
    v2_threshold: float = 1.10
    v2_accel_floor: float = 0.03
    v2_dedup_s: float = 0.35
    v2_guard_slack: float = 0.08
    v2_advance: float = 0.003
    v2_window_s: float = 1.5
    v2_move: float = 0.005
    v2_guard_mix: tuple = (0.70, 0.30)
    v2_ring_weights: tuple = (0.60, 0.25, 0.15)
    v2_control_weights: tuple = (0.35, 0.35, 0.20, 0.10)
    ropes: tuple = (0.18, 0.82)


DEFAULT = Config()

#: Order of the 17 keypoints of a pose.
NOSE, EYE_L, EYE_R, EAR_L, EAR_R, SHOULDER_L, SHOULDER_R, ELBOW_L, ELBOW_R, WRIST_L, WRIST_R, HIP_L, HIP_R, KNEE_L, KNEE_R, ANKLE_L, ANKLE_R = range(17)
