"""Settings of every pipeline stage, one frozen dataclass each."""

from __future__ import annotations

from dataclasses import dataclass

# The ordered alert scale.
ALERT_NAMES = {0: "LOW", 1: "MEDIUM", 2: "HIGH", 3: "CRITICAL"}
SUSPICIOUS_LEVELS = ("CRITICAL", "HIGH", "MEDIUM")
CONFIRMED_LEVELS = ("CRITICAL", "HIGH")
BENIGN = "BENIGN"


# The well-known column names and the default cut points below.


@dataclass(frozen=True)
class FlowColumns:
    """Names of the well-known columns of a flow table."""

    sample_id: str = "sample_id"
    source_file: str = "source_file"
    label: str = "Label"
    binary_label: str = "binary_label"
    flow_id: str = "Flow ID"
    src_ip: str = "Source IP"
    dst_ip: str = "Destination IP"
    src_port: str = "Source Port"
    dst_port: str = "Destination Port"
    protocol: str = "Protocol"
    timestamp: str = "Timestamp"
    duration: str = "Flow Duration"

    def protected(self) -> tuple[str, ...]:
        """Columns that are never model features."""
        return (
            self.label, self.binary_label, self.sample_id, self.source_file,
            self.flow_id, self.src_ip, self.dst_ip, self.src_port,
            self.dst_port, self.protocol, self.timestamp,
        )

    def trace(self) -> tuple[str, ...]:
        """Columns carried along for tracing a flow back to its origin."""
        return (
            self.sample_id, self.source_file, self.label, self.binary_label,
            self.flow_id, self.src_ip, self.dst_ip, self.src_port,
            self.dst_port, self.protocol, self.timestamp, self.duration,
        )


def _check_unit_range(owner, *names: str) -> None:
    for name in names:
        value = getattr(owner, name)
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"{name} must lie in [0, 1], got {value}")


@dataclass(frozen=True)
class PrepareConfig:
    columns: FlowColumns = FlowColumns()
    train_ratio: float = 0.7
    val_ratio: float = 0.15
    seed: int = 42
    on_all_null: str = "keep"  # or "drop_column": leave out features without any number

    def __post_init__(self) -> None:
        _check_unit_range(self, "train_ratio", "val_ratio")
        if self.on_all_null not in ("keep", "drop_column"):
            raise ValueError("on_all_null must be 'keep' or 'drop_column'")


@dataclass(frozen=True)
class SupervisedConfig:
    columns: FlowColumns = FlowColumns()
    num_trees: int = 400
    max_depth: int | None = None  # none: until the leaves are pure
    node_rows: int = 1 << 17  # draws that a node may have to be grown in one task
    max_bins: int = 256  # of nodes with more
    boost_rounds: int = 400
    boost_depth: int = 8
    boost_step: float = 0.08
    boost_subsample: float = 0.85
    boost_features: float = 0.85
    boost_bins: int = 256
    boost_ridge: float = 1.0
    boost_child_weight: float = 1.0
    boost_store: int = 10  # rounds after which the rows' margins are written
    precision_target: float = 0.995
    recall_target: float = 0.995
    ip_ratio: float = 0.5
    seed: int = 42

    def __post_init__(self) -> None:
        _check_unit_range(self, "precision_target", "recall_target", "ip_ratio")


@dataclass(frozen=True)
class UnsupervisedConfig:
    columns: FlowColumns = FlowColumns()
    mi_top_k: int = 50
    mi_estimator: str = "knn"  # or "binned"
    mi_neighbours: int = 3
    pca_variance: float = 0.95
    iforest_trees: int = 300
    iforest_sample: int = 256
    bottleneck: int = 20
    hidden_layers: int = 3
    dropout: float = 0.15
    epochs: int = 80
    batch_rows: int = 2048
    sync_batches: int = 1  # batches whose mean gradient moves the weights once
    learning_rate: float = 1e-3
    weight_decay: float = 1e-5
    patience: int = 10
    vae_beta: float = 0.5
    default_percentile: float = 99.0
    precision_target: float = 0.995
    recall_target: float = 0.995
    seed: int = 42

    def __post_init__(self) -> None:
        _check_unit_range(self, "precision_target", "recall_target", "pca_variance")
        if self.mi_estimator not in ("knn", "binned"):
            raise ValueError("mi_estimator must be 'knn' or 'binned'")


@dataclass(frozen=True)
class AlertConfig:
    """Cut points of the four-level alert rule and the fusion weights."""

    theta_rf: float = 0.5
    theta_gray: float = 0.15
    theta_unsup_high: float = 0.5
    theta_unsup_extreme: float = 0.85
    unsup_weights: tuple[float, float, float] = (1 / 3, 1 / 3, 1 / 3)
    medium_min_attack_ratio: float = 0.30
    risk_rf: float = 0.85
    risk_unsup: float = 0.15


@dataclass(frozen=True)
class TraceConfig:
    columns: FlowColumns = FlowColumns()
    attacker_ratio: float = 0.10
    suspect_ratio: float = 0.001
    w_attack_ratio: float = 0.35
    w_centrality: float = 0.20
    w_risk: float = 0.25
    w_severity: float = 0.20
    damping: float = 0.85
    tolerance: float = 1e-6
    max_rounds: int = 100
    hot_degree: int = 1_000_000  # out-edges per source above which its edges are salted
    rounds_per_write: int = 6  # rank rounds run as one job
    graph_parts: int | None = None  # partitions of the rank iteration; none: spark.sql.shuffle.partitions
    on_unsettled: str = "warn"  # or "error": ranks that still change after max_rounds
    timeline_sources: int = 20
    max_edges: int = 500
    top_targets: int = 10
