"""Spark-native intrusion analytics on network-flow tables."""

from flowspark.config import (
    AlertConfig,
    FlowColumns,
    PrepareConfig,
    SupervisedConfig,
    TraceConfig,
    UnsupervisedConfig,
)

__all__ = [
    "AlertConfig",
    "FlowColumns",
    "PrepareConfig",
    "SupervisedConfig",
    "TraceConfig",
    "UnsupervisedConfig",
]
