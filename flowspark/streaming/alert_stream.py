"""Alerts on a stream of scored flows.

The alert rule looks at one row at a time, so the batch operators take a
streaming frame as they are: no state, no watermark, append output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowspark.config import AlertConfig, FlowColumns
from flowspark.operators.alerts import assign_alerts
from flowspark.operators.clean import add_binary_label


def alert_stream(scored: DataFrame, cfg: AlertConfig = AlertConfig(), cols: FlowColumns = FlowColumns()) -> DataFrame:
    """Alert columns, and the label code where the stream is labelled."""
    out = assign_alerts(scored, cfg)
    return add_binary_label(out, cols) if cols.label in out.columns else out
