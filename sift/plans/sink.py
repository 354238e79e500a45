"""Alerts as text files that read like the printed report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sift.operators.routing import alert_lines, in_printing_order
from sift.params import Thresholds


def write_alerts(routed: DataFrame, thresholds: Thresholds, path: str, batch_id: int) -> None:
    """Write ``<path>/batch_id=N/section=S/part-*``.

    Read section by section and file by file, the text is the report in order.
    Running it again replaces the batch's own folder only.
    """
    lines = in_printing_order(alert_lines(routed, thresholds))
    writer = lines.select("section", "text").write.mode("overwrite")
    writer.partitionBy("section").text(f"{path}/batch_id={batch_id}")
