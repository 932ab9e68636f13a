"""Stack morphometrics on Spark: detections, tracks, audits, reports and tuning as DataFrame jobs."""
