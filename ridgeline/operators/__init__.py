"""Operators on detections and tracks."""
