"""Photovoltaic telemetry analytics expressed as Spark DataFrame transforms."""
