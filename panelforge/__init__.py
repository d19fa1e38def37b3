"""panelforge: point-in-time panel analytics as set-based Spark DataFrame operators."""
