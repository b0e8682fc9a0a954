"""Spark operators for preparing and scoring text datasets and tracking run state."""

__version__ = "0.1.0"
