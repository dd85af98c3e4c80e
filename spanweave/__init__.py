"""Spark-native span-annotation analytics.

DataFrame-in / DataFrame-out operators for annotating free-text notes with
character spans: parsing model output, locating spans, majority voting,
scoring, sampling, retrieval, prompt tables and run telemetry.
"""

__version__ = "0.1.0"
