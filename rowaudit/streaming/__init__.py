"""Streaming use of the stateless checks and frozen detectors."""

from rowaudit.streaming.gate import gate_stream, score_batches  # noqa: F401
