"""Frozen models over streams: scores as rows pass, stability by window of event time."""

from .monitor import psi_counts, psi_of_counts, scored

__all__ = ["psi_counts", "psi_of_counts", "scored"]
