"""Plans that chain operators: the scorecard pipeline and the monitoring report."""

from .pipeline import ScorecardPipeline
from .report import Report

__all__ = ["Report", "ScorecardPipeline"]
