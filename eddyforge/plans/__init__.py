"""Whole plans: cutting periods, running the steps in order, publishing the table."""

from .cut import cut_periods, late_rows, period_bounds
from .run import PERIOD_STEPS, SAMPLE_STEPS, apply_step, first_periods, publish, run, summary, user_step

__all__ = ["PERIOD_STEPS", "SAMPLE_STEPS", "apply_step", "cut_periods", "first_periods", "late_rows", "period_bounds", "publish", "run", "summary", "user_step"]
