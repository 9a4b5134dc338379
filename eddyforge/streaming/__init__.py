"""Periods from streams: a period closes when the watermark passes its end."""

from .periods import period_stream, stateful_periods, stream_counts

__all__ = ["period_stream", "stateful_periods", "stream_counts"]
