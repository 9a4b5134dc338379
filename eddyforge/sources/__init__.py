"""Where samples come from: delimited logger files, frames of one's own, the event table."""

from .delimited import read_samples, sample_errors
from .events import event_samples
from .frame import from_dataframe, to_dataframe
from .timestamps import parse_timestamp

__all__ = ["event_samples", "from_dataframe", "parse_timestamp", "read_samples", "sample_errors", "to_dataframe"]
