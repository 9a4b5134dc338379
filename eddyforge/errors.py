"""Errors that name what to mend."""

from __future__ import annotations


class EddyError(Exception):
    """Base of all errors raised on purpose."""


class ConfigError(EddyError):
    """A configuration that is incomplete, contradictory or not understood."""


class ReadError(EddyError):
    """Input that can't be read as declared; names file, line and column where it can."""


class StepError(EddyError):
    """A step that got a frame without the columns it needs."""
