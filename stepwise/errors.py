"""Errors of the engine."""


class ProgressiveError(ValueError):
    """A progressive statement that cannot be parsed, planned or run."""
