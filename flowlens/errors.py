"""Exceptions raised by the package."""


class FlowlensError(Exception):
    """Base class of every error raised here."""


class ParsingError(FlowlensError):
    """A log could not be read in the requested format."""


class ValidationError(FlowlensError):
    """A table failed its checks; ``errors`` holds the messages."""

    def __init__(self, message, errors=()):
        super().__init__(message)
        self.errors = list(errors)


class FeatureError(FlowlensError):
    """A feature request that the input columns cannot satisfy."""


class ModelError(FlowlensError):
    """A model operation that is unsupported or lacks a fitted model."""
