"""Errors of the engine."""


class EngineError(Exception):
    """Base of all errors that the engine raises itself."""


class IoError(EngineError):
    """A file or directory is missing, exists already or can't be written."""


class SchemaError(EngineError):
    """A schema is not valid, or rows don't fit it."""


class DataError(EngineError):
    """Stored or given values are not valid."""
