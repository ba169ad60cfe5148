"""Errors of the engine; all derive from SkeinError."""


class SkeinError(Exception):
    pass


class ConfigError(SkeinError, ValueError):
    pass


class SchemaError(SkeinError, ValueError):
    pass


class NotFoundError(SkeinError, KeyError):
    pass


class ConflictError(SkeinError):
    pass


class TransactionError(SkeinError):
    pass


class CorruptionError(SkeinError):
    pass


class QueryError(SkeinError, ValueError):
    pass
