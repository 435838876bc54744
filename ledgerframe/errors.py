"""Requests that are refused, and conflicts found while writing."""


class NotSupported(ValueError):
    """A request that would silently give a wrong answer, or that can't be carried out."""


class QueryNotSupported(NotSupported):
    pass


class WriteNotSupported(NotSupported):
    pass


class AuditNotSupported(NotSupported):
    pass


class NotConfigured(NotSupported):
    """A capability was used that the session wasn't set up with."""


class WriteFailed(RuntimeError):
    """A write that the store or a constraint rejected; nothing of it is visible."""


class ConcurrencyConflict(WriteFailed):
    """Rows that a write expected aren't there, or another commit came first."""


class ConstraintViolation(WriteFailed):
    pass
