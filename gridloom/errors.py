"""Errors that callers can tell apart."""


class StoreError(Exception):
    """Base of all errors of this library."""


class NotFound(StoreError):
    pass


class InvalidParameter(StoreError, ValueError):
    """A caller's mistake."""


class DuplicateTimeSeries(StoreError):
    pass


class DuplicateAssociation(StoreError):
    pass


class IntegrityError(StoreError):
    """Stored rows contradict each other."""


class IncompatibleFormat(StoreError):
    pass


class MismatchedArtifact(StoreError):
    pass


class StoreExists(StoreError):
    pass


class ReadOnlyStore(StoreError):
    pass
