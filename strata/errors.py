"""One exception class for each failure a store reports."""


class StoreError(Exception):
    """Base of every error below."""


class NotFoundError(StoreError):
    """The key has no live value."""


class ClosedError(StoreError):
    """The store, snapshot or cursor has been closed."""


class LockedError(StoreError):
    """Another process holds the store's lease."""


class CorruptionError(StoreError):
    """Stored data contradicts the manifest or can't be decoded."""


class StoreFailedError(StoreError):
    """An earlier commit or maintenance failure made the store read-only."""


class InvalidKeyError(StoreError):
    """A key is empty, null or longer than the limit."""


class InvalidValueError(StoreError):
    """A value is longer than the limit."""


class InvalidOrdinalError(StoreError):
    """A frame's ordinal is null or stands twice: the order of its rows isn't given."""


class BatchTooLargeError(StoreError):
    """A batch has too many entries or bytes."""


class OpenHandlesError(StoreError):
    """close() was called while snapshots or cursors are open."""


class ConflictError(StoreError):
    """Another writer installed the manifest version first."""
