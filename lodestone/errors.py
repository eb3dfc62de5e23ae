"""Exceptions."""


class LodestoneError(Exception):
    """Anything the index refuses."""


class DimensionMismatchError(LodestoneError, ValueError):
    """A vector or query of another length than the index has."""


class InvalidPathError(LodestoneError):
    """A path that holds something else, or is no path."""


class IndexNotFoundError(LodestoneError):
    """No index where one was asked for."""


class IndexLockedError(LodestoneError):
    """Another writer has the index open."""


class CorruptIndexError(LodestoneError):
    """Fewer vectors on disk than the manifest commits to."""


class OutOfBoundsError(LodestoneError, IndexError):
    """A vector id that is not committed."""
