"""What can go wrong, by name."""


class NotFound(KeyError):
    """No live version of the key. `source` names where the newest version, a tombstone, was found, if any."""

    def __init__(self, key: str, source: str | None = None) -> None:
        super().__init__(key)
        self.key, self.source = key, source


class InvalidRange(ValueError):
    """start lies above end."""


class MemtableFull(RuntimeError):
    """Records were refused because the delta would outgrow its limit."""


class StillReferenced(RuntimeError):
    """A delta can't be dropped while a snapshot reads it."""


class NoRecords(RuntimeError):
    """There is nothing to write."""


class IndexNotFound(KeyError):
    """A segment has no index."""


class FilterNotFound(KeyError):
    """A segment has no filter."""


class Conflict(RuntimeError):
    """Another writer changed the manifest first, or a segment to be removed isn't in it."""


class Cancelled(RuntimeError):
    """A deadline passed, or another thread cancelled what ran."""
