"""What can go wrong, by kind."""


class LarkspurError(Exception):
    """Base of all errors of this library."""


class StoreError(LarkspurError):
    """The snapshot store can't do what is asked, or another writer was faster."""


class ReadOnly(StoreError):
    """A write in a read-only transaction."""


class NotFound(LarkspurError):
    """A thing that is named isn't there."""


class CollectionNotFound(NotFound):
    """No such collection."""


class DuplicateKey(LarkspurError):
    """An insert of a primary key that a live document has."""


class InvalidQuery(LarkspurError):
    """A filter, update or option that can't be understood."""


class InvalidKey(LarkspurError):
    """A primary key of a type that can't be one, or a path that can't hold one."""


class InvalidDocument(LarkspurError):
    """A document, or a change to it, that its types don't allow."""


class IndexExists(LarkspurError):
    """An index hint that is there already."""


class FunctionExists(LarkspurError):
    """A hook or function of that name is registered already."""


class HookError(LarkspurError):
    """A trigger failed, or a validator rejected a document."""
