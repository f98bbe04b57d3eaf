"""Errors of the table layer. Mutations turn the first two kinds into a failed JobResult."""


class TableError(Exception):
    """Base of all errors here."""


class ConflictError(TableError):
    """The branch has been modified since the change began."""


class PrimaryKeyExistError(TableError):
    """A key to insert exists already, or twice in the input."""


class UserInputError(TableError, ValueError):
    """An argument that can't be used."""


class VersionNotFoundError(TableError):
    """No such snapshot, tag or branch."""


class StorageExistError(TableError):
    """The location holds a table already."""


class StorageNotFoundError(TableError, FileNotFoundError):
    """The location holds no table."""
