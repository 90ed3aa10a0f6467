"""Errors of the catalog. Those about a missing or existing name are KeyErrors too."""


class CatalogError(Exception):
    """Any error of the catalog."""

    def __str__(self) -> str:
        return Exception.__str__(self)


class NameTaken(CatalogError, KeyError):
    """The name is in use."""


class NameMissing(CatalogError, KeyError):
    """There is nothing of this name."""


class DatasetError(CatalogError, KeyError):
    """Any error about a dataset's name."""


class DatasetAlreadyExists(DatasetError, NameTaken):
    """A dataset of this name exists."""


class DatasetNotFound(DatasetError, NameMissing):
    """No dataset of this name."""


class ViewError(CatalogError, KeyError):
    """Any error about a view's name."""


class ViewAlreadyExists(ViewError, NameTaken):
    """A view of this name exists."""


class ViewNotFound(ViewError, NameMissing):
    """No view of this name."""


class CollectionAlreadyExists(NameTaken):
    """A collection of this name exists."""


class CommitConflict(CatalogError):
    """Another writer committed first."""
