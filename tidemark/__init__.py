"""Versioned Parquet datasets with column statistics on Spark."""

from tidemark.errors import (
    CatalogError,
    CollectionAlreadyExists,
    CommitConflict,
    DatasetAlreadyExists,
    DatasetError,
    DatasetNotFound,
    ViewAlreadyExists,
    ViewError,
    ViewNotFound,
)
from tidemark.functions.distogram import Distogram
from tidemark.operators.catalog import Catalog, Metastore, View
from tidemark.operators.compact import Compactor, Plan, Policy
from tidemark.operators.dataset import Dataset, Snapshot

__all__ = [
    "Catalog",
    "CatalogError",
    "CollectionAlreadyExists",
    "CommitConflict",
    "Compactor",
    "Dataset",
    "DatasetAlreadyExists",
    "DatasetError",
    "DatasetNotFound",
    "Distogram",
    "Metastore",
    "Plan",
    "Policy",
    "Snapshot",
    "View",
    "ViewAlreadyExists",
    "ViewError",
    "ViewNotFound",
]
