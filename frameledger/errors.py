"""What can go wrong while a dataset is loaded or checked; the class name is the category in reports."""

from __future__ import annotations


class QualityError(Exception):
    """Any error of this library."""


class DatasetError(QualityError):
    """The dataset could not be loaded."""


class DatasetFormatError(DatasetError):
    """Files or metadata are missing or malformed."""


class DatasetVersionError(DatasetError):
    """The format version is unknown or contradicts the layout."""


class SourceResolutionError(DatasetError):
    """The reference leads to no dataset."""


class ResourceBoundError(DatasetError):
    """A declared or actual size is beyond what is accepted."""


class PathTraversalError(DatasetError):
    """A path from the metadata leads out of the dataset."""


class CheckExecutionError(QualityError):
    """A check could not be carried out."""


class RepairError(QualityError):
    """A repair could not be carried out."""
