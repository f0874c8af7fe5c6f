"""The query catalogue, dry runs and releases."""

from . import catalogue, more  # noqa: F401  more adds its queries to the catalogue
