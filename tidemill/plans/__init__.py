"""Queries by name. Importing the package registers all of them."""

from tidemill.plans import catalog, matching, preparing, recommending  # noqa: F401
