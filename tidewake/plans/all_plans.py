"""Import this to have every query in the catalogue."""

from tidewake.plans import checks, lookup  # noqa: F401
