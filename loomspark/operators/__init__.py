"""Operators of the engine; the registry comes first, as each module puts its queries there."""

from . import registry  # noqa: F401
