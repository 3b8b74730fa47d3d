"""Sources and sinks; the registry of queries comes first, as each module puts its own there."""

from ..operators import registry  # noqa: F401
