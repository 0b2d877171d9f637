"""Column functions for use in any query."""

from lodestrata.operators.features import shape
from lodestrata.operators.relations import mutual_information
from lodestrata.operators.roles import type_hint
from lodestrata.operators.telemetry import session_class, usability

__all__ = ["mutual_information", "session_class", "shape", "type_hint", "usability"]
