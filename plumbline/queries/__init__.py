"""All queries outside the llm subpackage; importing this fills the registry."""

from plumbline.queries import execution, extras, html, ledger, outcomes, pages, scalar, structure  # noqa: F401
from plumbline.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
