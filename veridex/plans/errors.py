"""What can go wrong, each as an exception of its own."""

from __future__ import annotations


class SemanticError(Exception):
    """Any refusal of the semantic layer."""


class ModelError(SemanticError):
    """The model isn't valid."""


class RuleViolation(SemanticError):
    """The query breaks a semantic rule."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"{rule}: {message}")
        self.rule = rule


class FieldNotFound(SemanticError):
    """A column that no dataset in scope has."""


class DatasetNotFound(SemanticError):
    """A table that is neither a dataset nor a CTE."""


class AmbiguousMetric(SemanticError):
    """A metric whose dataset is in scope more than once, or whose column has several owners."""


class JoinPathError(SemanticError):
    """No path between two datasets, or more than one."""


class QueryNotAllowed(SemanticError):
    """A statement that isn't a query."""


class GraphError(SemanticError):
    """A mapping or graph that isn't valid."""
