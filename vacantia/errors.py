"""Errors raised when a single request or a table breaks the contract."""

from __future__ import annotations


class RequestError(ValueError):
    """A refused request: a stable ``code`` and the offending ``field``."""

    def __init__(self, code: str, message: str, field: str | None = None):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.field = field


class ContractError(ValueError):
    """A table whose columns or rows do not satisfy the output contract."""
