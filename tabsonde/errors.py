"""Errors a caller can act on."""


class InputError(ValueError):
    """The input cannot be analysed (no rows, no columns, unsupported format)."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


class AnalysisError(ValueError):
    """A request that does not fit the data (unknown column, wrong type, empty subset)."""
