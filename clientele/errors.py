"""The one exception type raised for problems a caller can fix in data or settings."""


class DataProblem(ValueError):
    """Raised when a table, a column choice or a setting cannot support the analysis."""
