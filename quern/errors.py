"""Errors that callers can tell apart."""


class PipelineError(ValueError):
    """The text is no aggregation pipeline, or a stage can't be compiled."""


class ForbiddenOperator(PipelineError):
    """The pipeline writes, or isn't deterministic."""
