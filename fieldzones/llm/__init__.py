"""Operators of a training-data pipeline over ``documents``, ``benchmark``, ``labels`` and
``conversations``.  Importing the package registers one query per operator in ``QUERIES``
(and its DuckDB text, where SQL can express it, in ``ORACLES``)."""

from fieldzones.llm import chat_format, class_lm, decontamination, filter_audit, host_quality, language_id, mixing, near_dedup, period_runs, quality_trees, rare_digest, suffix_dedup, toxicity  # noqa: F401
from fieldzones.llm.registry import ORACLES, QUERIES  # noqa: F401
