"""The corpus pipeline; its stages are in sparkreel.llm.pipeline."""

from sparkreel.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
