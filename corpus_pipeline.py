"""The corpus pipeline; its stages are in folioforge.llm.pipeline."""

from folioforge.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
