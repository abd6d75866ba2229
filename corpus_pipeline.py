"""The corpus pipeline; its stages are in ``editloom.llm.pipeline``."""

from editloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
