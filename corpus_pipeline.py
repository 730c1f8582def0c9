"""The training-data pipeline; its stages are in trailknit.llm.pipeline."""

from trailknit.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
