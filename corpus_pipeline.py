"""The corpus pipeline's entry; its stages are in `rastermill.llm.pipeline`."""

from rastermill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
