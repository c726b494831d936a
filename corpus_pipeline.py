"""The corpus pipeline by the name that the driver looks for; loamgraph.llm.pipeline holds it."""

from loamgraph.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
