"""The corpus pipeline, five stages from raw documents to shards; see palimpsest/llm/pipeline.py."""

from palimpsest.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
