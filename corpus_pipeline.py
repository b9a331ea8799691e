"""The corpus pipeline of the training-data subpackage: STAGES, run() and ORACLE_SQL."""

from kinema.llm.pipeline import ORACLE_SQL, STAGES, best_fit_packing, decontamination, line_dedup, near_dedup, quality_rules, run

__all__ = ["ORACLE_SQL", "STAGES", "best_fit_packing", "decontamination", "line_dedup", "near_dedup", "quality_rules", "run"]
