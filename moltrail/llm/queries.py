"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .audit import OP11_SQL, op11_filter_audit
from .decontaminate import op5_decontaminate
from .extraction import op13_html_extraction
from .lm import op8_lm
from .mixing import OP7_SQL, op7_mix_sources
from .periods import op12_periodic_runs
from .pii import OP4_SQL, op4_pii
from .quality import op2_quality
from .rules import op9_rules
from .simhash import op3_simhash
from .suffixes import op1_suffix_dedup
from .tokens import op6_token_counts
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality": op2_quality,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_mix_sources": op7_mix_sources,
    "op8_lm": op8_lm,
    "op9_rules": op9_rules,
    "op10_warc": op10_warc,
    "op11_filter_audit": op11_filter_audit,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_html_extraction": op13_html_extraction,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_pii": OP4_SQL,
    "op7_mix_sources": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
}
