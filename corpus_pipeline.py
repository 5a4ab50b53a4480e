"""A training corpus from raw documents: five stages, each one operator of ``flowlake.llm`` (see its module ``pipeline``).

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
``run`` applies them to ``documents``.
"""

from __future__ import annotations

from flowlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
