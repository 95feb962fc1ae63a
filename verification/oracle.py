"""SQL counterparts of the registered queries."""

from verification.sql import s_claims, s_records, s_retrieval, s_structure, s_text  # noqa: F401
from verification.sql import base

# Put together once every part is known.
ORACLE = {name: base.with_parts(sql) for name, sql in base.ORACLE.items()}

__all__ = ["ORACLE"]
