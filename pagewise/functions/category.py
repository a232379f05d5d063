"""Category code -> label as a JVM-side CASE expression (no join, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewise.schema import CATEGORY_LABELS, OTHER_LABEL


def category_label(code: Column | str, scheme: str = "kdc") -> Column:
    """CASE code WHEN '000' THEN ... ELSE '기타' END.

    NULL and unknown codes fall to the ELSE branch, as in a searched CASE.
    Ten fixed branches compile into the surrounding whole-stage codegen.
    """
    code = F.col(code) if isinstance(code, str) else code
    labels = CATEGORY_LABELS[scheme]
    expr = None
    for k, v in labels.items():
        expr = F.when(code == F.lit(k), F.lit(v)) if expr is None else expr.when(code == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(OTHER_LABEL))
