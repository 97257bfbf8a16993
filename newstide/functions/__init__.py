"""SQL expressions of the engine's rules.

Every function takes column names or expressions as text and returns an expression as text, for
``selectExpr``, ``where`` or ``F.expr``. They compose before Spark sees them, so a plan with
dozens of derived columns is handed over in one piece, and all of them run inside the JVM.
"""


def literal(value: str) -> str:
    """``value`` as a Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
