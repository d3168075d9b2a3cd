"""The engine's functions in SQL: one call registers them in a session.

Scalar functions are SQL functions made of the same column expressions that the operators use (`grid_ridge(e1, e2)` and so on): Spark puts
their body into the query's plan, so they are optimised and compiled like any expression. Captures are decoded by table
functions, for use with LATERAL: decode_capture(path, content) gives the report rows, capture_notes(path, content) the diagnostics.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tactigrid.functions import matrices
from tactigrid.operators import components, distance
from tactigrid.session import ship_package
from tactigrid.sources import capture

#: Name: the arguments (doubles), and what the function is of them.
_SCALARS = {
    "grid_det": ("xx xy yy", matrices.det),
    "grid_trace": ("xx yy", matrices.trace),
    "grid_eigenvalue_1": ("xx xy yy", lambda *m: matrices.eigenvalues(*m)[0]),
    "grid_eigenvalue_2": ("xx xy yy", lambda *m: matrices.eigenvalues(*m)[1]),
    "grid_inverse": ("xx xy yy", matrices.inverse),
    "grid_ridge": ("e1 e2", matrices.ridge),
    "grid_coherence": ("e1 e2", matrices.coherence),
    "grid_rotation": ("e1 e2", matrices.rotation_norm),
    "grid_gaussian": ("xx xy yy x y", matrices.gaussian_like),
    "grid_component_score": ("size incoherence maximas", components.score),
    "grid_contact_cost": ("ridge e1 e2", distance.contact_cost),
    "grid_soft_mask": ("inside outside", distance.soft_mask),
}


def _body(spark: SparkSession, arguments: list[str], expression: Column) -> tuple[str, str]:
    """SQL and type of an expression of the arguments."""
    given = spark.range(0).select(*(F.lit(None).cast("double").alias(a) for a in arguments)).select(expression.alias("result_"))
    resolved = given._jdf.queryExecution().analyzed().expressions().head()
    return resolved.child().sql(), given.schema["result_"].dataType.simpleString()


class _Decode:
    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        for r in capture.walk(bytes(content)) if content is not None else ():
            if r[0] == "report":
                yield r[1:]


class _Notes:
    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        lost = ("note", 0, capture.LEVELS["ERR"], "data", None, "nothing was read")
        for r in capture.walk(bytes(content)) if content is not None else [lost]:
            if r[0] == "note":
                yield r[1:]


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session; their names."""
    ship_package(spark)
    for name, (arguments, function) in _SCALARS.items():
        names = arguments.split()
        body, kind = _body(spark, names, function(*map(F.col, names)))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} DOUBLE' for a in names)}) RETURNS {kind} RETURN {body}")
    tables = {
        "decode_capture": udtf(_Decode, returnType="pos bigint, buffer bigint, counter bigint, frame_index int, frame_type int, report_type int, payload binary"),
        "capture_notes": udtf(_Notes, returnType="pos bigint, level int, kind string, type int, message string"),
    }
    for name, function in tables.items():
        spark.udtf.register(name, function)
    return [*_SCALARS, *tables]
