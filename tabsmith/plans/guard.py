"""What a query text may do, read off its analysed plan.

Analysis resolves every name, however it was spelled, and runs nothing. The walk looks at each relation and each
expression by class: relations must be on a list, an expression must be one of Spark's own that no function outside
the allowed groups makes. What the queried frame itself consists of is not the text's doing and is not walked.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import DataFrame, SparkSession

CATALYST = "org.apache.spark.sql.catalyst"
# Plan nodes that only rearrange rows; as leaves a list of literals, one row, a range of numbers.
RELATIONS = frozenset(
    "Project Filter Aggregate Join LateralJoin Sort Window Union Distinct Deduplicate Except Intersect GlobalLimit LocalLimit Offset Sample "
    "SubqueryAlias WithCTE CTERelationDef CTERelationRef UnionLoop UnionLoopRef LocalRelation OneRowRelation OneRowRelation$ Range Generate "
    "Expand Pivot Unpivot ResolvedHint UnresolvedHint".split())
# Function groups of Spark's own registry that work on values alone.
GROUPS = frozenset(f"{g}_funcs" for g in (
    "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate st string struct url "
    "variant window xml").split())
# Of the group of everything else, those that read nothing and run nothing.
OTHERS = frozenset(
    "aes_decrypt aes_encrypt assert_true current_catalog current_database current_schema current_user equal_null "
    "monotonically_increasing_id raise_error session_user spark_partition_id try_aes_decrypt typeof user uuid version".split())
OTHER_FAMILIES = ("approx_top_k", "bitmap_", "hll_", "kll_", "theta_")
USER_DEFINED, REPLACED, HOLDS_PLAN = (f"{CATALYST}.expressions.{t}" for t in ("UserDefinedExpression", "RuntimeReplaceable", "PlanExpression"))
REFUSED = frozenset(f"{CATALYST}.expressions.{c}" for c in ("VariableReference", "aggregate.V2Aggregator"))



def _items(spark: SparkSession, values: JavaObject) -> list[JavaObject]:
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(values))


@lru_cache(maxsize=4)
def _unsafe_classes(spark: SparkSession) -> frozenset[str]:
    """Classes that only functions outside the allowed groups make."""
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    safe, unsafe = set(), set()
    for name in _items(spark, registry.listFunction()):
        info, called = registry.lookupFunction(name).get(), name.funcName()
        allowed = info.getGroup() in GROUPS or called in OTHERS or called.startswith(OTHER_FAMILIES)
        (safe if allowed else unsafe).add(info.getClassName())
    return frozenset(unsafe - safe)


def violations(df: DataFrame, view: str) -> Iterator[str]:
    """Names what the analysed plan of ``df`` may not contain; ``view`` is the one view that it may read."""
    spark = df.sparkSession
    gateway = spark._sc._gateway
    traits: dict[str, tuple[bool, ...]] = {}

    def has(node: JavaObject, name: str) -> tuple[bool, ...]:
        if name not in traits:
            traits[name] = tuple(is_instance_of(gateway, node, t) for t in (USER_DEFINED, REPLACED, HOLDS_PLAN))
        return traits[name]

    plans, expressions = [df._jdf.queryExecution().analyzed()], []
    while plans or expressions:
        if plans:
            plan = plans.pop()
            kind = plan.getClass().getSimpleName()
            if kind == "SubqueryAlias" and plan.identifier().name() == view:
                continue
            if kind not in RELATIONS:
                yield f"relation {kind}"
                continue
            plans += _items(spark, plan.children())
            expressions += _items(spark, plan.expressions())
            continue
        node = expressions.pop()
        name = node.getClass().getName()
        user_defined, replaced, holds_plan = has(node, name)
        own = name.startswith(f"{CATALYST}.expressions.") and not name.startswith(f"{CATALYST}.expressions.objects.")
        if user_defined or not own or name in REFUSED or name in _unsafe_classes(spark):
            yield f"function {node.prettyName()}"
            continue
        # What a replaced function turns into is Spark's own doing; its arguments are the text's.
        inherits = replaced and is_instance_of(gateway, node, f"{CATALYST}.expressions.InheritAnalysisRules")
        expressions += _items(spark, node.parameters() if inherits else node.children())
        if holds_plan:
            plans.append(node.plan())
