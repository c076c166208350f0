"""The typed operators as SQL functions of a session: `SELECT physics_compute_acceleration(f, m)`.

Names are those of the operators in lower case with _ for the dot. Functions of operators that build a record or a name follow from
the tables of `typed`; those that compute have their types and bodies here, and a test holds each against its Column.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from . import typed

D2, D3, S2 = "a DOUBLE, b DOUBLE", "a DOUBLE, b DOUBLE, c DOUBLE", "a STRING, b STRING"
#: Operator -> parameters, body.
COMPUTED = {
    "math.ADD": (D2, "a + b"), "math.SUBTRACT": (D2, "a - b"), "math.MULTIPLY": (D2, "a * b"), "math.DIVIDE": (D2, "try_divide(a, b)"), "math.POWER": (D2, "pow(a, b)"), "math.SUBSTITUTE": ("a STRING, b STRING, c STRING", "replace(a, b, c)"),
    "math.IS_EQUAL": (D2, "a <=> b"), "math.COMPARE": (D2, "CASE WHEN a < b THEN 'lt' WHEN a = b THEN 'eq' WHEN a > b THEN 'gt' END"), "math.CONTAINS": ("a STRING, b ARRAY<STRING>", "array_contains(b, a)"),
    "math.UNION": ("a ARRAY<STRING>, b ARRAY<STRING>", "array_union(a, b)"), "math.INTERSECTION": ("a ARRAY<STRING>, b ARRAY<STRING>", "array_intersect(a, b)"),
    "physics.COMPUTE_ACCELERATION": (D2, "try_divide(a, b)"), "physics.UPDATE_VELOCITY": (D3, "a + b * c"), "physics.UPDATE_POSITION": (D3, "a + b * c"), "physics.COMPUTE_KINETIC_ENERGY": (D2, "0.5D * a * b * b"),
    "physics.COMPUTE_POTENTIAL_ENERGY": (D3, "a * coalesce(b, 9.8D) * c"), "physics.COMPARE_QUANTITIES": (D2, "a <=> b"),
    "finance.DEPOSIT": (D2, "a + b"), "finance.WITHDRAW": (D2, "a - b"), "finance.COMPUTE_INTEREST": (D3, "a * b * c"), "finance.COMPUTE_COMPOUND_INTEREST": (D3, "a * pow(1 + b, c)"), "finance.COMPARE_VALUES": (D2, "a > b"),
    "core.LOOKUP": ("a STRING, b MAP<STRING, STRING>", "try_element_at(b, a)"), "core.SORT": ("a ARRAY<STRING>", "sort_array(a)"), "core.COUNT": ("a ARRAY<STRING>", "size(a)"), "core.COMPARE": (S2, "a <=> b"), "core.CONTAIN": ("a ARRAY<STRING>, b STRING", "array_contains(a, b)"),
    "programming.INDEX": ("a ARRAY<STRING>, b INT", "get(a, CASE WHEN b < 0 THEN size(a) + b ELSE b END)"), "programming.APPEND": ("a ARRAY<STRING>, b STRING", "array_append(a, b)"), "programming.REMOVE": ("a ARRAY<STRING>, b STRING", "filter(a, y -> NOT (y <=> b))"),
    "programming.LOOKUP_KEY": ("a MAP<STRING, STRING>, b STRING", "try_element_at(a, b)"), "legal.ESTABLISH_PRECEDENCE": (S2, "named_struct('higher', a, 'lower', b)"), "geography.GEO_LOOKUP": ("a MAP<STRING, STRING>, b STRING", "coalesce(try_element_at(a, b), format_string('unknown(%s)', b))"),
}


def function_name(operator: str) -> str:
    return operator.replace(".", "_").lower()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, tuple[str, str]]:
    """Operator -> parameters, body, for every operator that has a SQL function."""
    out = dict(COMPUTED)
    for operator, template in typed.SYMBOLIC.items():
        n = max([int(k) for k in re.findall(r"%(\d)\$s", template)] + [template.count("%s")])
        n = max(n, 2 if operator.endswith(("ADD_ASSET", "REMOVE_ASSET")) else n)
        names = "abcd"[:n]
        out[operator] = (", ".join(f"{x} STRING" for x in names), f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in names)} THEN format_string({_quoted(template)}, {', '.join(names)}) END")
    for operator, fields in typed.STRUCTS.items():
        numbers = {i for _, of in fields for i in (of if isinstance(of, tuple) else [of]) if isinstance(i, int) and not isinstance(i, bool)}
        part = lambda of: f"array({', '.join('abcd'[i] for i in of)})" if isinstance(of, tuple) else str(of).lower() if isinstance(of, bool) else "abcd"[of] if isinstance(of, int) else _quoted(of)
        out[operator] = (", ".join(f"{'abcd'[i]} STRING" for i in range(max(numbers) + 1)), f"named_struct({', '.join(f'{_quoted(name)}, {part(of)}' for name, of in fields)})")
    return out


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; their names."""
    made = definitions()
    for operator, (parameters, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function_name(operator)}({parameters}) RETURN {body}")
    return sorted(map(function_name, made))
