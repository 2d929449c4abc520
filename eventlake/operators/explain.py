"""Where the values of an event come from: for each path, the expression that sets it and the fields that gave its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import Source, evaluate
from .normalize import detect


def _op(op) -> str:
    if isinstance(op, str):
        return op
    name, *args = op
    if args and isinstance(args[0], dict):
        said = [f"{k}: {v}" for k, v in args[0].items() if k != "map"] + ([f"map[{len(args[0]['map'])}]"] if "map" in args[0] else [])
        return f"{name}({', '.join(said)})"
    return f"{name}({', '.join(map(str, args))})"


def render(expr) -> str:
    """An expression in words."""
    if isinstance(expr, str):
        return f"copy {expr}"
    if "const" in expr:
        return f"const {expr['const']!r}"
    default = f" (default {expr['default']!r})" if "default" in expr else ""
    if "coalesce" in expr:
        return f"coalesce({'; '.join(map(render, expr['coalesce']))}){default}"
    if "when" in expr:
        other = f" else {render(expr['else'])}" if "else" in expr else ""
        return f"when {expr['when']} == {expr['eq']!r} then {render(expr['then'])}{other}"
    names = expr["from"] if isinstance(expr["from"], str) else ",".join(expr["from"])
    return f"from {names}{''.join(f' | {_op(op)}' for op in expr.get('pipe', []))}{default}"


def producers(fields: Column, expr) -> Column:
    """The fields that gave an expression's value: of a coalesce those of the branch that won, of a condition its own and
    those of the branch taken."""
    names = lambda *found: F.array(*[F.lit(n) for n in found]).cast("array<string>")
    if isinstance(expr, str):
        return names(expr)
    if "const" in expr:
        return names()
    if "coalesce" in expr:
        out = names()
        for e in reversed(expr["coalesce"]):
            out = F.when(evaluate(fields, e).isNotNull(), producers(fields, e)).otherwise(out)
        return out
    if "when" in expr:
        taken = producers(fields, expr["then"])
        other = producers(fields, expr["else"]) if "else" in expr else names()
        return F.concat(names(expr["when"]), F.when(F.coalesce(fields[expr["when"]] == F.lit(str(expr["eq"])), F.lit(False)), taken).otherwise(other))
    listed = names(*([expr["from"]] if isinstance(expr["from"], str) else expr["from"]))
    for op in expr.get("pipe", []):
        if not isinstance(op, str) and op[0] == "strptime" and "tz_from" in op[1]:
            listed = F.concat(listed, F.when(F.map_contains_key(fields, op[1]["tz_from"]), names(op[1]["tz_from"])).otherwise(names()))
    return listed


def explain(raw: DataFrame, sources: list[Source]) -> DataFrame:
    """(raw_id, source_id, class, path, value, expression, fields) for every value that a mapping sets in a line's event."""
    found = detect(raw, sources).filter("kind IS NOT NULL")
    f = F.col("fields")
    none = F.array().cast("array<struct<path:string,value:string,expression:string,fields:array<string>>>")
    rows = none
    for s in sources:
        for c, setters in s.classes.items():
            own = [F.struct(F.lit(p).alias("path"), evaluate(f, e).cast("string").alias("value"), F.lit(render(e)).alias("expression"), producers(f, e).alias("fields")) for p, e in setters.items()]
            rows = F.when(F.col("kind") == f"{s.id}|{c}", F.array(*own)).otherwise(rows)
    each = found.select("raw_id", F.split_part("kind", F.lit("|"), F.lit(1)).alias("source_id"), F.split_part("kind", F.lit("|"), F.lit(2)).alias("class"), F.explode(rows).alias("x"))
    return each.select("raw_id", "source_id", "class", "x.*").filter("value IS NOT NULL")
