"""Dotted configuration paths: flatten, unflatten, override, rules. Trees are small and live on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten(tree: dict, sep: str = ".", prefix: str = "") -> dict:
    """Leaves by their path."""
    out: dict = {}
    for k, v in tree.items():
        path = f"{prefix}{sep}{k}" if prefix else str(k)
        if isinstance(v, dict) and v:
            out |= flatten(v, sep, path)
        else:
            out[path] = v
    return out


def unflatten(flat: dict, sep: str = ".") -> dict:
    tree: dict = {}
    for path, v in flat.items():
        node = tree
        *way, leaf = path.split(sep)
        for k in way:
            node = node.setdefault(k, {})
            if not isinstance(node, dict):
                raise ValueError(f"{path} runs through a value")
        node[leaf] = v
    return tree


def override(tree: dict, changes: dict, sep: str = ".") -> dict:
    """A copy of tree with values set by path, the later change winning; a path through a value is an error."""
    flat = flatten(tree, sep)
    for path, v in changes.items():
        way = path.split(sep)
        if any(sep.join(way[:k]) in flat and flat[sep.join(way[:k])] != {} for k in range(1, len(way))):
            raise ValueError(f"{path} runs through a value")
        flat = {p: x for p, x in flat.items() if p != path and not p.startswith(path + sep)}
        flat |= flatten({path: v}, sep) if isinstance(v, dict) else {path: v}
    return unflatten(flat, sep)


def merged(base: Column, *changes: Column) -> Column:
    """Maps of dotted paths, later ones winning on equal paths."""
    return reduce(lambda old, new: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new), changes, base)


def missing_columns(columns: list[str], needed: list[str]) -> list[str]:
    return [c for c in needed if c not in columns]


def broken_rules(flat: dict, rules: dict) -> list[str]:
    """Names of rules that do not hold. rules: name to (path, test)."""
    return [name for name, (path, test) in rules.items() if path not in flat or not test(flat[path])]


def assign_round_robin(names: list[str], slots: list) -> dict:
    """Each name's slot, in turn."""
    return {n: slots[k % len(slots)] for k, n in enumerate(names)}


def run_table(runs: DataFrame, slots: list) -> DataFrame:
    """runs (with ord) and the slot that each takes in turn."""
    return runs.withColumn("slot", F.element_at(F.array(*[F.lit(s) for s in slots]), (F.pmod("ord", F.lit(len(slots))) + 1).cast("int")))


def template(text: str) -> Column:
    """A prompt template with {{ column }} places as a Column."""
    parts, rest = [], text
    while "{{" in rest:
        before, _, tail = rest.partition("{{")
        name, _, rest = tail.partition("}}")
        value = name.strip().split("|")
        col = F.col(value[0].strip()).cast("string")
        parts += [F.lit(before), F.trim(col) if "trim" in (v.strip() for v in value[1:]) else col]
    return F.concat(*parts, F.lit(rest))


def read_yaml(path: str, spark: SparkSession | None = None) -> dict:
    """A YAML file whose top is a mapping; with a session, from any path that Spark reads."""
    import yaml

    if spark is not None:
        text = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    tree = yaml.safe_load(text)
    if not isinstance(tree, dict):
        raise ValueError(f"{path} holds no mapping")
    return tree


def shared_slots(a: Column, b: Column) -> Column:
    """Slots that two jobs would both use, sorted."""
    return F.array_sort(F.array_intersect(a, b))


def row_faults(rules: dict):
    """Names of the rules (columns of booleans) that a row breaks, in the rules' order; a null is no fulfilment."""
    from pyspark.sql import functions as F

    names = [F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def flat_columns(rows):
    """rows with every field of nested structs as a column named by its dotted path."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    def fields(kind: StructType, path: tuple):
        for f in kind.fields:
            if isinstance(f.dataType, StructType) and f.dataType.fields:
                yield from fields(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)

    def column(path: tuple):
        out = F.col(f"`{path[0]}`")
        for name in path[1:]:
            out = out.getField(name)
        return out.alias(".".join(path))

    return rows.select(*[column(p) for p in fields(rows.schema, ())])


def nested_columns(rows):
    """rows with columns of dotted names as nested structs; a name that is also the beginning of another is an error."""
    from pyspark.sql import functions as F

    tree: dict = {}
    for name in rows.columns:
        *path, last = name.split(".")
        at = tree
        for p in path:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} begins with another column's name")
        if last in at:
            raise ValueError(f"{name} is the beginning of another column's name")
        at[last] = f"`{name}`"

    def column(value, name: str):
        return (F.struct(*[column(v, k) for k, v in value.items()]) if isinstance(value, dict) else F.col(value)).alias(name)

    return rows.select(*[column(v, k) for k, v in tree.items()])
