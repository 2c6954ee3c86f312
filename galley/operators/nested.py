"""Deeply nested records as related flat tables (shared inlining).

The schema is read as a graph: a struct reached once from its parent is inlined into the parent's table; an element
that repeats (an array) gets a table; element types that several parents have in common (such as a box of numbers)
share one table.  Every table carries the key of the root and the places (1-based) of the elements on the way down,
which together are its primary key; without the last place they are the foreign key to the parent's row.

An array may also be placed: its elements are structs of PLACE and ITEM, and PLACE is the number to carry.  So elements
stored under keys keep them, however far apart, and no seat is built for a key that nobody has.  Column types of a table
cannot be recursive, so neither is the graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


PLACE, ITEM = "__no", "__item"


def _element(kind: T.ArrayType) -> tuple[T.DataType, bool]:
    """What an array holds, and whether its elements carry their own places."""
    inner = kind.elementType
    if isinstance(inner, T.StructType) and inner.names == [PLACE, ITEM]:
        return inner[ITEM].dataType, True
    return inner, False


@dataclass
class Node:
    """A table of the result: where its rows lie and what is inlined in it."""

    name: str
    path: tuple[str, ...]  # names of the arrays from the root down
    inlined: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)  # column, steps inside the element
    scalar: bool = False
    parent: str | None = None


def _graph(schema: T.StructType, name: str, path: tuple[str, ...], parent: str | None, out: list[Node], found: dict, placed: set) -> None:
    node = Node(name, path, parent=parent)
    out.append(node)

    def walk(kind: T.StructType, steps: tuple[str, ...]) -> None:
        for f in kind.fields:
            at = (*steps, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, at)
            elif isinstance(f.dataType, T.ArrayType):
                inner, own = _element(f.dataType)
                here = (*path, ".".join(at))
                if own:
                    placed.add(here)
                if isinstance(inner, T.StructType):
                    _graph(inner, f.name, here, name, out, found, placed)
                else:
                    found.setdefault((f.name, inner.simpleString()), []).append((here, name))
            else:
                node.inlined.append(("_".join(at), at))

    walk(schema, ())


def schema_graph(schema: T.StructType, root: str) -> tuple[list[Node], dict[tuple[str, str], list[tuple[tuple[str, ...], str]]], set[tuple[str, ...]]]:
    """The tables of ``schema``; the repeated scalars by name and type with all their places, of which those with more
    than one place are shared; and the paths of placed arrays."""
    out: list[Node] = []
    found: dict = {}
    placed: set = set()
    _graph(schema, root, (), None, out, found, placed)
    return out, found, placed


def _steps(c: Column, steps: tuple[str, ...] | str) -> Column:
    for s in steps.split(".") if isinstance(steps, str) else steps:
        c = c.getField(s)
    return c


def shared_inline(df: DataFrame, key: str, root: str, numbers: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Flat tables of ``df`` by name; ``numbers`` names the place column of each repeated element (default
    ``<name>_no``).  NULL arrays and empty arrays give no rows; a NULL struct element gives none either, but keeps
    its place; NULL scalars are kept as rows with NULL ``value``.  Column names that clash with the keys get the
    table's name in front.  Nothing is shuffled; each table is a projection of ``df`` with explodes."""
    nodes, scalars, placed = schema_graph(T.StructType([f for f in df.schema.fields if f.name != key]), root)
    numbers = numbers or {}

    def number(step: str) -> str:
        last = step.split(".")[-1]
        return numbers.get(last, f"{last}_no")

    def rows(path: tuple[str, ...], keep_null: bool) -> tuple[DataFrame, list[str]]:
        cols = [F.col(key).alias(key)]
        if not path:
            return df, [key]
        at, names = df.select(*cols, _steps_top(path[0]).alias("__a")), [key]
        for i, step in enumerate(path):
            nr = number(step)
            if path[: i + 1] in placed:
                at = at.select(*names, F.explode("__a").alias("__x")).select(*names, F.col("__x")[PLACE].alias(nr), F.col("__x")[ITEM].alias("__e"))
            else:
                at = at.select(*names, F.posexplode("__a").alias("__p", "__e")).select(*names, (F.col("__p") + 1).alias(nr), F.col("__e"))
            names.append(nr)
            last = i + 1 == len(path)
            if not (last and keep_null):
                at = at.where(F.col("__e").isNotNull())
            if not last:
                at = at.select(*names, _steps(F.col("__e"), path[i + 1]).alias("__a"))
        return at, names

    out = {}
    for n in nodes:
        at, names = rows(n.path, False)
        top = F.col("__e") if n.path else None
        cols = [(f"{n.name}_{c}" if c in names else c, _steps(top, s) if top is not None else _steps_top(".".join(s))) for c, s in n.inlined]
        out[n.name] = at.select(*names, *(c.alias(a) for a, c in cols))
    for (name, _), places in scalars.items():
        widest = sorted({number(s) for p, _ in places for s in p[:-1]})
        both = None
        for p, parent in places:
            at, names = rows(p, True)
            own = [F.col(c).cast("int").alias(c) if c in names[1:-1] else F.lit(None).cast("int").alias(c) for c in widest]
            one = at.select(key, F.lit(parent).alias("parent"), *own, F.col(names[-1]).alias("place"), F.col("__e").alias("value"))
            both = one if both is None else both.unionByName(one)
        out[name if name not in out else f"{name}_values"] = both
    return out


def _steps_top(path: str) -> Column:
    first, *rest = path.split(".")
    return _steps(F.col(f"`{first}`"), tuple(rest))


# ---- records that an earlier exporter left as JSON ----

CHARACTER = T.StructType([T.StructField("char", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("similarity", T.DoubleType())])
RECORD = T.StructType(
    [T.StructField(n, k) for n, k in (("kind", T.StringType()), ("reading", T.StringType()), ("original_word", T.StringType()), ("replacement", T.StringType()), ("changed", T.BooleanType()), ("bbox", T.ArrayType(T.DoubleType())))]
    + [T.StructField("characters", T.ArrayType(CHARACTER))]
    + [T.StructField(n, k) for n, k in (("style", T.StringType()), ("line", T.IntegerType()), ("symbol", T.StringType()), ("similarity", T.DoubleType()), ("profile", T.StringType()))]
)


def pruned(kind: T.StructType, keep: set[str]) -> T.StructType:
    """``kind`` with only the fields whose dotted name is in ``keep`` (parents of kept fields stay)."""

    def cut(k: T.DataType, at: str) -> T.DataType | None:
        if isinstance(k, T.ArrayType):
            inner = cut(k.elementType, at)
            return T.ArrayType(inner) if inner is not None else None
        if isinstance(k, T.StructType):
            fields = [T.StructField(f.name, c) for f in k.fields if (c := cut(f.dataType, f"{at}.{f.name}" if at else f.name)) is not None]
            return T.StructType(fields) if fields else None
        return k if at in keep else None

    return cut(kind, "")


def _get(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def _entries(v: Column, single: str) -> Column:
    """array<struct<no, item variant>> of a list, of an object with numbers as keys, of a JSON text of either, or of
    one object standing alone, which has the field ``single``.  Numbers are those of the keys, 0 too; one beyond the range
    of int is NULL.  Keys that are no numbers have no place and give nothing."""
    v = F.coalesce(F.try_parse_json(_get(v, "string")), v)
    listed = F.transform(_get(v, "array<variant>"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("item")))
    pairs = F.map_entries(_get(v, "map<string,variant>"))
    alone = F.when(F.exists(pairs, lambda p: p["key"] == single), F.array(F.struct(F.lit(1).alias("no"), v.alias("item"))))
    keyed = F.transform(F.filter(pairs, lambda p: p["key"].rlike("^[0-9]+$")), lambda p: F.struct(p["key"].try_cast("int").alias("no"), p["value"].alias("item")))
    return F.coalesce(listed, alone, keyed)


def _box(v: Column) -> Column:
    """Four numbers from a list, from an object x0, y0, x1, y1, or from a text of numbers."""
    text = F.transform(F.split(F.trim(_get(v, "string")), r"[\s,;]+"), lambda x: x.try_cast("double"))
    obj = F.when(F.coalesce(_get(v, "double", "$.x0"), _get(v, "double", "$.x1")).isNotNull(), F.array(*(_get(v, "double", f"$.{k}") for k in ("x0", "y0", "x1", "y1"))))
    return F.coalesce(_get(v, "array<double>"), obj, text)


def _value(v: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return _read(_entries(v, "char"), kind.elementType) if isinstance(kind.elementType, T.StructType) else _box(v)
    return _get(v, kind.simpleString())


def _read(entries: Column, kind: T.StructType) -> Column:
    """The objects of ``entries`` as a placed array; what is no object is a NULL item."""

    def item(x: Column) -> Column:
        whole = F.struct(*(_value(_get(x, "variant", f"$.{f.name}"), f.dataType).alias(f.name) for f in kind.fields))
        return F.when(_get(x, "map<string,variant>").isNotNull(), whole)

    return F.transform(entries, lambda e: F.struct(e["no"].alias(PLACE), item(e["item"]).alias(ITEM)))


def as_placed(c: Column, kind: T.ArrayType) -> Column:
    """A stored array of structs as a placed one, inner arrays too."""

    def item(x: Column) -> Column:
        deep = [f for f in kind.elementType.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        whole = F.struct(*(as_placed(x[f.name], f.dataType).alias(f.name) if f in deep else x[f.name].alias(f.name) for f in kind.elementType.fields))
        return F.when(x.isNotNull(), whole) if deep else x

    return F.transform(c, lambda x, i: F.struct((i + 1).alias(PLACE), item(x).alias(ITEM)))


def _found(v: Column, name: str, depth: int) -> Column:
    """The field ``name`` of an object or, if it has none, of the first object inside it that has, ``depth`` levels down."""
    own = _get(v, "variant", f"$.{name}")
    if not depth:
        return own
    inside = F.transform(F.map_values(_get(v, "map<string,variant>")), lambda x: _found(x, name, depth - 1))
    return F.coalesce(own, F.try_element_at(F.filter(inside, lambda x: x.isNotNull()), F.lit(1)))


#: Objects around the records of a payload.
WRAPPED = 4


def payload_records(payload: Column, kind: T.StructType = RECORD) -> Column:
    """The records in a JSON payload as placed array of ``kind``, wherever up to WRAPPED objects deep they lie; NULL for a
    payload that is NULL, not whole JSON, or without records.  Elements keep their places; NULL elements stay NULL."""
    return _read(_entries(_found(F.try_parse_json(payload), "records", WRAPPED), "bbox"), kind)


def word_records(words: DataFrame, kind: T.StructType = RECORD, others: tuple[str, ...] = (), once: bool = True) -> DataFrame:
    """(word_id, ``others``, records): stored records, or those of the payload where none are stored, as placed arrays;
    words sent again count once, unless ``once`` is False."""
    stored = F.col("records")
    records = F.when(stored.isNotNull(), as_placed(stored, T.ArrayType(kind))).otherwise(payload_records(F.col("payload"), kind))
    out = words.select("word_id", *others, records.alias("records"))
    return out.dropDuplicates(["word_id"]) if once else out
