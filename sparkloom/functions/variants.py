"""Schema-less documents: filters, sort keys and updates on a VARIANT column, as Columns.

A field is missing, null, a boolean, a number, a text, a list or an object. Unlike in a typed column, null is told from missing: a missing
field fails every operator; null is equal to null only, differs from all else, and compares as the text <nil>.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import ORDER
from .updates import OPERATORS
from .values import NUMBER, is_number, python_number, python_text, text_of

# Fixed value: what a null prints as.
NIL = "<nil>"


def path(name: str) -> str:
    """The place of a top-level field."""
    if "'" not in name:
        return f"$['{name}']"
    if '"' in name:
        raise ValueError(f"a field's name can't hold both quotes: {name}")
    return f'$["{name}"]'


def literal(value: Any) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


class Field:
    """A top-level field of a document column: its value, kind and readings."""

    def __init__(self, doc: Column | str, name: str):
        self.value = F.try_variant_get(doc, path(name), "variant")

    @classmethod
    def of(cls, value: Column) -> Field:
        out = cls.__new__(cls)
        out.value = value
        return out

    @property
    def present(self) -> Column:
        return self.value.isNotNull()

    @property
    def kind(self) -> Column:
        return F.schema_of_variant(self.value)

    def is_a(self, *kinds: str) -> Column:
        return F.coalesce(reduce(lambda a, b: a | b, (self.kind.startswith(k) for k in kinds)), F.lit(False))

    @property
    def numeric(self) -> Column:
        return self.is_a("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.value, "$", kind)

    @property
    def number(self) -> Column:
        """As a double, if it is a number or a text that reads as one."""
        text = self.get("string")
        return F.when(self.numeric, self.get("double")).when(self.is_a("STRING") & text.rlike(NUMBER), text.try_cast("double"))

    @property
    def text(self) -> Column:
        items = F.transform(self.get("array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x)))
        return (
            F.when(F.is_variant_null(self.value), NIL).when(self.numeric, text_of(self.get("double"), T.DoubleType())).when(self.is_a("STRING", "BOOLEAN"), self.get("string"))
            .when(self.is_a("ARRAY"), F.concat(F.lit("["), F.concat_ws(" ", items), F.lit("]"))).otherwise(F.to_json(self.value))
        )

    def equals(self, operand: Any) -> Column:
        """Of the same kind and value. Lists and objects by their JSON text, with whole numbers written as such."""
        if operand is None:
            same = F.is_variant_null(self.value)
        elif isinstance(operand, bool):
            same = self.is_a("BOOLEAN") & (self.get("boolean") == operand)
        elif is_number(operand):
            same = self.numeric & (self.get("double") == float(operand))
        elif isinstance(operand, str):
            same = self.is_a("STRING") & (self.get("string") == operand)
        else:
            same = F.to_json(self.value) == F.to_json(literal(operand))
        return self.present & F.coalesce(same, F.lit(False))

    def compare(self, op: str, operand: Any) -> Column:
        apply = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
        as_text = apply(self.text, F.lit(NIL if operand is None else python_text(operand)))
        number = None if operand is None else python_number(operand)
        both = as_text if number is None else F.when(self.number.isNotNull(), apply(self.number, F.lit(number))).otherwise(as_text)
        return self.present & F.coalesce(both, F.lit(False))

    def operator(self, op: str, operand: Any) -> Column:
        if op == "$eq":
            return self.equals(operand)
        if op == "$ne":
            return self.present & ~self.equals(operand)
        if op in ORDER:
            return self.compare(ORDER[op], operand)
        if op in ("$in", "$nin"):
            if not isinstance(operand, (list, tuple, set)):
                return self.present  # no constraint
            found = reduce(lambda a, b: a | b, (self.equals(v) for v in operand), F.lit(False))
            return self.present & (found if op == "$in" else ~found)
        raise ValueError(f"unknown operator {op}")


def matches(spec: dict[str, Any] | None, doc: str = "doc", id_col: str = "_id") -> Column:
    """A filter as a Column over (id, doc). The id is a column of its own and its filters reach the scan."""
    parts = []
    for name, want in (spec or {}).items():
        operators = isinstance(want, dict) and bool(want) and all(k.startswith("$") for k in want)
        for op, operand in want.items() if operators else [("$eq", want)]:
            if name == id_col and op == "$eq" and isinstance(operand, str):
                parts.append(F.col(id_col) == operand)
            else:
                parts.append((Field.of(F.col(id_col).cast("variant")) if name == id_col else Field(doc, name)).operator(op, operand))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def sort_keys(doc: str, name: str, down: bool) -> list[Column]:
    """Numbers in their order, then texts in byte order, missing and null last; all turned round when sorting downwards."""
    field = Field(doc, name)
    there = field.present & ~F.is_variant_null(field.value)
    keys = [F.when(field.number.isNotNull() & there, 0).when(there, 1).otherwise(2), field.number, F.when(there, field.text)]
    return [k.desc() if down else k.asc() for k in keys]


def _updated(field: Field, op: str, operand: Any) -> Column:
    """The new value of a field; SQL null: missing."""
    old = field.value
    if op == "$set":
        return literal(operand)
    if op == "$unset":
        return F.lit(None).cast("variant")
    if op == "$inc":
        total = field.get("double") + F.lit(float(operand))
        whole = (total == F.floor(total)) & (F.abs(total) < 2**53)
        return F.when(old.isNull(), literal(operand)).when(field.numeric, F.when(whole, total.try_cast("long").cast("variant")).otherwise(total.cast("variant"))).otherwise(old)
    held, item = field.get("array<variant>"), literal(operand)
    same = lambda x: F.to_json(x) == F.to_json(item)
    grown = F.array_append(held, item).cast("variant")
    if op == "$pull":
        return F.when(field.is_a("ARRAY"), F.filter(held, lambda x: ~same(x)).cast("variant")).otherwise(old)
    if op == "$addToSet":
        grown = F.when(F.exists(held, same), old).otherwise(grown)
    return F.when(old.isNull(), F.array(item).cast("variant")).when(field.is_a("ARRAY"), grown).otherwise(old)


def updated(doc: str, update: dict[str, Any]) -> Column:
    """The document after an update: operators in a fixed order, other fields as they are."""
    if unknown := set(update) - set(OPERATORS):
        raise ValueError(f"unknown update operators {sorted(unknown)}")
    new: dict[str, Column] = {}
    for op in OPERATORS:
        for name, operand in (update.get(op) or {}).items():
            new[name] = _updated(Field.of(new[name]) if name in new else Field(doc, name), op, operand)
    if not new:
        return F.col(doc)
    names = list(new)
    kept = F.map_filter(F.col(doc).cast("map<string,variant>"), lambda k, _: ~k.isin(names))
    entries = F.filter(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in new.items())), lambda e: e["value"].isNotNull())
    return F.to_variant_object(F.map_concat(kept, F.map_from_entries(entries)))


def projected(doc: str, names: list[str], include: bool) -> Column:
    fields = F.col(doc).cast("map<string,variant>")
    return F.to_variant_object(F.map_filter(fields, lambda k, _: k.isin(names) if include else ~k.isin(names)))
