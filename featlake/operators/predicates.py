"""Predicate documents (JSON form of the common query language) compiled to one Column.

Unknown operators and unknown properties are rejected before any plan is built, so a filter can
only ever narrow a result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featlake.operators.filters import BadRequest, parse_instant

_COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


class PredicateBuilder:
    """Compiles predicate documents against the columns of one feature table.

    ``spatial`` turns a box into a predicate on the table's geometry. Further functions can be
    registered by name; they receive compiled arguments.
    """

    def __init__(
        self,
        schema: T.StructType,
        spatial: Callable[[tuple[float, float, float, float]], Column] | None = None,
        geometry: str | None = None,
    ):
        self._types = {f.name: f.dataType for f in schema.fields}
        self._spatial = spatial
        self._geometry = geometry
        self._functions: dict[str, Callable[..., Column]] = {}

    def register(self, name: str, build: Callable[..., Column]) -> None:
        self._functions[name.lower()] = build

    def compile(self, document: str | Mapping) -> Column:
        try:
            return self._boolean(json.loads(document) if isinstance(document, str) else document)
        except json.JSONDecodeError:
            raise BadRequest("the filter is not a JSON document") from None

    def _boolean(self, node) -> Column:
        if isinstance(node, bool):
            return F.lit(node)
        if not isinstance(node, Mapping) or "op" not in node:
            raise BadRequest(f"not a predicate: {node!r}")
        op, args = str(node["op"]).lower(), node.get("args", [])
        if op in ("and", "or"):
            terms = [self._boolean(a) for a in args]
            if not terms:
                raise BadRequest(f"{op} needs arguments")
            result = terms[0]
            for t in terms[1:]:
                result = (result & t) if op == "and" else (result | t)
            return result
        if op == "not":
            return ~self._boolean(args[0])
        if op == "isnull":
            return self._value(args[0]).isNull()
        if op in _COMPARISONS:
            return _COMPARISONS[op](self._value(args[0]), self._value(args[1], like=args[0]))
        if op == "between":
            value = self._value(args[0])
            return value.between(self._value(args[1], like=args[0]), self._value(args[2], like=args[0]))
        if op == "in":
            return self._value(args[0]).isin([self._value(a, like=args[0]) for a in args[1]])
        if op == "like":
            return self._value(args[0]).like(str(args[1]))
        if op == "s_intersects":
            return self._intersects(args)
        if op.startswith("t_"):
            return self._temporal(op, args)
        if op in self._functions:
            return self._functions[op](*[self._value(a) for a in args])
        raise BadRequest(f"unknown operator {op!r}")

    def _value(self, node, like=None) -> Column:
        if isinstance(node, Mapping):
            if "property" in node:
                return F.col(f"`{self._known(node['property'])}`")
            for key in ("timestamp", "date"):
                if key in node:
                    return self._instant(node[key])
            if "op" in node:
                return self._boolean(node)
            raise BadRequest(f"not a value: {node!r}")
        if isinstance(node, list):
            raise BadRequest("lists are only allowed with 'in'")
        literal = F.lit(node)
        # Bring text to the type of the column it is compared with, so that the scan can use it.
        if isinstance(like, Mapping) and "property" in like and isinstance(node, str):
            kind = self._types[self._known(like["property"])]
            if not isinstance(kind, T.StringType):
                literal = literal.try_cast(kind)
        return literal

    def _known(self, name: str) -> str:
        if name not in self._types or name == self._geometry:
            raise BadRequest(f"unknown property {name!r}")
        return name

    @staticmethod
    def _instant(text: str) -> Column:
        return F.lit(parse_instant(text).isoformat(sep=" ")).cast("timestamp_ntz")

    def _intersects(self, args) -> Column:
        target, shape = args
        if target.get("property") != self._geometry or self._spatial is None:
            raise BadRequest("s_intersects works on the geometry of the table")
        box = shape.get("bbox") if isinstance(shape, Mapping) else None
        if not isinstance(box, list) or len(box) not in (4, 6):
            raise BadRequest("s_intersects needs a bbox of 4 or 6 numbers")
        return self._spatial(tuple(box) if len(box) == 4 else (box[0], box[1], box[3], box[4]))

    def _temporal(self, op: str, args) -> Column:
        value = self._value(args[0])
        other = args[1]
        if isinstance(other, Mapping) and "interval" in other:
            start, end = [None if t in ("..", "") else self._instant(t) for t in other["interval"]]
        else:
            start = end = self._value(other)
        if op == "t_after":
            return F.lit(False) if end is None else value > end
        if op == "t_before":
            return F.lit(False) if start is None else value < start
        if op == "t_equals":
            return (value == start) & (value == end)
        if op in ("t_during", "t_intersects"):
            # During is strict at both ends, intersects includes them.
            strict = op == "t_during"
            test = value.isNotNull()
            if start is not None:
                test &= (value > start) if strict else (value >= start)
            if end is not None:
                test &= (value < end) if strict else (value <= end)
            return test
        raise BadRequest(f"unknown operator {op!r}")
