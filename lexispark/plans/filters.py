"""JSON filters: keys are and-ed, the items of a key's array or-ed.

{"field": [value, {"min": 1, "max": 5, "left": false, "right": true}]}. left and right say whether a bound belongs to the
range; missing is no. Unknown keys, values that are no arrays, ranges on text and keyword fields and plain values on numeric fields are ignored.
"""

from __future__ import annotations

import json
import sys

from ..schema import FieldType, IndexDef
from .ast import Bool, In, Query, Range, Term

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def _range(name: str, kind: FieldType, item: dict, positive_floor: bool) -> Query:
    low, high = item.get("min"), item.get("max")
    left, right = bool(item.get("left")), bool(item.get("right"))
    if kind is FieldType.INT:
        low, high = None if low is None else int(low), None if high is None else int(high)
        if low == INT_MAX and not left or high == INT_MIN and not right:
            raise OverflowError(f"{name}: an exclusive bound at the end of the int range")
        if low is not None and not left:
            low, left = low + 1, True
        if high is not None and not right:
            high, right = high - 1, True
        return Range(name, low, high, left, right)
    low = None if low is None else float(low)
    if low is None and positive_floor:  # the smallest positive double, bound exclusive
        low, left = sys.float_info.min * sys.float_info.epsilon, False
    return Range(name, low, None if high is None else float(high), left, right)


def parse(source: str | dict | None, index: IndexDef, positive_floor: bool = False) -> Query | None:
    """The filter as a query, None for no filter. Bad JSON raises.

    positive_floor: an open lower bound on a double excludes zero and negatives.
    """
    if not source:
        return None
    tree = json.loads(source) if isinstance(source, str) else source
    if not isinstance(tree, dict):
        raise ValueError("a filter is a JSON object")
    keys = []
    for name, items in tree.items():
        f = index.by_name.get(name)
        if f is None or not isinstance(items, list):
            continue
        any_of: list[Query] = []
        values = []
        for item in items:
            if isinstance(item, dict):
                if f.type in (FieldType.INT, FieldType.DOUBLE):
                    any_of.append(_range(name, f.type, item, positive_floor))
            elif item is not None and f.type is FieldType.KEYWORD:
                values.append(_plain(item))
            elif item is not None and f.type is FieldType.TEXT:
                any_of.append(Term(name, _plain(item)))
        if values:
            any_of.append(In(name, tuple(values)))
        if any_of:
            keys.append(any_of[0] if len(any_of) == 1 else Bool(should=tuple(any_of), minimum=1))
    if not keys:
        return None
    return keys[0] if len(keys) == 1 else Bool(must=tuple(keys))


def _plain(item: object) -> str:
    return str(item).lower() if isinstance(item, bool) else str(item)


def with_filter(query: Query, tree: Query | None) -> Query:
    return query if tree is None else Bool(must=(query,), filter=(tree,))


