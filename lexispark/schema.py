"""Index definitions: fields with types and analyzers, and the all-fields company index."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import types as T


class FieldType(IntEnum):
    TEXT = 1
    KEYWORD = 2
    INT = 3
    DOUBLE = 4


SPARK_TYPES = {FieldType.TEXT: T.StringType(), FieldType.KEYWORD: T.StringType(), FieldType.INT: T.IntegerType(), FieldType.DOUBLE: T.DoubleType()}


@dataclass(frozen=True)
class FieldDef:
    """A field. `parents` make it a derived one: where the row has no value, theirs are joined by spaces.

    multi_valued: a keyword field holds a delimited list, and membership tests its items, not the whole string. k1 and b: the similarity's saturation and length norm.
    """

    name: str
    type: FieldType = FieldType.TEXT
    analyzer: str = "segment"
    stored: bool = True
    from_source: bool = True
    parents: tuple[str, ...] = ()
    delimiter: str | None = None
    normalize: bool = True
    multi_valued: bool = False
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        object.__setattr__(self, "type", FieldType(self.type))  # other numbers raise here, at configuration time
        if self.delimiter is not None and len(self.delimiter) != 1:
            raise ValueError(f"{self.name}: the delimiter must be one character")


@dataclass(frozen=True)
class IndexDef:
    """An index. segmenter: the dictionary segmenter of its `segment` fields, by name, for documents and queries alike (see tokens.add_segmenter)."""

    name: str
    fields: tuple[FieldDef, ...]
    id_field: str = "id"
    shards: int = 50
    recall_size: int = 200
    tie_field: str | None = "company_score"
    segmenter: str = ""
    by_name: dict[str, FieldDef] = field(init=False, hash=False, compare=False)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: a field is declared twice")
        missing = [p for f in self.fields for p in f.parents if p not in names]
        if missing:
            raise ValueError(f"{self.name}: unknown parents {missing}")
        if self.shards < 1 or self.recall_size < 1:
            raise ValueError(f"{self.name}: shards and recall_size must be positive")
        object.__setattr__(self, "by_name", {f.name: f for f in self.fields})

    def source_columns(self) -> list[str]:
        return [f.name for f in self.fields if f.from_source]

    def stored_columns(self) -> list[str]:
        return [f.name for f in self.fields if f.stored]


def from_dict(name: str, config: dict) -> IndexDef:
    """An IndexDef from plain values, as read from YAML or JSON."""
    fields = tuple(FieldDef(n, **{**f, "parents": tuple(f.get("parents", ()))}) for n, f in config["fields"].items())
    return IndexDef(name, fields, **{k: v for k, v in config.items() if k != "fields"})


def enterprise() -> IndexDef:
    """Companies with every field that the query types read."""
    text = lambda n, a="segment", **k: FieldDef(n, FieldType.TEXT, a, **k)
    derived = lambda n, a, *p: FieldDef(n, FieldType.TEXT, a, stored=False, from_source=False, parents=p)
    lists = ("product_brand_names", "brand_names_algo", "app_name", "oper_name", "oper_name_one", "stock_name_short_array", "stock_code_new_array")
    return IndexDef(
        "enterprise",
        (
            text("id"),
            text("name"),
            text("used_name"),
            *[text(n, "delimited", delimiter=";") for n in lists],
            *[text(n, "keep") for n in ("eid", "company_id", "credit_no")],
            FieldDef("found_years", FieldType.INT),
            FieldDef("social_security_num", FieldType.INT),
            FieldDef("company_score", FieldType.DOUBLE),
            FieldDef("reg_capi", FieldType.DOUBLE),
            *[FieldDef(n, FieldType.KEYWORD) for n in ("type_new", "category_new", "status", "address_code_prov", "address_code_city", "address_code_dist")],
            *[FieldDef(f"industry_code_{i}", FieldType.KEYWORD, delimiter=";", multi_valued=True) for i in range(1, 5)],
            derived("name_single", "single", "name"),
            derived("name_single_pinyin", "single_pinyin", "name"),
            derived("used_name_single_pinyin", "single_pinyin", "used_name"),
            derived("complex_field_single_pinyin", "single_pinyin", "name", "used_name", "product_brand_names", "app_name", "oper_name_one"),
            derived("name_pinyin", "segment_pinyin", "name"),
            derived("used_name_pinyin", "segment_pinyin", "used_name"),
            derived("fuzz_name", "strip", "name"),
            derived("fuzz_used_name", "strip", "used_name"),
            derived("single_fuzz_name", "single", "name"),
            derived("single_fuzz_used_name", "single", "used_name"),
            derived("name_jianpin", "initials", "name"),
            derived("used_name_jianpin", "initials", "used_name"),
            derived("jianpin", "initials", "name"),
            derived("pinyin", "full_pinyin", "name"),
            derived("all_name_pinyin", "full_pinyin", "name"),
            derived("all_used_name_pinyin", "full_pinyin", "used_name"),
        ),
    )
