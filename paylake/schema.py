"""Declared segment kinds: where they stand in a document, and the fields extracted from them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import types as T

MAX_STEPS, MAX_PATHS, MAX_KINDS, MAX_REPEATED = 10, 64, 64, 10

REQUIRED, OPTIONAL, REPEATED = "required", "optional", "repeated"
TYPES: dict[str, T.DataType] = {
    "str": T.StringType(),
    "big_int": T.DecimalType(20, 0),
    "int": T.IntegerType(),
    "small_int": T.ShortType(),
    "date": T.DateType(),
    "ts": T.TimestampType(),
    "amount": T.DecimalType(18, 5),
}
_STEP = re.compile(r"@?(?:[^\s:/@]+:)?[^\s:/@]+")


class SchemaError(ValueError):
    """A declaration that cannot be carried out."""


@dataclass(frozen=True)
class Path:
    """Namespaced element names (``uri}local``) and, for an attribute, its name."""

    steps: tuple[str, ...]
    attribute: str | None = None

    @classmethod
    def parse(cls, text: str, namespaces: dict[str, str]) -> Path:
        """``a/x:b/@c``. An element without prefix is in the namespace of prefix "" (if declared);
        an attribute without prefix is in none. Outer blanks and slashes and empty steps are ignored."""
        steps, attribute = [], None
        parts = [s for s in text.strip().strip("/").split("/") if s.strip()]
        for k, part in enumerate(parts):
            step = part.strip()
            if not _STEP.fullmatch(step):
                raise SchemaError(f"bad step {step!r} in path {text!r}")
            is_attribute = step[0] == "@"
            prefix, _, local = step.lstrip("@").rpartition(":")
            if prefix and prefix not in namespaces:
                raise SchemaError(f"unknown prefix {prefix!r} in path {text!r}")
            uri = "" if is_attribute and not prefix else namespaces.get(prefix, "")
            name = f"{uri}}}{local}" if uri else local
            if is_attribute:
                if k + 1 < len(parts):
                    raise SchemaError(f"attribute before the end of path {text!r}")
                attribute = name
            else:
                steps.append(name)
        if not steps or len(parts) > MAX_STEPS:
            raise SchemaError(f"path {text!r} has {len(parts)} steps; 1 to {MAX_STEPS} elements are possible")
        return cls(tuple(steps), attribute)

    def __str__(self) -> str:
        return "/".join(s.rpartition("}")[2] for s in self.steps) + (f"/@{self.attribute.rpartition('}')[2]}" if self.attribute else "")

    def with_uris(self) -> str:
        show = lambda s: "{" + s if "}" in s else s
        return "/".join(map(show, self.steps)) + (f"/@{show(self.attribute)}" if self.attribute else "")


@dataclass(frozen=True)
class Validator:
    """``valid``: from the raw string column to a boolean column."""

    valid: Callable[[Column], Column]
    domain_code: str
    message: str = "invalid value"


@dataclass(frozen=True)
class Field:
    name: str
    path: str
    type: str = "str"
    cardinality: str = REQUIRED
    validator: Validator | None = None


@dataclass(frozen=True)
class Segment:
    """A kind of segment. ``rule``: boolean column over its extracted fields, complete, is_first,
    is_last; by default ``complete``."""

    name: str
    path: str
    fields: tuple[Field, ...]
    header: bool = False
    rule: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Schema:
    namespaces: dict[str, str]
    segments: tuple[Segment, ...]
    paths: dict[str, tuple[Path, tuple[Path, ...]]] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        if not 0 < len(self.segments) <= MAX_KINDS:
            raise SchemaError(f"{len(self.segments)} kinds of segments; 1 to {MAX_KINDS} are possible")
        if len({s.name for s in self.segments}) < len(self.segments):
            raise SchemaError("two kinds of segments have the same name")
        for s in self.segments:
            if not 0 < len(s.fields) <= MAX_PATHS or len({f.name for f in s.fields}) < len(s.fields):
                raise SchemaError(f"{s.name}: {len(s.fields)} fields; 1 to {MAX_PATHS} with different names are possible")
            top, own = Path.parse(s.path, self.namespaces), []
            if top.attribute:
                raise SchemaError(f"{s.name}: a segment is an element")
            for f in s.fields:
                if f.type not in TYPES or f.cardinality not in (REQUIRED, OPTIONAL, REPEATED):
                    raise SchemaError(f"{s.name}.{f.name}: {f.cardinality} {f.type} is no kind of field")
                p = Path.parse(f.path, self.namespaces)
                if p.steps[0] != top.steps[-1]:
                    raise SchemaError(f"{s.name}.{f.name}: its path starts at {p.steps[0]}, not at the segment's own root")
                if p.attribute and f.cardinality == REPEATED:
                    raise SchemaError(f"{s.name}.{f.name}: an attribute cannot be repeated")
                own.append(p)
            self.paths[s.name] = top, tuple(own)

    def __getitem__(self, kind: str) -> Segment:
        for s in self.segments:
            if s.name == kind:
                return s
        raise KeyError(f"no kind of segment is named {kind!r}")

    def only(self, **fields: tuple[str, ...]) -> Schema:
        """Some fields of some kinds, for those who read no others. A kind that encloses another one has to stay with it; what
        is said of completeness and of numbers of segments goes by what is left."""
        return Schema(self.namespaces, tuple(replace(s, fields=tuple(f for f in s.fields if f.name in fields[s.name])) for s in self.segments if s.name in fields))

    def struct(self, kind: str) -> T.StructType:
        """Fields of a kind as they are extracted."""
        out = T.StructType()
        for f in self[kind].fields:
            t = TYPES[f.type]
            if f.validator:
                t = T.StructType().add("value", t).add("error_idx", "int")
            out = out.add(f.name, T.ArrayType(t) if f.cardinality == REPEATED else t)
        return out
