"""Typed segments out of cut ones: casts, field validation, completeness, position and raw fragment."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ERROR_DDL
from ..functions.casts import CASTS
from ..schema import REPEATED, OPTIONAL, Field, Schema

_NO_ERRORS = f"array<{ERROR_DDL}>"


def _error(f: Field, path: str, value: Column) -> Column:
    message = F.concat(F.lit(f"{f.validator.message}: '"), value, F.lit("'"))
    none = F.lit(None).cast("int")
    return F.struct(F.lit("semantic_error").alias("code"), F.lit(f.validator.domain_code).alias("domain_code"), message.alias("message"), F.lit(path).alias("path"), none.alias("line"), none.alias("column"))


# higher-order functions look at the number of parameters, so these close over the rest


def _wrong(f: Field) -> Callable[[Column], Column]:
    return lambda v: ~F.coalesce(f.validator.valid(v), F.lit(False))


def _error_of(f: Field, path: str) -> Callable[[Column], Column]:
    return lambda v: _error(f, path, v)


def _at(marks: Column) -> Callable[[Column, Column], Column]:
    return lambda v, i: marks[i]


def _element(wrong: Column, cast: Callable[[Column], Column], before: Column) -> Callable[[Column, Column], Column]:
    """An element of a repeated validated field; its error comes after those of the elements before it."""
    upto = lambda i: F.size(F.filter(F.slice(wrong, F.lit(1), i), lambda b: b))
    return lambda v, i: F.struct(F.when(~wrong[i], cast(v)).alias("value"), F.when(wrong[i], before + upto(i)).alias("error_idx"))


def extract(cut: DataFrame, schema: Schema, kind: str, keep: tuple[str, ...] = ("doc_ndx",), of: str | None = None) -> DataFrame:
    """The segments of one kind: ``keep``, seg_id, raw, tag, a column per field, errors and complete.

    A scalar is its first occurrence, null if there is none; a repeated field an array of its first
    ten. A validated field is struct(value, error_idx): the value, or the place of its error in
    ``errors``. A field that fails never by itself fails the segment.

    ``of``: the column of kinds in flat segments, of which rows of other kinds stay too, as if they had no texts.
    """
    s, (_, paths) = schema[kind], schema.paths[kind]
    nested = "vals" in cut.columns  # else flat
    own_texts = {}  # of rows of this kind, once for all that look at them
    if of:
        flat = [f"_a{k}" if f.cardinality == REPEATED else f"_s{k}" for k, f in enumerate(s.fields)]
        own_texts = {f"_own{c}": F.when(F.col(of) == kind, F.col(c)) for c in flat}
    text = lambda c: F.col(f"_own{c}" if of else c)
    texts_of = lambda k: F.col("vals")[k] if nested else text(f"_a{k}")
    one_of = lambda k: F.get(texts_of(k), 0) if nested or s.fields[k].cardinality == REPEATED else text(f"_s{k}")
    mine = cut.withColumns(own_texts) if of else cut.where(F.col("kind") == kind)
    # each rule is worked out once, in a projection of its own; what follows only looks at the outcome
    bad, checked = {}, [k for k, f in enumerate(s.fields) if f.validator]
    for k, f in enumerate(s.fields):
        if f.validator:
            wrong = _wrong(f)
            bad[f"_bad{k}"] = F.transform(texts_of(k), wrong) if f.cardinality == REPEATED else one_of(k).isNotNull() & wrong(one_of(k))
    mine = mine.withColumns(bad) if bad else mine
    own, errors, before, found = [], [], F.lit(0), F.lit(True)
    for k, (f, path) in enumerate(zip(s.fields, paths)):
        cast, repeated, one = CASTS[f.type], f.cardinality == REPEATED, one_of(k)
        texts = texts_of(k) if repeated else None
        if f.cardinality != OPTIONAL:
            found = found & (F.size(texts) > 0 if repeated else one.isNotNull())
        if not f.validator:
            own.append((F.transform(texts, cast) if repeated else cast(one)).alias(f.name))
            continue
        wrong, error = F.col(f"_bad{k}"), _error_of(f, str(path))
        if repeated:
            value = F.transform(texts, _element(wrong, cast, before))
            errors.append(F.transform(F.filter(texts, _at(wrong)), error))
            count = F.size(F.filter(wrong, lambda b: b))
        else:
            value = F.when(one.isNotNull(), F.struct(F.when(~wrong, cast(one)).alias("value"), F.when(wrong, before).alias("error_idx")))
            errors.append(F.when(wrong, F.array(error(one))).otherwise(F.array().cast(_NO_ERRORS)).cast(_NO_ERRORS))
            count = wrong.cast("int")
        own.append(value.alias(f.name))
        before = before + count
    none = F.array().cast(_NO_ERRORS)
    listed = F.concat(*errors).cast(_NO_ERRORS) if errors else none
    if errors and all(s.fields[k].cardinality != REPEATED for k in checked):
        listed = F.when(reduce(or_, [F.col(f"_bad{k}") for k in checked]), listed).otherwise(none)  # lists are made where there is something to list
    return mine.select(*keep, "seg_id", "raw", "tag", *own, listed.alias("errors"), found.alias("complete"))


def ruled(segments: DataFrame, schema: Schema, texts: bool = True) -> DataFrame:
    """Flat segments with their rules' outcome, _ok, worked out for all kinds in one pass. Unless ``texts``, only those of
    fields that ``plain`` gives stay, and no raw texts and tags."""
    rows = with_flags(segments).withColumnsRenamed({"kind": "_kind", "fault": "_fault"})  # fields may have these names
    for n, s in enumerate(schema.segments):
        keep = [c for c in rows.columns if c not in ("seg_id", "raw", "tag")]
        ok = F.coalesce(s.rule() if s.rule else F.col("complete"), F.lit(False))
        rows = extract(rows, schema, s.name, tuple(keep), of="_kind").select(*keep, "seg_id", "raw", "tag", F.when(F.col("_kind") == s.name, ok).alias(f"_ok{n}"))
    rows = rows.withColumn("_ok", F.coalesce(*[f"_ok{n}" for n in range(len(schema.segments))]))
    rows = rows.withColumnsRenamed({"_kind": "kind", "_fault": "fault"}).select(*segments.columns, "_ok")
    if texts:
        return rows
    wanted = {}
    for s in schema.segments:
        for k, f in enumerate(s.fields):
            if plain(f):
                wanted.setdefault(f"_s{k}", []).append(s.name)
    none = F.lit(None).cast("string")
    return rows.withColumns({c: F.when(F.col("kind").isin(wanted[c]), F.col(c)) for c in wanted} | {"raw": none, "tag": none}).drop(*[c for c in rows.columns if c[:2] in ("_s", "_a") and c not in wanted])


def ruled_apart(segments: DataFrame, schema: Schema, texts: bool = True) -> DataFrame:
    """``ruled`` kind by kind, for rules in Python: no condition keeps rows of other kinds from them. ``segments`` is read once a kind."""
    out = segments.where("kind is null").withColumn("_ok", F.lit(None).cast("boolean"))
    if not texts:
        out = out.drop(*[c for c in out.columns if c[:2] in ("_s", "_a")])
    for s in schema.segments:
        out = out.unionByName(ruled(segments.where(F.col("kind") == s.name), Schema(schema.namespaces, (s,)), texts), allowMissingColumns=True)
    return out


def has_python(df: DataFrame) -> bool:
    """True if values are worked out by functions in Python (other than those that map batches)."""
    return "EvalPython" in df._jdf.queryExecution().optimizedPlan().toString()


def plain(f: Field) -> bool:
    """Fields that rules of documents may see."""
    return not f.validator and f.cardinality != REPEATED


def with_flags(segments: DataFrame) -> DataFrame:
    """is_first and is_last of each segment of its document. The cutter knows the last one, so nothing is shuffled."""
    return segments.withColumn("is_first", F.col("seg_id") == 0).withColumn("is_last", F.coalesce("is_last", F.lit(False)))


def fragment() -> Column:
    """A segment as a document of its own: its open tag with the namespaces in scope, and the rest."""
    return F.concat("tag", "raw")


def numbered(df: DataFrame, order: list[str], out: str, first: int = 1) -> DataFrame:
    """Consecutive numbers over all rows, for small driver-listed inputs."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)) + (first - 1))
