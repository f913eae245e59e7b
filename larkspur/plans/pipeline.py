"""Aggregation pipelines: a list of one-key documents as a chain of DataFrame transforms.

Rewrites that the optimizer cannot make are made here: a $lookup that is unwound becomes a plain join, one that is only
asked whether it found something a semi or anti join; sorts are applied only where a result, a limit or an ordered
accumulator depends on them; positions are attached only if some stage needs document order; a $skip and the $limit after it are one
top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import column, resolve, set_path
from ..functions.values import is_number, literal
from ..operators.lookup import flat_lookup, lookup, semi_lookup
from .filters import compile_filter
from .group import group, needs_order
from .order import add_level, push_sort, sort_columns, with_position
from .projection import add_fields, hidden, is_inclusion, project, replace_root, schema_of, unset, visible

#: What a caller may register: a stage takes the frame and its argument.
Stage = Callable[["Frame", object], "Frame"]


@dataclass
class Source:
    """A collection as stages see it: its documents, and the columns of their natural order if it has any."""

    df: DataFrame
    natural: list[str] | None = None


@dataclass
class Frame:
    df: DataFrame
    sorted: bool = False
    find: Callable[[str], Source | None] | None = None
    notes: list[str] = field(default_factory=list)

    def on(self, df: DataFrame, **changes) -> Frame:
        return Frame(df, changes.get("sorted", self.sorted), self.find, self.notes)


def whole(x) -> int | None:
    return int(x) if is_number(x) and x == x else None


def _match(f: Frame, x, keep: bool) -> Frame:
    return f.on(f.df.where(compile_filter(x, schema_of(f.df)))) if x else f


def sort_keys(df: DataFrame, spec: dict) -> list:
    """(column, type, ascending) of the paths that exist; a missing value sorts as null."""
    schema, out = schema_of(df), []
    for path, direction in spec.items():
        if (ref := resolve(schema, path)) is not None:
            value = ref.value if ref.present is None else F.when(ref.present, ref.value)
            out.append((value, ref.dtype, not (is_number(direction) and direction < 0)))
    return out


def _sort(f: Frame, x, keep: bool) -> Frame:
    if not keep:
        f.notes.append("sort left out: nothing depends on it")
        return f
    return f.on(push_sort(f.df, sort_keys(f.df, x)), sorted=True)


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*sort_columns(df)) if hidden(df) else df


def _limit(f: Frame, x, keep: bool) -> Frame:
    n = whole(x)
    return f if n is None or n <= 0 else f.on(in_order(f.df).limit(n))


def _skip(f: Frame, x, keep: bool) -> Frame:
    n = whole(x)
    return f if n is None or n <= 0 else f.on(in_order(f.df).offset(n))


def _count(f: Frame, x, keep: bool) -> Frame:
    if not isinstance(x, str) or not x:
        raise ValueError("$count needs a name")
    return f.on(f.df.agg(F.count(F.lit(1)).alias(x)), sorted=False)


def _group(f: Frame, x, keep: bool) -> Frame:
    return f.on(group(f.df, x, keep), sorted=False)


def unwind_spec(x) -> tuple[str, bool]:
    path, preserve = (x.get("path"), x.get("preserveNullAndEmptyArrays") is True) if isinstance(x, dict) else (x, False)
    if not isinstance(path, str) or not path:
        raise ValueError("$unwind needs a path")
    return path.removeprefix("$"), preserve


def _unwind(f: Frame, x, keep: bool) -> Frame:
    path, preserve = unwind_spec(x)
    df = f.df
    ref = resolve(schema_of(df), path)
    if ref is None or not isinstance(ref.dtype, T.ArrayType):  # no document has an array there
        return f if preserve else f.on(df.where(F.lit(False)))
    make = F.posexplode_outer if preserve else F.posexplode
    out = df.select("*", make(ref.value).alias("__at", "__item"))
    top, *rest = path.split(".")
    out = out.withColumn(top, set_path(column(top), df.schema[top].dataType, rest, F.col("__item")) if rest else F.col("__item"))
    if hidden(df):
        out = add_level(out, F.col("__at"))
    return f.on(out.drop("__at", "__item"))


def _lookup(f: Frame, x, keep: bool) -> Frame:
    spec = check_lookup(x)
    return f.on(lookup(f.df, _foreign(f, spec), spec))


def check_lookup(x) -> dict:
    spec = {k: x.get(k, "") for k in ("from", "localField", "foreignField", "as")} if isinstance(x, dict) else {}
    if not all(isinstance(spec.get(k), str) and spec[k] for k in ("from", "as")):
        raise ValueError("$lookup needs from and as")
    return spec


def _foreign(f: Frame, spec: dict) -> Source | None:
    if f.find is None:
        raise ValueError("$lookup needs a database")
    return f.find(spec["from"])


def _unset(f: Frame, x, keep: bool) -> Frame:
    return f.on(unset(f.df, [x] if isinstance(x, str) else [p for p in x if isinstance(p, str)]))


STAGES: dict[str, Callable[[Frame, object, bool], Frame]] = {
    "$match": _match,
    "$project": lambda f, x, keep: f.on(project(f.df, x)),
    "$sort": _sort,
    "$limit": _limit,
    "$skip": _skip,
    "$count": _count,
    "$group": _group,
    "$unwind": _unwind,
    "$addFields": lambda f, x, keep: f.on(add_fields(f.df, x)),
    "$set": lambda f, x, keep: f.on(add_fields(f.df, x)),
    "$unset": _unset,
    "$replaceRoot": lambda f, x, keep: f.on(replace_root(f.df, x)),
    "$lookup": _lookup,
}
#: Stages that work on each document by itself, and so on streams too.
STATELESS = {"$match", "$project", "$addFields", "$set", "$unset", "$unwind", "$replaceRoot"}


def parse(pipeline: list[dict]) -> list[tuple[str, object]]:
    out = []
    for stage in pipeline:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise ValueError("a pipeline stage has exactly one field")
        (name, x), = stage.items()
        if name not in STAGES:
            raise ValueError(f"unknown pipeline stage {name}")
        out.append((name, literal(x)))
    return out


def joined(stages: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """stages without limits and skips that do nothing; skips in a row are one."""
    out: list[tuple[str, object]] = []
    for name, x in stages:
        if name in ("$limit", "$skip") and ((n := whole(x)) is None or n <= 0):
            continue
        if name == "$skip" and out and out[-1][0] == "$skip":
            x = whole(out.pop()[1]) + whole(x)
        out.append((name, x))
    return out


def needs(stages: list[tuple[str, object]]) -> list[bool]:
    """For each stage, and for the result: whether document order after it matters to a later one."""
    out = [False] * (len(stages) + 1)
    later = False
    for i in range(len(stages) - 1, -1, -1):
        out[i + 1] = later
        name, x = stages[i]
        if name in ("$limit", "$skip"):
            n = whole(x)
            later = later or n is not None and n > 0
        elif name == "$group":
            later = needs_order(x) or later
        elif name == "$count":
            later = False
    out[0] = later
    return out


def _result_sorted(stages: list[tuple[str, object]]) -> bool:
    names = [n for n, _ in stages]
    last = max((i for i, n in enumerate(names) if n in ("$group", "$count")), default=-1)
    return "$sort" in names[last + 1 :]


def _drops(stage: tuple[str, object] | None, name: str) -> bool:
    """Whether the stage gives nothing of the field `name`."""
    if stage is None:
        return False
    op, x = stage
    if op == "$unset":
        return name in ([x] if isinstance(x, str) else x)
    if op == "$project":
        if is_inclusion(x):
            return not any(k.split(".")[0] == name and is_number(v) and v != 0 for k, v in x.items())
        return x.get(name) == 0 and is_number(x[name])
    return op == "$count"


def run(source: Source, pipeline: list[dict], find: Callable[[str], Source | None] | None = None) -> Frame:
    stages, i = joined(parse(pipeline)), 0
    after, final = needs(stages), _result_sorted(stages)
    df = source.df
    if after[0] or final and any(n == "$sort" for n, _ in stages):
        df = with_position(df, source.natural)
    frame = Frame(df, False, find)
    last_sort = max((k for k, (n, _) in enumerate(stages) if n == "$sort"), default=-1)
    while i < len(stages):
        name, x = stages[i]
        following = stages[i + 1] if i + 1 < len(stages) else None
        keep = after[i + 1] or final and i >= last_sort
        if name == "$lookup" and following is not None:
            spec = check_lookup(x)
            if following[0] == "$unwind" and unwind_spec(following[1])[0] == spec["as"]:
                frame = frame.on(flat_lookup(frame.df, _foreign(frame, spec), spec, unwind_spec(following[1])[1]))
                frame.notes.append("lookup and unwind as one join")
                i += 2
                continue
            test = following[1].get(spec["as"]) if following[0] == "$match" and isinstance(following[1], dict) and len(following[1]) == 1 else None
            none, some = test == {"$size": 0} or test == {"$eq": []} or test == [], test == {"$ne": []}
            if none or some and _drops(stages[i + 2] if i + 2 < len(stages) else None, spec["as"]):
                frame = frame.on(semi_lookup(frame.df, _foreign(frame, spec), spec, anti=none))
                frame.notes.append("lookup and match as a semi or anti join")
                i += 2
                continue
        if name == "$skip" and following is not None and following[0] == "$limit":  # no sort between them, so that they are one top-k
            frame = frame.on(in_order(frame.df).offset(whole(x)).limit(whole(following[1])))
            frame.notes.append("skip and limit as one top-k")
            i += 2
            continue
        frame = STAGES[name](frame, x, keep)
        i += 1
    return frame


def aggregate(source: Source, pipeline: list[dict], find: Callable[[str], Source | None] | None = None) -> DataFrame:
    frame = run(source, pipeline, find)
    df = in_order(frame.df) if frame.sorted else frame.df
    return df.select(*[column(c) for c in visible(df)])


def find(source: Source, filter_: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
    """Filter, then sort, skip, limit and projection in this order."""
    stages: list[dict] = [{"$match": filter_ or {}}]
    stages += [{"$sort": sort}] if sort else []
    stages += [{"$skip": skip}] if skip else []
    stages += [{"$limit": limit}] if limit else []
    stages += [{"$project": projection}] if projection else []
    return aggregate(source, stages)

