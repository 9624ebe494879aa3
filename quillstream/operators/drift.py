"""Payloads whose shape drifts: a catalogue of columns, their lifespans, one typed table and a report of changes.

Each payload's own schema serves as its footer.  Schemas repeat, so everything that looks at names and types
works on the few distinct shapes; rows meet the outcome by a join on the shape.  The catalogue explodes shapes
into (path, type) and counts them per producer and file; gaps between files, found by lag, cut a column's
presence into islands, whose starts and endings are the log of drift.  An alias table says under which
names and where a field may also be held, and gives the casts into the one consistent table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage


@dataclass(frozen=True)
class Field:
    """A field of the contract: where it sits, its JSON type, and other names it goes by (compared without case and punctuation)."""

    name: str
    place: tuple[str, ...]
    kind: str
    aliases: frozenset[str] = frozenset()
    #: Keys that hold an object of this field's value, by normalised name of the key inside.
    inner: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    #: Names of keys that belong to the contract, wherever they are.
    known: frozenset[str]
    #: Objects whose inside holds none of the fields.
    closed: frozenset[str] = field(default_factory=frozenset)


def _norm(key: str) -> str:
    return re.sub(r"[^0-9a-z]", "", key.casefold())


#: The payment event's first version, with the keys of the second (fixed values of the format).
PAYMENTS = Contract(
    fields=(
        Field("order_id", ("data", "object", "order_id"), "string", frozenset("orderid orderref orderno ordernumber purchaseref purchaseid purchaseorder order".split())),
        Field("amount", ("data", "object", "amount"), "integer", frozenset("amount amountminor amountcents amountvalue minoramount totalminor total amt".split()), frozenset({"value"})),
        Field("currency", ("data", "object", "currency"), "string", frozenset("currency currencycode curr ccy cur".split()), frozenset({"code"})),
        Field("api_version", ("api_version",), "string", frozenset("apiversion version apiver schemaversion".split())),
    ),
    known=frozenset("id type api_version created data object order_id amount currency refund charge metadata value".split()),
    closed=frozenset({"refund"}),
)


def shape(raw: Column) -> Column:
    """The payload's own schema as text; null where the line isn't valid JSON."""
    return F.schema_of_variant(F.try_parse_json(raw))


# A shape is text like OBJECT<a: BIGINT, b: ARRAY<OBJECT<`c d`: STRING>>>.
_TOKEN = re.compile(r"\s*(?:(OBJECT<)|(ARRAY<)|(>)|(,)|`((?:[^`]|``)*)`\s*:|([^\s:<>,`]+)\s*:(?!\()|([A-Z_]+(?:\([^)]*\))?(?: [A-Z]+)*))")


def parse_shape(text: str):
    """An object as a dict, an array as a one-element list, a scalar as its JSON type; null as None."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a shape: {text[at : at + 40]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def value():
        nonlocal pos
        m = tokens[pos]
        pos += 1
        if m[1]:
            out = {}
            while not tokens[pos][3]:
                if tokens[pos][4]:
                    pos += 1
                    continue
                k = tokens[pos]
                pos += 1
                out[k[5].replace("``", "`") if k[5] is not None else k[6]] = value()
            pos += 1
            return out
        if m[2]:
            inner = value()
            pos += 1
            return [inner]
        kind = re.match(r"[A-Z_]+", m[7])[0]
        return {"BIGINT": "integer", "VOID": None, "STRING": "string", "BOOLEAN": "boolean"}.get(kind, "number")

    return value()


def _kind(v) -> str:
    return "object" if isinstance(v, dict) else "array" if isinstance(v, list) else v


def _walk(v, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """Every present value below ``v`` with its path; array elements are at '[]'."""
    for key, x in v.items() if isinstance(v, dict) else [("[]", v[0])] if isinstance(v, list) else []:
        if x is not None:
            yield (*path, key), x
            yield from _walk(x, (*path, key))


def _look(v, place: tuple[str, ...]):
    for key in place:
        v = v.get(key) if isinstance(v, dict) else None
    return v


def held(tree, f: Field, contract: Contract) -> tuple[tuple[str, ...], object] | None:
    """Where a field is held: its place, else its own name or an alias elsewhere, nearest to the top. Nothing below a closed object counts, nor do another field's insides, except that a field may lie in an object at a sibling's place."""
    at = _look(tree, f.place)
    if at is not None:
        return f.place, at
    found = []
    for path, x in _walk(tree):
        if any(_norm(k) in contract.closed for k in path[:-1]) or "[]" in path:
            continue
        name = _norm(path[-1])
        exact = path[-1] == f.name or name == _norm(f.name)
        if exact or name in f.aliases and path[-1] not in contract.known:
            found.append((not exact, len(path), path, x))
    return min(found, key=lambda c: c[:3])[2:] if found else None


def role(path: tuple[str, ...], contract: Contract) -> tuple[str | None, int, bool]:
    """What the alias table makes of a column: (field that it may hold, how well it is placed, whether its name is new). Places rank 0, own names elsewhere 1, aliases 2."""
    if path[-1] == "[]":
        return None, 0, False
    new = path[-1] not in contract.known
    shut = "[]" in path or any(_norm(k) in contract.closed for k in path[:-1])
    for f in contract.fields:
        if path == f.place:
            return f.name, 0, False
    for f in contract.fields if not shut else ():
        name = _norm(path[-1])
        if path[-1] == f.name or name == _norm(f.name):
            return f.name, 1, new
        if name in f.aliases and new:
            return f.name, 2, new
    return None, 0, new


#: Parts the keys of a path in tables.
DOT = "\x1f"


def _shape_columns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = [(s, DOT.join(p), _kind(x)) for s in pdf["shape"] for p, x in _walk(parse_shape(s))]
        yield pd.DataFrame(rows, columns=["shape", "path", "json_type"])


def _roles(contract: Contract):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(p, *role(tuple(p.split(DOT)), contract)) for p in pdf["path"]]
            yield pd.DataFrame(rows, columns=["path", "field", "placed", "new_name"])

    return run


def footers(payloads: DataFrame, raw: str, keep: list[str]) -> DataFrame:
    """Rows of valid JSON with their shape; other lines are left out."""
    return payloads.select(*keep, shape(F.col(raw)).alias("shape")).where("shape is not null")


class Catalogue:
    """Footers counted per producer and file, and the columns of the distinct shapes: two tables that are small beside the rows."""

    def __init__(self, foots: DataFrame, producer: str, file: str) -> None:
        """``foots`` is read once. A null producer or file is one like others, named ''."""
        named = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        self.counted = storage.staged(foots.select(named(producer), named(file), "shape").groupBy(F.col(producer).alias("producer"), F.col(file).alias("file"), "shape").agg(F.count("*").alias("n")), "footers")
        self.shapes = storage.staged(self.counted.select("shape").distinct().mapInPandas(_shape_columns, "shape string, path string, json_type string"), "shapes")

    def columns(self) -> DataFrame:
        """(producer, file, path, json_type, n_rows)."""
        return self.counted.join(self.shapes, "shape").groupBy("producer", "file", "path", "json_type").agg(F.sum("n").cast("long").alias("n_rows"))

    def files(self) -> DataFrame:
        """(producer, file, nth): a producer's files in order of name; their number is bounded by the files, not by the rows."""
        return self.counted.select("producer", "file").distinct().withColumn("nth", F.row_number().over(W.partitionBy("producer").orderBy("file")))

    def lifespans(self) -> DataFrame:
        return lifespans(self.columns(), self.files())


def lifespans(columns: DataFrame, files: DataFrame) -> DataFrame:
    """Islands of a column's presence per producer, path and type: (producer, path, json_type, island, first_file, last_file, n_files, n_rows, started, ended).

    ``files`` has (producer, file, nth): the producer's files in order.  An island starts where the file before, by
    lag, lacks the column; ``started`` is false where it begins with the producer's first file, ``ended`` where it runs
    to the last.
    """
    of = W.partitionBy("producer", "path", "json_type").orderBy("nth")
    placed = columns.join(files, ["producer", "file"])
    gaps = placed.withColumn("new", (F.col("nth") - F.coalesce(F.lag("nth").over(of), F.lit(-2)) > 1).cast("int"))
    islands = gaps.withColumn("island", F.sum("new").over(of))
    last = files.groupBy("producer").agg(F.max("nth").alias("last_nth"))
    spans = islands.groupBy("producer", "path", "json_type", "island").agg(F.min_by("file", "nth").alias("first_file"), F.max_by("file", "nth").alias("last_file"), F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.min("nth").alias("a"), F.max("nth").alias("z"))
    return spans.join(last, "producer").select("producer", "path", "json_type", F.col("island").cast("long"), "first_file", "last_file", "n_files", F.col("n_rows").cast("long"), (F.col("a") > 1).alias("started"), (F.col("z") < F.col("last_nth")).alias("ended"))


def changes(foots: DataFrame, record: str, producer: str, file: str, contract: Contract = PAYMENTS) -> DataFrame:
    """(record, field_name, change_kind) of each row: what the lifespans that cover its columns say by the alias table.

    The catalogue's lifespans are judged, the columns of one producer, path and type alike; a footer's columns are looked
    up in the lifespans of its producer.  Of the columns that may hold a field the best placed, nearest to the top, first by name,
    holds it: a field without one is removed, one at another place relocated, one of another type retyped.  A new name
    is added unless it holds, contains or lies inside a field's value or another new name.  JSON null is absence.

    Footers are judged once for each producer and shape; rows meet the outcome by a join whose larger side is
    never grouped, so that a shape which a third of all rows share is a matter of AQE's split of the skewed join.
    ``foots`` should be a table: it is read twice, and parsed only where it was made.
    """
    known = Catalogue(foots, producer, file)
    spans = storage.staged(known.lifespans(), "lifespans")
    roles = spans.select("path").distinct().mapInPandas(_roles(contract), "path string, field string, placed int, new_name boolean")
    kinds = F.create_map(*[F.lit(x) for f in contract.fields for x in (f.name, f.kind)])
    judged = spans.select("producer", "path", "json_type").distinct().join(roles, "path").select("producer", "path", "json_type", "field", "placed", "new_name", (F.col("json_type") != kinds[F.col("field")]).alias("retyped"))
    shapes = known.counted.select("producer", "shape").distinct()
    facts = shapes.join(known.shapes, "shape").join(judged, ["producer", "path", "json_type"])
    # One row per footer: its columns that hold a field or have a new name, bounded by the columns of one payload.
    held_in = F.struct("field", "placed", F.size(F.split("path", DOT)).alias("depth"), "path", "retyped")
    per = facts.groupBy("producer", "shape").agg(F.sort_array(F.collect_set(F.when(F.col("field").isNotNull(), held_in))).alias("holds"), F.sort_array(F.collect_set(F.when(F.col("new_name"), F.col("path")))).alias("names"))
    per = shapes.join(per, ["producer", "shape"], "left")
    of = lambda name: F.array_min(F.filter("holds", lambda h: h["field"] == name))
    best = [of(f.name) for f in contract.fields]
    per = per.withColumn("spots", F.array(*best))
    found = []
    for k, f in enumerate(contract.fields):
        spot = F.get("spots", F.lit(k))
        found += [F.when(spot.isNull(), F.struct(F.lit(f.name).alias("field_name"), F.lit("removed").alias("change_kind")))]
        found += [F.when(spot["placed"] > 0, F.struct(F.lit(f.name).alias("field_name"), F.lit("relocated").alias("change_kind"))), F.when(spot["retyped"], F.struct(F.lit(f.name).alias("field_name"), F.lit("retyped").alias("change_kind")))]
    inside = lambda a, b: (a == b) | a.startswith(F.concat(b, F.lit(DOT)))
    paths = F.transform(F.filter("spots", lambda s: s.isNotNull()), lambda s: s["path"])
    own = F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda p: ~F.exists(paths, lambda s: inside(s, p) | inside(p, s)))
    per = per.withColumn("own", own)
    outer = F.filter("own", lambda p: ~F.exists("own", lambda q: (p != q) & inside(p, q)))
    added = F.transform(outer, lambda p: F.struct(F.element_at(F.split(p, DOT), -1).alias("field_name"), F.lit("added").alias("change_kind")))
    outcome = per.select("producer", "shape", F.array_distinct(F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), added)).alias("found")).where(F.size("found") > 0)
    rows = foots.select(record, F.coalesce(F.col(producer), F.lit("")).alias("producer"), "shape")
    return rows.join(outcome, ["producer", "shape"]).select(record, F.inline("found"))


def _places(pdf_shapes: list[str], contract: Contract) -> list[tuple]:
    rows = []
    for s in pdf_shapes:
        tree = parse_shape(s)
        spots = []
        for f in contract.fields:
            spot = held(tree, f, contract)
            path = list(spot[0]) if spot else []
            if spot and isinstance(spot[1], dict):  # the value sits one level down
                path += [next((k for k, x in spot[1].items() if _norm(k) in f.inner | {_norm(f.name)} and x is not None), "")]
            elif spot and isinstance(spot[1], list):
                path += ["[0]"]
            spots.append("$" + "".join(k if k == "[0]" else f"['{k}']" for k in path) if spot else None)
        rows.append((s, *spots))
    return rows


def unified(payloads: DataFrame, raw: str, keep: list[str], contract: Contract = PAYMENTS) -> DataFrame:
    """One table of the contract's fields, whatever the shape: text taken from where the shape holds it, amounts as whole numbers.

    Columns: ``keep`` and one string per field.  Absent fields are null; amounts with a fraction are units and are
    multiplied by 100, as the alias table's cast of a non-integer number says.
    """
    names = [f.name for f in contract.fields]

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame(_places(list(pdf["shape"]), contract), columns=["shape", *[f"at_{n}" for n in names]])

    foots = footers(payloads, raw, [*keep, raw])
    at = foots.select("shape").distinct().mapInPandas(places, "shape string, " + ", ".join(f"at_{n} string" for n in names))
    rows = foots.join(at, "shape")
    value = {f.name: F.call_function("get_json_object", F.col(raw), F.col(f"at_{f.name}")) for f in contract.fields}
    whole = lambda v: F.when(v.rlike(r"^-?\d+$"), v).otherwise(F.round(v.try_cast("decimal(30,6)") * 100).cast("long").cast("string"))
    cast = {f.name: whole(value[f.name]) if f.kind == "integer" else value[f.name] for f in contract.fields}
    return rows.select(*keep, *[cast[n].alias(n) for n in names])


def dumps(contract: Contract) -> str:
    """The alias table as JSON, for a log."""
    return json.dumps({f.name: {"place": ".".join(f.place), "type": f.kind, "aliases": sorted(f.aliases)} for f in contract.fields})
