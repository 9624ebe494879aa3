"""Differences between two copies of a table, by hierarchical checksums over key ranges.

A row's token orders it: its high bits are the place of the first key within the range of that key on both sides,
its low bits a hash of all keys.  Both sides are digested once over token ranges of about RANGE_ROWS rows (a count,
a sum and an xor of row hashes); the digests are rolled up and compared from the root, and only the children of
mismatched ranges are compared further.  A mismatched range that holds many rows is digested again over finer
ranges of its own, however many there are.  The rows of the mismatched ranges of both sides then meet, range by
range, and are bisected further in place, down to leaves of a few rows; fields are compared for the rows of
mismatched leaves alone.  Everything stays in tables: the driver sees only how many ranges are open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage

#: Rows that a range of the first digest holds on average, that an open range may hold, and that a leaf should.
RANGE_ROWS, MOST_ROWS, LEAF_ROWS = 64, 1_024, 4
#: Bits by which open ranges are cut further: the low ones of the keys' hash, whose high ones are in the token.
LEAF_BITS = (MOST_ROWS // LEAF_ROWS).bit_length() + 1
#: Bits of a token, bits of the first key's place in it at most, and bits between two compared levels.
TOKEN_BITS, PLACE_BITS, STEP = 62, 24, 6


def _text(c: Column) -> Column:
    """Hashing skips nulls; here they count."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _number(df: DataFrame, key: str) -> Column:
    """A key as a number that orders it; nought for types without an order of their own."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(key).cast("timestamp").cast("double")
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(F.col(key).cast("double")), F.col(key).cast("double"))
    if isinstance(kind, T.StringType):
        return F.conv(F.substring(F.rpad(F.hex(F.col(key)), 12, "0"), 1, 12), 16, 10).cast("double")
    return F.lit(0.0)


def _prepared(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Both sides as (keys, fields, __token, __hash) in staged tables, and the rows of the larger."""
    sides = []
    for df, name in ((left, "left"), (right, "right")):
        rows = df.select(*keys, *fields)
        rows = rows.withColumns({"__at": _number(rows, keys[0]), "__key": F.xxhash64(*[_text(F.col(k)) for k in keys]), "__hash": F.xxhash64(*[_text(F.col(c)) for c in keys + fields])})
        sides.append(storage.staged(rows, name))
    span = sides[0].select("__at", F.lit(0).alias("side")).unionByName(sides[1].select("__at", F.lit(1).alias("side")))
    finite = F.when(F.abs("__at") < 1e300, F.col("__at"))
    r = span.agg(F.min(finite).alias("low"), F.max(finite).alias("high"), F.greatest(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).alias("n")).first()
    low, width = r["low"] or 0.0, max(1.0, (r["high"] or 0.0) - (r["low"] or 0.0) + 1)
    bits = min(PLACE_BITS, max(0, (int(width) - 1).bit_length()))
    # Whole numbers of a small range keep a place each; wider ones share places evenly.
    scale = 1.0 if width <= 1 << PLACE_BITS else (1 << PLACE_BITS) / width
    place = F.least(F.greatest(F.floor((F.coalesce("__at", F.lit(low)) - low) * scale), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    token = F.shiftleft(place, TOKEN_BITS - bits).bitwiseOR(F.shiftrightunsigned("__key", 64 - TOKEN_BITS + bits))
    return *[s.withColumn("__token", token).drop("__at") for s in sides], r["n"]


def _digests(df: DataFrame, bits: int) -> DataFrame:
    """(range, n, total, mix): token ranges of ``bits`` bits with their checksums."""
    at = F.shiftrightunsigned("__token", TOKEN_BITS - bits)
    return df.groupBy(at.alias("range")).agg(F.count("*").alias("n"), F.sum(F.col("__hash").cast("decimal(38,0)")).alias("total"), F.bit_xor("__hash").alias("mix"))


def _rolled(digests: DataFrame, by: int) -> DataFrame:
    """The digests of ranges that many bits coarser."""
    return digests.groupBy(F.shiftrightunsigned("range", by).alias("range")).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mix").alias("mix")) if by else digests


def _compared(a: DataFrame, b: DataFrame, within: DataFrame | None, by: int) -> DataFrame:
    """(range, n): ranges whose checksums differ, of those whose ancestor ``by`` bits up is open; n counts both sides' rows."""
    if within is not None:
        a, b = (d.withColumn("up", F.shiftrightunsigned("range", by)).join(within.select(F.col("range").alias("up")), "up", "left_semi").drop("up") for d in (a, b))
    both = a.select("range", "n", "total", "mix").join(b.select("range", F.col("n").alias("n2"), F.col("total").alias("total2"), F.col("mix").alias("mix2")), "range", "full_outer")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}2")) for c in ("n", "total", "mix")))
    return both.where(~same).select("range", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"))


def open_ranges(left: DataFrame, right: DataFrame, rows: int) -> list[tuple[int, DataFrame]]:
    """(bits, ranges) of the mismatched token ranges, each of at most MOST_ROWS rows unless its token can't be cut further."""
    bits = min(TOKEN_BITS, (max(1, rows // RANGE_ROWS) - 1).bit_length())
    a, b = (storage.staged(_digests(d, bits), "digests") for d in (left, right))
    level = bits % STEP
    found = _compared(_rolled(a, bits - level), _rolled(b, bits - level), None, 0)
    while level < bits:
        found = storage.staged(found, "open")
        level += STEP
        found = _compared(_rolled(a, bits - level), _rolled(b, bits - level), found, STEP)
    out = []
    while True:
        found = storage.staged(found, "open")
        small = found if bits == TOKEN_BITS else found.where(F.col("n") <= MOST_ROWS)
        out.append((bits, small.select("range")))
        large = found.where(F.col("n") > MOST_ROWS)
        if bits == TOKEN_BITS or large.isEmpty():
            return out
        finer = min(TOKEN_BITS, bits + STEP)
        found = _compared(*[_digests(_within(d, large.select("range"), bits), finer) for d in (left, right)], None, 0)
        bits = finer


def _within(df: DataFrame, ranges: DataFrame, bits: int) -> DataFrame:
    return df.withColumn("range", F.shiftrightunsigned("__token", TOKEN_BITS - bits)).join(ranges, "range", "left_semi")


def mismatched(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows (keys, fields) in mismatched leaves."""
    a, b, rows = _prepared(left, right, keys, fields)
    sides = [d.withColumn("__side", F.lit(s)) for d, s in ((a, 1), (b, -1))]
    leaves = []
    for bits, ranges in open_ranges(a, b, rows):
        # Both sides' rows of a range meet in one task and stay there: windows over finer parts of a range need no other shuffle.
        met = _within(sides[0].unionByName(sides[1]), ranges, bits).repartition("range")
        for fine in range(2, LEAF_BITS + 1, 2):
            of = W.partitionBy("range", F.col("__key").bitwiseAND(F.lit((1 << fine) - 1).cast("long")))
            signed = F.sum(F.col("__hash").cast("decimal(38,0)") * F.col("__side")).over(of)
            met = met.withColumns({"__sum": signed, "__mix": F.bit_xor("__hash").over(of)}).where("__sum <> 0 or __mix <> 0").drop("__sum", "__mix")
        leaves.append(met)
    found = storage.staged(reduce(DataFrame.unionByName, leaves), "leaves")
    return tuple(found.where(F.col("__side") == s).select(*keys, *fields) for s in (1, -1))


def differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], missing_right: str = "missing_right", missing_left: str = "missing_left") -> DataFrame:
    """(keys..., issue): rows that a side lacks and, where both have it, the name of each field that differs.

    Keys must be unique on each side and are compared null-safely; null against a value differs, null against
    null doesn't.  Other columns are ignored.  Two empty tables give no rows.
    """
    a, b = mismatched(left, right, keys, fields)
    l, r = a.withColumn("__l", F.lit(True)).alias("l"), b.withColumn("__r", F.lit(True)).alias("r")
    both = l.join(r, reduce(lambda x, y: x & y, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys)), "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    issues = F.when(F.col("__r").isNull(), F.array(F.lit(missing_right))).when(F.col("__l").isNull(), F.array(F.lit(missing_left))).otherwise(changed)
    return both.select(*[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys], F.explode(issues).alias("issue"))
