"""References to records that do not exist.

Parents' keys are range-partitioned by their 64-bit digest and kept as sorted arrays, one row a range; batches of
references are sent to their range and probed with a vectorised binary search. A digest spreads any key distribution
evenly over the ranges, so no range of parents is large. References are not evenly spread: a key may hold a third of
all rows, so a range with many references is split over salts and its array is repeated for each.

Defined results: a null or blank reference is no case. A null id of a referring row is dropped (there is nothing to
report). Deliveries of one referring id count once for each different key; its time is the earliest of all its
deliveries. A parent without a time counts as there from the start. Extra columns are ignored; column names are
parameters, so clashes between the tables don't matter. Empty tables give empty results (all references missing, if
only the parents are empty).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandmill.functions.keys import comparable_key

#: Parent keys to a range (an array of so many digests, keys and times is a few MB) and references to one probe.
KEYS_PER_RANGE, REFERENCES_PER_PROBE = 5_000, 100_000
MAX_RANGES = 1 << 20

FOUND, DELETED = 1, 2
KINDS = np.array(["", "late", "deleted", "missing"], dtype=object)


@dataclass(frozen=True)
class Reference:
    """A column of a table that names records of a parent table."""

    table_name: str
    rows: DataFrame
    reference: str
    parent_name: str
    record_id: str = "id"
    loaded_at: str = "loaded_at"


@dataclass(frozen=True)
class Parent:
    table_name: str
    rows: DataFrame
    key: str = "id"
    loaded_at: str = "loaded_at"


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def parent_state(parents: list[Parent], deleted: DataFrame | None) -> DataFrame:
    """parent_name, ref_key, state (1 there, 2 deleted; both bits possible), first_us: one row a key, combined before the shuffle."""
    frames = [p.rows.select(F.lit(p.table_name).alias("parent_name"), comparable_key(p.key).alias("ref_key"), F.lit(FOUND).alias("state"), _micros(p.loaded_at).alias("first_us"), F.col(p.loaded_at).isNull().alias("always")) for p in parents]
    if deleted is not None:
        frames.append(deleted.select(F.col("table_name").alias("parent_name"), comparable_key("deleted_id").alias("ref_key"), F.lit(DELETED).alias("state"), F.lit(None).cast("long").alias("first_us"), F.lit(False).alias("always")))
    rows = _union(frames).filter(F.col("ref_key").isNotNull() & (F.col("ref_key") != ""))
    grouped = rows.groupBy("parent_name", "ref_key").agg(F.bit_or("state").alias("state"), F.min("first_us").alias("first_us"), F.max("always").alias("always"))
    return grouped.select("parent_name", "ref_key", "state", F.when(F.col("always"), F.lit(None)).otherwise(F.col("first_us")).alias("first_us"))


def reference_rows(references: list[Reference]) -> DataFrame:
    """table_name, parent_name, record_id, ref_key, first_us: one row for each key that a record refers to."""
    raw = _union([r.rows.select(F.lit(r.table_name).alias("table_name"), F.lit(r.parent_name).alias("parent_name"), F.col(r.record_id).cast("string").alias("record_id"), comparable_key(r.reference).alias("ref_key"), _micros(r.loaded_at).alias("us")) for r in references])
    raw = raw.filter(F.col("record_id").isNotNull())
    first = raw.groupBy("table_name", "record_id", "parent_name").agg(F.min("us").alias("first_us"))
    pairs = raw.filter(F.col("ref_key").isNotNull() & (F.col("ref_key") != "")).select("table_name", "record_id", "parent_name", "ref_key").distinct()
    return pairs.join(first, ["table_name", "record_id", "parent_name"])


def _probe(parents: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
    """Orphans among one batch: binary search on digests, then the keys themselves are compared."""
    n = len(refs)
    state, first = np.zeros(n, dtype=np.int64), np.full(n, np.nan)
    if len(parents) and n:
        row = parents.iloc[0]
        digests, keys = np.asarray(row["digests"], dtype=np.int64), np.asarray(row["keys"], dtype=object)
        states, firsts = np.asarray(row["states"], dtype=np.int64), np.asarray(row["firsts"], dtype=np.float64)
        wanted, names = refs["digest"].to_numpy(np.int64), (refs["parent_name"] + "\x1f" + refs["ref_key"]).to_numpy(object)
        at, last = np.searchsorted(digests, wanted, "left"), np.searchsorted(digests, wanted, "right")
        open_ = at < last
        while open_.any():
            i = np.flatnonzero(open_)
            same = keys[at[i]] == names[i]
            hit = i[same]
            state[hit], first[hit] = states[at[hit]], firsts[at[hit]]
            at[i] += 1
            open_[hit] = False
            open_ &= at < last
    own = refs["first_us"].to_numpy(np.float64, na_value=np.nan)
    there = (state & FOUND) > 0
    with np.errstate(invalid="ignore"):
        late = there & (first > own)
    kind = np.where(late, 1, np.where(there, 0, np.where((state & DELETED) > 0, 2, 3)))
    keep = kind > 0
    return pd.DataFrame({"table_name": refs["table_name"][keep], "record_id": refs["record_id"][keep], "ref_key": refs["ref_key"][keep], "orphan_kind": KINDS[kind[keep]], "first_us": refs["first_us"][keep].astype("Int64")})


def find_orphans(references: list[Reference], parents: list[Parent], deleted: DataFrame | None = None, keys_per_range: int = KEYS_PER_RANGE, references_per_probe: int = REFERENCES_PER_PROBE) -> DataFrame:
    """table_name, record_id, ref_key, orphan_kind, first_loaded_at of every reference whose key is late, deleted or missing.

    late: the key is among the parents, but its earliest time is after the earliest time of the referring id;
    deleted: only in `deleted` (table_name, deleted_id); missing: in neither. `parents` may be given per period.
    """
    state = parent_state(parents, deleted)
    spark = state.sparkSession
    wanted = max(1, -(-state.count() // keys_per_range))
    bits = min(MAX_RANGES.bit_length() - 1, (wanted - 1).bit_length())
    digest = F.xxhash64("parent_name", "ref_key")
    # The upper bits of the digest name its range: ranges of the digests' order, of equal width.
    range_of = F.shiftrightunsigned(F.col("digest"), 64 - bits).cast("int") if bits else F.lit(0)
    refs = reference_rows(references).withColumn("digest", digest).withColumn("range_id", range_of)
    # At most references / references_per_probe rows: two small numbers for each range that needs salts.
    hot = [(r["range_id"], -(-r["n"] // references_per_probe)) for r in refs.groupBy("range_id").agg(F.count("*").alias("n")).filter(F.col("n") > references_per_probe).collect()]
    salts = spark.createDataFrame(hot, "range_id int, salts int")
    arrays = state.withColumn("digest", digest).withColumn("range_id", range_of).groupBy("range_id").agg(F.sort_array(F.collect_list(F.struct("digest", F.concat_ws("\x1f", "parent_name", "ref_key").alias("key"), "state", F.col("first_us").cast("double").alias("first")))).alias("a"))
    arrays = arrays.join(F.broadcast(salts), "range_id", "left").select("range_id", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.col("a.digest").alias("digests"), F.col("a.key").alias("keys"), F.col("a.state").alias("states"), F.transform("a.first", lambda x: F.coalesce(x, F.lit(float("-inf")))).alias("firsts"))
    salted = refs.join(F.broadcast(salts), "range_id", "left").withColumn("salt", F.pmod(F.xxhash64("record_id", "table_name"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    found = arrays.groupBy("range_id", "salt").cogroup(salted.groupBy("range_id", "salt")).applyInPandas(_probe, "table_name string, record_id string, ref_key string, orphan_kind string, first_us long")
    return found.select("table_name", "record_id", "ref_key", "orphan_kind", F.timestamp_micros("first_us").cast("timestamp_ntz").alias("first_loaded_at"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """table_name, month, orphan_kind, n_records, n_keys: misses by referring table and month of the record's earliest time ('' if unknown)."""
    month = F.coalesce(F.date_format(F.col("first_loaded_at").cast("timestamp"), "yyyy-MM"), F.lit(""))
    return orphans.groupBy("table_name", month.alias("month"), "orphan_kind").agg(F.count_distinct("record_id").alias("n_records"), F.count_distinct("ref_key").alias("n_keys"))
