"""Product codes of vectors by Lloyd's rounds with Yinyang bounds, in whole numbers throughout.

A component x is the integer floor(SCALE * x). A vector is cut in PARTS equal parts, each with a codebook
of its own: ENTRIES entries, at first that part of the vectors of least vec_id. A round gives every
part its nearest entry, then each entry becomes the mean of its parts (componentwise, rounded down).

Yinyang: the entries of a codebook are clustered in GROUPS groups once, at the start. Every part of a
vector keeps its entry and, for each group, a lower bound on the distance to the group's other
entries. In a round the bounds sink by the group's largest drift, rounded up; a group is scanned only
if its bound does not exceed the distance to the present entry. Both sides are compared as integers
(a bound squared against an exact squared distance), so a group that could tie is always scanned, and
ties go to the lower index by exact distances. Skipping changes no result.

A round is one pass: a task writes its vectors with their entries and bounds, and one row with its
sums, which travel as limbs of 32 bits, so that they are exact for any finite input. Spark adds them; the driver only holds
the codebooks. Each round's table is deleted once the next is written.

Edge cases: rows whose vector is null or has null or non-finite components are dropped. All others
count: the dimension is the longest vector's, rounded up to a multiple of PARTS, and shorter vectors
are continued by zeros, so an empty vector is all zeros. Integers of 2^24 or more take exact arithmetic
of unbounded integers. Fewer than ENTRIES rows give as many entries. Repeated vec_ids are rows of
their own; among them the initial entries are those of least vector. A null vec_id comes after all others. Entries
that no part chose stay. An error beyond a long is the greatest long; a label_error beyond it is null. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import broadcast_if_small, dropped, small_batches, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
GROUPS = 4
ROWS = 4096
#: Greatest magnitude for which squared distances of parts and sums over a batch stay exact in 64 bits.
NARROW = 1 << 24
LIMB = 32
NONE = 255  # no entry yet
BOUND_MAX = np.iinfo(np.uint16).max


def finite(vector: str):
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite x."""
    return math.floor(SCALE * x) if abs(x) < 2.0**1000 else int(x) * SCALE


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of width integers: of 64 bits, or of any size where one is beyond NARROW."""
    starts = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.arange(starts[0], starts[-1])
    row = np.repeat(np.arange(len(vectors)), np.diff(starts))
    with np.errstate(over="ignore"):
        scaled = np.floor(flat[at] * SCALE)
    if not len(scaled) or np.abs(scaled).max() < NARROW:
        out, values = np.zeros((len(vectors), width), np.int64), scaled.astype(np.int64)
    else:
        out, values = np.zeros((len(vectors), width), object), np.array([whole(x) for x in flat[at].tolist()], object)
    out[row, at - starts[row]] = values
    return out


class Codebooks:
    """Entries by part (PARTS x entries x width of a part), their groups, and the drift of the last round by group, rounded up."""

    def __init__(self, entries: np.ndarray, groups: list[list[np.ndarray]] | None = None, drift: np.ndarray | None = None):
        self.entries = entries
        self.groups = groups or [grouped(part) for part in entries]
        self.drift = np.zeros((len(entries), GROUPS), np.int64) if drift is None else drift

    def moved(self, entries: np.ndarray) -> Codebooks:
        drift = np.zeros((len(entries), GROUPS), object)
        for p, groups in enumerate(self.groups):
            for g, own in enumerate(groups):
                drift[p, g] = max((root_up(sum(int(d) ** 2 for d in entries[p, e] - self.entries[p, e])) for e in own), default=0)
        return Codebooks(entries, self.groups, np.minimum(drift, BOUND_MAX).astype(np.int64))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def root_up(n: int) -> int:
    r = math.isqrt(n)
    return r + (r * r < n)


def grouped(entries: np.ndarray) -> list[np.ndarray]:
    """Entries of one codebook in at most GROUPS groups, by a few rounds of Lloyd's from seeds far apart."""
    if not len(entries):
        return [np.zeros(0, np.int64)] * GROUPS
    most = max(abs(int(v)) for v in entries.ravel())
    x = (entries >> max(0, most.bit_length() - 400)).astype(np.float64)  # squares stay in range
    seeds = [0]
    for _ in range(min(GROUPS, len(x)) - 1):
        apart = np.min([((x - x[s]) ** 2).sum(axis=1) for s in seeds], axis=0)
        seeds.append(int(apart.argmax()))
    centers = x[seeds]
    for _ in range(5):
        of = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([x[of == g].mean(axis=0) if (of == g).any() else c for g, c in enumerate(centers)])
    return [np.flatnonzero(of == g) for g in range(GROUPS)]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    apart = x[:, None] - entries
    return (apart * apart).sum(axis=2)


def floors(squared: np.ndarray) -> np.ndarray:
    """Bounds of 16 bits at most the square roots; larger ones are cut, which only makes them fail sooner."""
    r = np.floor(np.sqrt(np.minimum(squared, BOUND_MAX**2).astype(np.float64))).astype(np.int64)
    return np.where(r * r > np.minimum(squared, BOUND_MAX**2), r - 1, r).astype(np.uint16)


def assigned(x: np.ndarray, books: Codebooks, at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of every part of the rows x, its squared distance, the new bounds, and how many distances were taken.

    at: entries so far by part (NONE: none yet). low: bounds by part and group, as of the last round.
    """
    n, width = len(x), x.shape[1] // PARTS
    wide = x.dtype == object or books.entries.dtype == object
    entries = books.entries.astype(object) if wide else books.entries
    best, error, bounds, taken = at.copy(), np.zeros((n, PARTS), object if wide else np.int64), low.copy(), 0
    for p in range(PARTS):
        own = x[:, p * width : (p + 1) * width]
        known = at[:, p] != NONE
        bound = np.maximum(low[:, p].astype(np.int64) - books.drift[p], 0)
        now = np.full(n, -1, error.dtype)  # the squared distance to the present entry
        if known.any():
            apart = own[known] - entries[p][at[known, p]]
            now[known] = (apart * apart).sum(axis=1)
            taken += int(known.sum())
        found, found_at = now.copy(), at[:, p].astype(np.int64)
        least, second = {}, {}
        for g, members in enumerate(books.groups[p]):
            if not len(members):
                bound[:, g] = BOUND_MAX
                continue
            scan = np.flatnonzero(~known | (bound[:, g] * bound[:, g] <= now))
            if not len(scan):
                continue
            d = squares(own[scan], entries[p][members])
            taken += d.size
            k = d.argmin(axis=1)  # the first of equals, and members ascend
            near = d[np.arange(len(scan)), k]
            rest = d.copy()
            rest[np.arange(len(scan)), k] = BOUND_MAX**2 if d.shape[1] == 1 else d.max()
            least[g], second[g] = (scan, near), (scan, rest.min(axis=1))
            better = (found[scan] < 0) | (near < found[scan]) | ((near == found[scan]) & (members[k] < found_at[scan]))
            found[scan] = np.where(better, near, found[scan])
            found_at[scan] = np.where(better, members[k], found_at[scan])
        group_of = np.empty(entries.shape[1], np.int64)
        for g, members in enumerate(books.groups[p]):
            group_of[members] = g
        chosen = group_of[found_at] if n else np.zeros(0, np.int64)
        left = known & (found_at != at[:, p])  # the entry left behind counts for its group's bound
        for g in range(GROUPS):
            own_left = np.flatnonzero(left & (group_of[np.where(known, at[:, p], 0)] == g))
            bound[own_left, g] = np.minimum(bound[own_left, g], floors(now[own_left]))
            if g in least:
                scan, near = least[g]
                bound[scan, g] = np.where(chosen[scan] == g, floors(second[g][1]), floors(near))
        best[:, p], error[:, p], bounds[:, p] = found_at, found, bound
    return best, error, bounds, taken


STATE = "vec_id {}, label {}, x binary, at binary, low binary, error long, code string, sums array<long>"


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as the narrowest integers that hold them, or as text where 64 bits do not; their first byte says which."""
    if x.dtype == object:
        return [b"t" + ",".join(map(str, row)).encode() for row in x.tolist()]
    kind = next(k for k in "hiq" if not x.size or -np.iinfo(k).max <= x.min() and x.max() <= np.iinfo(k).max)
    return [kind.encode() + row.tobytes() for row in np.ascontiguousarray(x, kind)]


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    kinds = {r[:1] for r in rows}
    if kinds == {b"h"} and rows:
        return np.frombuffer(b"".join(r[1:] for r in rows), np.int16).reshape(len(rows), width).astype(np.int64)
    one = [[int(v) for v in r[1:].split(b",")] if r[:1] == b"t" else np.frombuffer(r[1:], r[:1].decode()).tolist() for r in rows]
    return np.array(one, object if b"t" in kinds else np.int64).reshape(len(rows), width)


class Sums:
    """Counts and sums of parts by entry, as limbs: rows of sums are PARTS x ENTRIES x (1 + width of a part x limbs) longs."""

    def __init__(self, width: int, limbs: int):
        self.width, self.limbs = width, limbs
        self.count = np.zeros((PARTS, ENTRIES), np.int64)
        self.total = np.zeros((PARTS, ENTRIES, width // PARTS), object)

    def add(self, x: np.ndarray, at: np.ndarray) -> None:
        for p in range(PARTS):
            own = x[:, p * self.width // PARTS : (p + 1) * self.width // PARTS]
            for e in np.unique(at[:, p]):
                mine = at[:, p] == e
                self.count[p, e] += int(mine.sum())
                self.total[p, e] += own[mine].sum(axis=0).astype(object)

    def row(self) -> list[int]:
        low = (1 << LIMB) - 1
        parts = [[v >> LIMB * k & low if k < self.limbs - 1 else v >> LIMB * k for k in range(self.limbs)] for v in self.total.ravel().tolist()]
        return [*self.count.ravel().tolist(), *(limb for p in parts for limb in p)]

    @staticmethod
    def means(sums: dict[int, int], entries: np.ndarray, limbs: int) -> np.ndarray:
        """Means rounded down, from the added rows by place; entries without parts stay."""
        out = entries.astype(object)
        width = entries.shape[2]
        for p in range(PARTS):
            for e in range(entries.shape[1]):
                n = sums.get(p * ENTRIES + e, 0)
                for k in range(width if n else 0):
                    at = PARTS * ENTRIES + ((p * ENTRIES + e) * width + k) * limbs
                    out[p, e, k] = sum(sums.get(at + j, 0) << LIMB * j for j in range(limbs)) // n
        return narrow(out)


def narrow(entries: np.ndarray) -> np.ndarray:
    return entries.astype(np.int64) if all(abs(v) < NARROW for v in entries.ravel().tolist()) else entries


def one_round(rows: DataFrame, books: Codebooks, width: int, limbs: int, first: bool, last: bool) -> DataFrame:
    """A pass over all vectors: (vec_id, label, vector) if first, else the last pass's table."""
    kinds = dict(rows.dtypes)
    ddl = STATE.format(kinds["vec_id"], kinds["label"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        sums = Sums(width, limbs)
        for whole_batch in batches:
            for k in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(k, ROWS)
                n = b.num_rows
                if first:
                    x, at, low = integers(b.column(2), width), np.full((n, PARTS), NONE, np.uint8), np.zeros((n, PARTS, GROUPS), np.uint16)
                else:
                    x = unpacked(b.column(2).to_pylist(), width)
                    at = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(n, PARTS)
                    low = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint16).reshape(n, PARTS, GROUPS)
                at, error, low, _ = assigned(x, books, at, low)
                none = pa.nulls(n, pa.binary())
                if last:
                    most = np.iinfo(np.int64).max
                    errors = [min(int(e), most) for e in error.astype(object).sum(axis=1)]
                    columns = [none, none, none, pa.array(errors, pa.int64()), pa.array([r.tobytes().hex() for r in at], pa.string())]
                else:
                    sums.add(x, at)
                    columns = [pa.array(packed(x), pa.binary()), pa.array([r.tobytes() for r in at], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())]
                keys = [b.column(j).cast(schema.field(j).type) for j in range(2)]
                yield pa.RecordBatch.from_arrays([*keys, *columns, pa.nulls(n, schema.field(7).type)], schema=schema)
        if not last:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:7]), pa.array([sums.row()], schema.field(7).type)], schema=schema)

    return rows.mapInArrow(run, ddl)


def vector_codes(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    small_batches(vectors)
    kept = vectors.where(finite(vector)).select("vec_id", "label", F.col(vector).alias("vector"))
    size = kept.agg(F.max(F.size("vector")).alias("n"), F.max(F.array_max(F.transform("vector", lambda v: F.abs(v.cast("double"))))).alias("most")).first()
    width = max(PARTS, -(-(size.n or 0) // PARTS) * PARTS)
    most = whole(max(1.0, size.most or 0.0)) + 1
    limbs = -(-(most.bit_length() + 64) // LIMB)  # of sums of up to 2^63 vectors
    firsts = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").toArrow().column(0).combine_chunks()
    start = integers(firsts, width) if len(firsts) else np.zeros((0, width), np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(firsts), PARTS, width // PARTS).swapaxes(0, 1)))
    now = kept
    for k in range(rounds if len(firsts) else 0):
        after = written(one_round(now if k == 0 else now.where("sums IS NULL").select("vec_id", "label", "x", "at", "low"), books, width, limbs, k == 0, False), "codes")
        if k:
            dropped(now)
        now = after
        added = now.where("sums IS NOT NULL").select(F.posexplode("sums").alias("place", "v")).groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        books = books.moved(Sums.means({r.place: int(r.v) for r in added.collect()}, books.entries, limbs))
    rows = now if now is kept else now.where("sums IS NULL").select("vec_id", "label", "x", "at", "low")
    coded = written(one_round(rows, books, width, limbs, now is kept, True).select("vec_id", "label", "error", "code"), "codes")
    if now is not kept:
        dropped(now)
    errors = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    errors = broadcast_if_small(written(errors, "errors"), F.lit(40) + F.coalesce(F.octet_length(F.col("label").cast("string")), F.lit(0)))
    joined = coded.join(errors.withColumnRenamed("label", "of_label"), F.col("label").eqNullSafe(F.col("of_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
