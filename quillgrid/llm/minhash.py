"""Near-duplicates by one-permutation MinHash with optimal densification.

One pass over the texts gives each document's number of shingles, a digest of its shingle set, band keys and a sketch.
Documents with equal sets are one class from there on. Within a band's bucket the class that shares most buckets is the
centre of a star of candidate pairs, so a bucket of m classes gives m - 1 pairs. Pairs are confirmed on full shingle
sets, and the links' components are found.

A star alone can miss a link between two of its leaves. So the classes of a bucket that components still keep apart
are compared again: all of them where the bucket has at most ``SMALL`` classes, else with ``CENTRES`` further centres. The
classes of large buckets that are apart even then are compared by an exact prefix filter on their full sets. A pair at the
threshold shares no bucket with a chance below 1e-5.

Words end at ASCII white space, A-Z in lower case; a set holds 64-bit hashes of the shingles.

Defined cases: a text without words (null, empty, white space) has an empty set and is linked with nothing; one with
fewer words than a shingle has one shingle, the whole; repeated rows are one document; of rows with one id and several
texts the one with most shingles (then with the largest digest) stands for all; a null id is linked with nothing and its
component is null; equal sets are linked and the smallest id is kept; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import Scratch, connected_components, only_ids, small_batches, table

BINS, ROWS = 252, 6  # 42 bands
SKETCH = 128  # bytes, one a bin
SMALL = 24
CENTRES = 4
CHUNK = 1_000_000  # bytes of text hashed at once

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift twice."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of each word. data: bytes of the texts end to end, bounds: where they start, and the end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[data]
    blank = _BLANK[data]
    first = np.zeros(n + 1, bool)  # a text starts here
    first[bounds] = True
    starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | first[:n]))
    ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | first[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("base", _BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("inverse", _INVERSE, n)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(bounds, starts, "right") - 1


def shingles(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their document numbers, sorted by document."""
    count = len(words) - k + 1
    held, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if count > 0:
        held = np.full(count, np.uint64(k))
        for j in range(k):
            held = mix(held * np.uint64(31) + words[j : j + count], j + 1)
        whole = doc[:count] == doc[k - 1 :]
        held, owner = held[whole], doc[:count][whole]
    numbers, at, sizes = np.unique(doc, return_index=True, return_counts=True)
    for d, i, n in zip(numbers[sizes < k], at[sizes < k], sizes[sizes < k], strict=True):
        h = np.full(1, np.uint64(n))
        for w in words[i : i + n]:
            h = mix(h * np.uint64(31) + w, 99)
        held, owner = np.append(held, h), np.append(owner, d)
    order = np.lexsort((held, owner))
    held, owner = held[order], owner[order]
    new = np.ones(len(held), bool)
    new[1:] = (held[1:] != held[:-1]) | (owner[1:] != owner[:-1])
    return held[new], owner[new]


_FREE = np.uint64(2**64 - 1)


def signatures(held: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """docs x BINS: the least hash of each bin; an empty bin borrows from the first full one of its own fixed sequence."""
    h = mix(held, 1000)
    out = np.full(docs * BINS, _FREE)
    at = owner * BINS + (h % np.uint64(BINS)).astype(np.int64)
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    out[at[first]] = h[first]
    out = out.reshape(docs, BINS)
    full = out != _FREE
    d, b = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(d):
        attempt += 1
        source = (mix(b.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt), 7) % np.uint64(BINS)).astype(np.int64)
        good = full[d, source]
        out[d[good], b[good]] = out[d[good], source[good]]
        d, b = d[~good], b[~good]
    return out


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK bytes: first row, end row, bytes, bounds."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def _signature_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in _chunks(batch.column("text")):
                n = end - row
                held, owner = shingles(*word_hashes(data, bounds), k)
                sizes = np.bincount(owner, minlength=n)
                lo, hi = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(lo, owner, mix(held, 2000))
                np.add.at(hi, owner, mix(held, 3000))
                sig = signatures(held, owner, n)
                bands = np.zeros((n, BINS // ROWS), np.uint64)
                for j in range(ROWS):
                    bands = mix(bands * np.uint64(31) + sig[:, j::ROWS], j)
                bands = mix(bands + np.arange(bands.shape[1], dtype=np.uint64), 5).view(np.int64)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), bands.shape[1]).cast(pa.list_(pa.int64()))
                sketch = (mix(sig[:, :SKETCH], 9) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, n).cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), flat, pa.array([s.tobytes() for s in sketch], pa.binary())],
                    ["doc_id", "n_shingles", "lo", "hi", "bands", "sketch"],
                )

    return run


def _set_batches(k: int):
    """Shingle sets, with the digest that _signature_batches gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in _chunks(batch.column("text")):
                held, owner = shingles(*word_hashes(data, bounds), k)
                at = np.searchsorted(owner, np.arange(end - row + 1))
                lo = np.zeros(end - row, np.uint64)
                np.add.at(lo, owner, mix(held, 2000))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row).cast(pa.int64()), pa.array(lo.view(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(held.view(np.int64)))],
                    ["doc", "lo", "held"],
                )

    return run


def _matches(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equal bytes of two columns of sketches."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), SKETCH) for c in (a, b))
    return (x == y).sum(axis=1)


def _near(least: int):
    """Pairs whose sketches agree in enough bytes: five standard deviations below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _matches(batch.column("sketch_a"), batch.column("sketch_b")) >= least if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Linked: 100 * shared shingles >= percent * shingles of either.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.keep(docs.mapInArrow(_signature_batches(k), "doc_id long, n_shingles long, lo long, hi long, bands array<long>, sketch binary"))
    same = ["lo", "hi", "n_shingles"]
    digest = F.struct("n_shingles", "lo", "hi")
    several = sig.groupBy("doc_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most and doc_id is not null")
    several = scratch.keep(several.select("doc_id", "most.*"))
    full = sig
    if not several.isEmpty():  # ids with several texts
        sig = sig.join(several.select("doc_id"), "doc_id", "left_anti").unionByName(sig.join(several, ["doc_id", *same], "left_semi"))
    # written, so that the join on a class with very many copies is a skewed join that Spark splits
    classes = scratch.keep(sig.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("doc")).where("doc is not null"))
    reps = sig.join(classes.select(F.col("doc").alias("doc_id"), *same), ["doc_id", *same], "left_semi")
    reps = reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "lo", "bands", "sketch").dropDuplicates(["doc"])
    reps = scratch.keep(reps)
    keyed = reps.select("doc", F.explode("bands").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    active = scratch.keep(keyed.join(sizes, "bucket"))
    ids = active.groupBy("doc").agg(F.sum(F.log2("size")).alias("shared"))
    ids = scratch.keep(ids)
    sketches = reps.select("doc", "n", "sketch").join(ids, "doc", "left_semi")
    texts = only_ids(docs, ids.select(F.col("doc").alias("doc_id")))
    sets = texts.mapInArrow(_set_batches(k), "doc long, lo long, held array<long>")
    sets = sets.join(reps.select("doc", "lo").join(ids, "doc", "left_semi"), ["doc", "lo"], "left_semi").drop("lo")
    sets = scratch.keep(sets.dropDuplicates(["doc"]))

    share = percent / 100
    least = int(SKETCH * max(0.0, share - 5 * (share * (1 - share) / SKETCH) ** 0.5))

    def confirm(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        b = sketches.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        near = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        near = near.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_near(least), "a long, b long")
        both = near.join(sets.withColumnsRenamed({"doc": "a", "held": "held_a"}), "a").join(sets.withColumnsRenamed({"doc": "b", "held": "held_b"}), "b")
        shared, total = F.size(F.array_intersect("held_a", "held_b")), F.size("held_a") + F.size("held_b")
        return both.where(100 * shared >= percent * (total - shared)).select("a", "b")

    def merge(component: DataFrame, links: DataFrame) -> DataFrame:
        edges = links.join(component.withColumnsRenamed({"doc": "a", "component": "x"}), "a").join(component.withColumnsRenamed({"doc": "b", "component": "y"}), "b")
        merged = connected_components(scratch, edges.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        merged = merged.select(F.col("id").alias("component"), F.col("component").alias("least"))
        return scratch.keep(component.join(merged, "component", "left").select("doc", F.coalesce("least", "component").alias("component")))

    component = ids.select("doc", F.col("doc").alias("component"))
    tested = None
    for turn in range(2):
        here = active.join(component, "doc")
        member = F.struct(F.col("doc").alias("centre"), F.col("component").alias("centre_component"))
        if turn == 0:
            centres = here.join(ids, "doc").groupBy("bucket").agg(F.max_by(member, F.struct("shared", -F.col("doc"))).alias("c"))
            pairs = _pairs(here, centres.select("bucket", "c.*"))
        else:
            # one ranking for all buckets: those that hold much the same classes take the same centres
            picked = F.array(*(F.max_by(member, F.xxhash64("doc", F.lit(i))) for i in range(CENTRES)))
            apart = here.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), picked.alias("c")).where("least <> most")
            apart = scratch.keep(apart)
            pairs = _pairs(here.where(F.col("size") > SMALL), apart.select("bucket", F.explode(F.array_distinct("c")).alias("c")).select("bucket", "c.*"))
            few = here.where(F.col("size") <= SMALL).join(apart.select("bucket"), "bucket", "left_semi")
            pairs = pairs.unionByName(_pairs(few, few.select("bucket", F.col("doc").alias("centre"), F.col("component").alias("centre_component"))))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        if pairs.isEmpty():
            continue
        links = scratch.keep(confirm(pairs))
        tested = pairs if tested is None else tested.unionByName(pairs)
        if links.isEmpty():
            continue
        component = merge(component, links)
    # the large buckets that are still apart: every pair of their classes that could be a link
    here = active.where(F.col("size") > SMALL).join(component, "doc")
    apart = here.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    rest = scratch.keep(here.join(apart.select("bucket"), "bucket", "left_semi").select("doc", "component").distinct())
    if not rest.isEmpty():
        pairs = _prefix_pairs(scratch, sets, rest, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        links = scratch.keep(confirm(scratch.keep(pairs)))
        if not links.isEmpty():
            component = merge(component, links)
    rows = full.select("doc_id", *same)
    if sig is not full:
        whole = several.select("doc_id", *(F.col(c).alias(f"_{c}") for c in same))
        rows = rows.join(whole, "doc_id", "left").select("doc_id", *(F.coalesce(f"_{c}", c).alias(c) for c in same))
    rows = rows.join(classes, same, "left").withColumn("doc", F.when(F.col("doc_id").isNotNull(), F.col("doc"))).join(component, "doc", "left")
    found = F.coalesce("component", "doc", "doc_id")
    return rows.select("doc_id", "n_shingles", found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def _pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    """(a, b), a < b: each member with the centres of its bucket that lie in another component."""
    m, c = members.select("bucket", "doc", "component").alias("m"), centres.alias("c")
    star = m.join(c, (F.col("m.bucket") == F.col("c.bucket")) & (F.col("m.component") != F.col("c.centre_component")))
    return star.select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b"))


def _prefix_pairs(scratch: Scratch, sets: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: every pair of different components that can reach percent, by exact prefix filtering of the full sets.

    Shingles are ordered by how many sets of the rest hold them. Two sets that are similar enough share one of their first
    n - least + 1, least being what the pair must share: for the smaller set at least 2p / (1 + p) of its own shingles, for
    the larger one p of its own. After the first shared one there must be room for the others. sets: doc, held.
    """
    each = sets.join(rest, "doc")
    often = each.select("component", F.explode("held").alias("shingle")).groupBy("shingle")
    often = scratch.keep(often.agg(F.count("*").alias("often")).where("often > 1"))
    # a shingle of a single set comes first and meets no other, so that it only counts
    each = each.select("doc", "component", F.size("held").alias("n"), F.explode("held").alias("shingle")).join(often, "shingle")
    lists = each.groupBy("doc", "component", "n").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("common"))
    reach = F.expr(f"n - (({percent} * n + 99) div 100) + 1 - (n - size(common))")
    heads = lists.where(reach > 0).select("doc", "component", "n", (F.col("n") - F.size("common")).alias("alone"), F.posexplode(F.slice("common", F.lit(1), reach.cast("int"))).alias("i", "s"))
    heads = heads.select("doc", "component", "n", (F.col("alone") + F.col("i")).alias("at"), F.col("s.shingle").alias("shingle"))
    heads = scratch.keep(heads)
    # where all belong to one component there is nothing to find
    mixed = heads.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle")
    heads = scratch.keep(heads.join(mixed, "shingle", "left_semi"))
    small = heads.where(F.expr(f"at <= n - ((2 * {percent} * n + {99 + percent}) div {100 + percent})")).alias("s")
    room = F.least(F.col("s.n") - F.col("s.at"), F.col("l.n") - F.col("l.at"))
    pairs = small.join(
        heads.alias("l"),
        (F.col("s.shingle") == F.col("l.shingle"))
        & (F.struct("s.n", "s.doc") < F.struct("l.n", "l.doc"))
        & (F.col("s.component") != F.col("l.component"))
        & (100 * F.col("s.n") >= percent * F.col("l.n"))
        & ((100 + percent) * room >= percent * (F.col("s.n") + F.col("l.n"))),
    )
    return pairs.select(F.least("s.doc", "l.doc").alias("a"), F.greatest("s.doc", "l.doc").alias("b")).distinct()


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
ORACLE_SQL: dict[str, str] = {}
