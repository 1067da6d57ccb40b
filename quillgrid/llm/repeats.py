"""Repeated passages: every byte that lies in a string of ``length`` bytes that also starts somewhere else is removed.

Method: column-wise construction over many documents at once. Each round inserts one more symbol of every document, from the
last column to the first; the order of all suffixes (whose symbols are that column of the collection's Burrows-Wheeler
transform) follows from the previous round's order by a stable split on the new symbol, and the common prefixes of neighbours
from the smallest one between them in the previous order, plus one. Neighbours with a common prefix of ``length`` are repeats.

What goes in: of each window of ``length`` bytes the leftmost least 32-byte gram (by hash) is its anchor. Equal windows have
equal anchors at equal places, so only anchors that occur twice matter; the bytes around each are one *segment*, equal ones are
counted as one, and segments are aligned at their anchors. So equal windows stand in one column, and a round needs the order
of the previous one only: it reads one column and writes one, in sequence, whatever the number of rounds (this is the aligned,
positional form of the method; ranks over the columns of all earlier rounds aren't needed).

Groups of segments with one anchor are packed into tasks; one with more than ``GROUP`` segments is cut: first into classes of 13
places of the anchor in the window (all windows of a class share 188 bytes, which are the new key), then into single places,
where a group is one window. So no group grows with the data. Texts are written once as a table bucketed by their key and never
shuffled again; a key with more than 1/``HOT`` of all rows is joined by broadcast (there can be no more than ``HOT`` of them).

Defined cases: null text is an empty text; texts shorter than ``length`` bytes have nothing to remove; of equal texts of at
least that length nothing is left; rows with one doc_id are documents of their own; an empty table gives an empty result; other
columns are ignored. Matches never cross documents. Texts are read whole, long ones in chunks that overlap.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import Scratch, small_batches, table

LENGTH = 200
GRAM = 32
GROUP = 4096  # segments of one key that are put together
PACK = 16384  # segments of one construction, about
HOT = 2000
CHUNK = 1 << 20  # bytes looked at together
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
ABSENT = 0xFF  # no byte of UTF-8
KEY = ["k1", "k2"]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each place on."""
    h = b.astype(np.uint64) + np.uint64(1)
    step = 1
    for m in MULTIPLIERS:
        h = h[:-step] * np.uint64(m) + h[step:]
        step *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(b: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(range, place, hash, low, high) of the anchors of windows whose starts lie in ranges first..last of b.

    low..high: the starts of the windows with this anchor. The anchor of a window is its leftmost least gram.
    """
    h = gram_hashes(b)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, step = length - GRAM + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    of = np.full(len(place), -1, np.int64)
    for i, (x, y) in enumerate(zip(first, last, strict=True)):
        of[x : y + 1] = i
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (of[1:] != of[:-1])])
    end = np.r_[new[1:], len(place)] - 1
    some = of[new] >= 0
    new, end = new[some], end[some]
    return of[new], place[new], h[place[new]].view(np.int64), new, end


def batch_anchors(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, place, hash, low, high) of a batch's texts, places counted in the text, some texts or a part of one at a time."""
    part: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush():
        bytes_ = np.concatenate([b for _, _, b in part])
        base = np.concatenate([[0], np.cumsum([len(b) for _, _, b in part])[:-1]]).astype(np.int64)
        sizes = np.array([len(b) for _, _, b in part])
        of, place, h, low, high = anchors(bytes_, base, base + sizes - length, length)
        move = np.array([at for _, at, _ in part])[of] - base[of]
        return np.array([i for i, _, _ in part])[of], place + move, h, low + move, high + move

    for i in range(len(texts)):
        whole = np.frombuffer(texts[i].as_buffer(), np.uint8)
        for at in range(0, len(whole) - length + 1, CHUNK):
            part.append((i, at, whole[at : at + CHUNK + length - 1]))
            held += len(part[-1][2])
            if held >= CHUNK:
                yield flush()
                part, held = [], 0
    if part:
        yield flush()


def _counted(length: int):
    """(k1, k2, gram, c): how often each anchor stands in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.array(batch.column(k)) for k in KEY]
            for of, place, h, _, _ in batch_anchors(batch.column("text"), length):
                # a place whose windows are cut by a chunk's end counts once
                rows = np.unique(np.column_stack([of, place, h]), axis=0)[:, [0, 2]]
                rows, c = np.unique(rows, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][rows[:, 0]]), pa.array(keys[1][rows[:, 0]]), pa.array(rows[:, 1]), pa.array(c, pa.int64())], [*KEY, "gram", "c"])

    return run


SEGMENT = "k1 long, k2 long, gram long, seat int, bytes binary, places array<long>"


def _segments(length: int):
    """The bytes around each anchor that occurs again: seat is the anchor's place in them, places those of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            texts, k1, k2 = batch.column("text"), batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            wanted = [np.array(g.values) for g in batch.column("grams")]
            for part in batch_anchors(texts, length):
                of, place, h, low, high = part
                found: dict[tuple, list[int]] = {}
                for i in np.unique(of).tolist():
                    raw = texts[i].as_buffer()
                    own = slice(*np.searchsorted(of, [i, i + 1]))
                    mine = own.start + np.flatnonzero(np.isin(h[own], wanted[i]))
                    for q, g, x, y in zip(place[mine].tolist(), h[mine].tolist(), low[mine].tolist(), high[mine].tolist(), strict=True):
                        found.setdefault((i, g, q - x, raw[x : y + length].to_pybytes()), []).append(q)
                if found:
                    cols = list(zip(*((k1[i], k2[i], g, seat, b, qs) for (i, g, seat, b), qs in found.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*KEY, "gram", "seat", "bytes", "places"])

    return run


def repeated(seat: np.ndarray, segments: list[bytes], length: int) -> np.ndarray:
    """For each segment and each place 0..width of the anchor in a window, whether that window stands in another segment too.

    Rounds go from the last column to the first; ``order`` and ``common`` are the only state.
    """
    n, width = len(segments), length - GRAM
    sizes = np.array([len(s) for s in segments])
    start = width - seat
    columns = np.full((width + length, n), ABSENT, np.uint8)
    row = np.repeat(np.arange(n), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns[start[row] + inside, row] = np.frombuffer(b"".join(segments), np.uint8)
    out = np.zeros((n, width + 1), bool)
    order, common = np.arange(n), np.zeros(n, np.uint16)
    levels = max(1, int(n).bit_length())
    least = np.zeros((levels, n), np.uint16)  # least[j, i]: of common[i : i + 2^j]
    log = np.zeros(n + 1, np.int64)
    for j in range(1, levels + 1):
        log[1 << j :] = j
    for c in range(width + length - 1, -1, -1):
        symbol = columns[c][order]
        split = np.argsort(symbol, kind="stable")
        symbol = symbol[split]
        least[0] = common
        for j in range(1, levels):
            half = 1 << (j - 1)
            least[j, : n - half] = np.minimum(least[j - 1, : n - half], least[j - 1, half:])
        after = np.zeros(n, np.uint16)
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != ABSENT)) + 1
        a, b = split[same - 1] + 1, split[same] + 1  # common prefixes a..b-1 of the old order lie between the two
        j = log[b - a]
        after[same] = 1 + np.minimum(least[j, a], least[j, b - (1 << j)])
        order, common = order[split], after
        if c <= width:
            met = np.flatnonzero(common >= length)
            out[order[met], width - c] = True
            out[order[met - 1], width - c] = True
    return out


PIECE = "r1 long, r2 long, low int, high int"


def _construct(length: int):
    """Sorted pieces to the runs of anchor places (low..high) whose windows are repeated."""

    def emit(r1, r2, seat, segments, n):
        seat = np.array(seat)
        flags = repeated(seat, segments, length)
        last = seat - (np.array([len(s) for s in segments]) - length)  # places of the anchor run from last to seat
        place = np.arange(flags.shape[1])
        flags |= (np.array(n) > 1)[:, None] & (place >= last[:, None]) & (place <= seat[:, None])
        edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        cols = [pa.array(np.array(r1)[i], pa.int64()), pa.array(np.array(r2)[i], pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["r1", "r2", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = ["r1", "r2", "seat", "bytes", "n"], None
        held: list[list] = [[] for _ in names]
        for batch in batches:
            for key, *piece in zip(*(batch.column(c).to_pylist() for c in ("key", *names)), strict=True):
                if key != last and len(held[0]) >= PACK:
                    yield emit(*held)
                    held = [[] for _ in names]
                last = key
                for c, v in zip(held, piece, strict=True):
                    c.append(v)
        if held[0]:
            yield emit(*held)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, n, n_removed, n_spans, kept_sha256) of each text; spans may overlap."""
    for batch in batches:
        removed, runs, digests = [], [], []
        for text, n, spans in zip(batch.column("text"), batch.column("n").to_pylist(), batch.column("spans"), strict=True):
            raw = text.as_buffer().to_pybytes()
            if n > 1:
                low, high = np.array([0]), np.array([len(raw)])
            elif spans.values is None or not len(spans.values):
                low = high = np.zeros(0, np.int64)
            else:
                flat = spans.values
                low, high = np.array(flat.field("low")), np.array(flat.field("high"))
                by = np.argsort(low, kind="stable")
                low, high = low[by], np.maximum.accumulate(high[by])
                new = np.r_[True, low[1:] > high[:-1]]  # runs that touch are one
                low, high = low[new], high[np.r_[np.flatnonzero(new)[1:] - 1, len(low) - 1]]
            kept = hashlib.sha256()
            at = 0
            for x, y in zip(low.tolist(), high.tolist(), strict=True):
                kept.update(raw[at:x])
                at = y
            kept.update(raw[at:])
            removed.append(int((high - low).sum()))
            runs.append(len(low))
            digests.append(kept.hexdigest())
        cols = [*(batch.column(c) for c in (*KEY, "n")), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, [*KEY, "n", "n_removed", "n_spans", "kept_sha256"])


def join_by_weight(left: DataFrame, right: DataFrame, on: list[str], weight: str = "n") -> DataFrame:
    """left inner join right; weight: how many rows of left a row's key of right has.

    Keys with more than 1/HOT of the weight (fewer than HOT keys) are broadcast, so that no task gets a large share.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) > total / HOT
    hot = F.broadcast(right.where(heavy))
    cold = left.join(F.broadcast(right.where(heavy).select(*on).distinct()), on, "left_anti")
    return left.join(hot, on).unionByName(cold.join(right.where(~heavy), on))


def _texts(scratch: Scratch, docs: DataFrame, length: int) -> DataFrame:
    """(k1, k2, n, text): distinct texts of at least that many bytes, as a table bucketed by key."""
    spark = docs.sparkSession
    some = docs.where(F.octet_length("text") >= length).groupBy(*KEY).agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
    name, buckets = f"quillgrid_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    some.write.format("parquet").option("path", f"{scratch.root}/{name}").bucketBy(buckets, *KEY).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before its name goes; the files stay in the shared folder
    spark.sql(f"drop table {name}")
    return out


def _pieces(rows: DataFrame) -> DataFrame:
    """Distinct pieces with their number of places, and two hashes that stand for them."""
    some = rows.groupBy("key", "seat", "bytes").agg(F.sum("n").cast("long").alias("n"))
    return some.withColumns({"r1": F.xxhash64("seat", "bytes"), "r2": F.xxhash64(F.lit(1), "seat", "bytes")})


def _narrowed(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """The part of each piece for each class of ``width`` places of the anchor, keyed by the bytes that all its windows share."""
    low, high = F.col("seat") - (F.length("bytes") - length), F.col("seat")
    each = pieces.withColumn("class", F.explode(F.sequence(F.floor(low / width).cast("int"), F.floor(high / width).cast("int"))))
    first, last = F.greatest(low, F.col("class") * width), F.least(high, F.col("class") * width + width - 1)
    each = each.select("r1", "r2", "n", "class", "bytes", F.col("seat").alias("was"), first.alias("first"), last.alias("last"))
    each = each.withColumn("bytes", F.expr(f"substring(bytes, was - last + 1, last - first + {length})"))
    shared = F.expr(f"substring(bytes, last - class * {width} + 1, {length - width + 1})")
    return each.select(F.col("r1").alias("o1"), F.col("r2").alias("o2"), "n", F.xxhash64(F.lit(width), "class", shared).alias("key"), F.col("last").cast("int").alias("seat"), "bytes")


def repeated_runs(scratch: Scratch, segments: DataFrame, length: int, group: int = GROUP) -> DataFrame:
    """(r1, r2, n, low, high): for each distinct segment the runs of anchor places whose windows stand elsewhere too."""
    pieces = scratch.keep(_pieces(segments.select(F.col("gram").alias("key"), "seat", "bytes", F.size("places").cast("long").alias("n"))))
    names = scratch.keep(pieces.select("r1", "r2", "n"))
    links, runs = None, None  # links: from a piece to the segments that it is cut from
    for width in (13, 1, 0):
        salt = F.pmod(F.col("r1"), F.lit(64)).cast("int")
        large = pieces.groupBy("key").count().where(F.col("count") > group).select("key")
        large = scratch.keep(large) if width else None  # pieces of one place and one key are equal, so they are one
        cut = width > 0 and not large.isEmpty()
        if cut:
            large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63)))).withColumn("large", F.lit(True))
            both = scratch.keep(pieces.withColumn("salt", salt).join(large, ["key", "salt"], "left"))
            ready, rest = both.where("large is null"), both.where("large")
        else:
            ready, rest = pieces, None
        found = ready.select("key", "r1", "r2", "seat", "bytes", "n").repartition("key").sortWithinPartitions("key").mapInArrow(_construct(length), PIECE)
        if links is not None:
            found = found.withColumnsRenamed({"r1": "p1", "r2": "p2"}).join(links, ["p1", "p2"]).select("r1", "r2", "low", "high")
        runs = found if runs is None else runs.unionByName(found)
        if not cut:
            break
        parts = scratch.keep(_narrowed(rest, width, length))
        pieces = scratch.keep(_pieces(parts.select("key", "seat", "bytes", "n")))
        step = parts.select("o1", "o2", F.xxhash64("seat", "bytes").alias("p1"), F.xxhash64(F.lit(1), "seat", "bytes").alias("p2"))
        if links is None:
            links = step.withColumnsRenamed({"o1": "r1", "o2": "r2"})
        else:
            links = step.join(links.withColumnsRenamed({"p1": "o1", "p2": "o2"}), ["o1", "o2"]).select("r1", "r2", "p1", "p2")
        links = scratch.keep(links)
    return scratch.keep(runs.join(names, ["r1", "r2"]))


def spans_of(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (k1, k2, n, text), and (k1, k2, spans): the byte ranges low..high of repeated strings in them.

    docs: k1, k2 (which stand for the text), text.
    """
    scratch = Scratch(docs.sparkSession)
    texts = _texts(scratch, docs, length)
    counts = scratch.keep(texts.select(*KEY, "text").mapInArrow(_counted(length), "k1 long, k2 long, gram long, c long"))
    again = scratch.keep(counts.groupBy("gram").agg(F.sum("c").alias("c"), F.count("*").alias("n")).where("c > 1").select("gram", "n"))
    wanted = join_by_weight(counts.select(*KEY, "gram"), again, ["gram"]).groupBy(*KEY).agg(F.collect_list("gram").alias("grams"))
    segments = scratch.keep(texts.select(*KEY, "text").join(wanted, KEY).mapInArrow(_segments(length), SEGMENT))
    runs = repeated_runs(scratch, segments, length, group)
    runs = scratch.keep(runs.groupBy("r1", "r2", "n").agg(F.collect_list(F.struct("low", "high")).alias("runs")))
    where = segments.select(*KEY, F.xxhash64("seat", "bytes").alias("r1"), F.xxhash64(F.lit(1), "seat", "bytes").alias("r2"), "places")
    met = join_by_weight(where, runs, ["r1", "r2"])
    spans = F.flatten(F.transform("places", lambda q: F.transform("runs", lambda r: F.struct((q - r["high"]).alias("low"), (q - r["low"] + length).alias("high")))))
    met = met.select(*KEY, spans.alias("spans"))
    return texts, met.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    texts, spans = spans_of(docs.drop("doc_id"), length, group)
    ddl = "k1 long, k2 long, n long, n_removed long, n_spans long, kept_sha256 string"
    done = texts.join(spans, KEY, "left").select(*KEY, "n", "text", "spans").mapInArrow(_kept, ddl)
    done = scratch.keep(done)
    size = F.octet_length("text").cast("long").alias("n_bytes")
    nothing = [F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")]
    short = docs.where(F.octet_length("text") < length).select("doc_id", size, *nothing, F.sha2("text", 256).alias("kept_sha256"))
    long_ = docs.where(F.octet_length("text") >= length).select("doc_id", size, *KEY)
    return short.unionByName(join_by_weight(long_, done, KEY).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand twice or more in ``documents``, removed from every document."""
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op12_repeated_passages": op12_repeated_passages}
ORACLE_SQL: dict[str, str] = {}
