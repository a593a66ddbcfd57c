"""Near-duplicate documents by an LSH forest of MinHash signatures.

Every tree orders the documents by its own part of the signature; documents
with a long common prefix in some order are candidates. The depth adapts to
the region: a prefix of ``shallow`` values is enough where few documents share
it, and where many do the prefix is taken deeper until few are left. So regions
stay small, and those that are still large at full depth (texts almost alike)
are cut into parts. Deeper regions and parts also meet the pivot, the smallest
document of the shallow region; what is then not connected with the largest
component of a region that was cut meets each of its parts.

Candidates whose signatures agree well enough join a candidate group, and
within a group links are confirmed on full shingle sets. Large groups are cut
into parts that share some pivots; what is then not yet connected with the
group's largest component is compared with every part by bit tables that bound
what two sets can share, and pairs that may link are confirmed on the sets; so
nothing a group holds is left uncompared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.llm import texts
from recordlake.llm.components import connected_components
from recordlake.llm.groups import forest, grouped
from recordlake.llm.ship import ship
from recordlake.session import scratch_dir

TREES, DEPTH = 16, 8
DEPTHS = (4, 6, 8)  # prefixes that a region may have
REGION = 128  # documents of a region that meet in one group
GROUP = 192  # documents of a candidate group that meet in one group
PIVOTS = 8
BROADCAST_ROWS = 400_000  # of 24 bytes


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of sets of 64-bit hashes; an empty set has all ones."""
    rng = np.random.default_rng(97)
    factor = rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(sets), TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    for i, s in enumerate(sets):
        for a in range(0, len(s), 1024):
            values = (s[a:a + 1024, None] * factor[None, :]) >> np.uint64(32)
            np.minimum(out[i], values.min(0).astype(np.uint32), out=out[i])
    return out


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text (A-Z lower-cased)."""
    hashes, begin = texts.Words(column).shingles(words)
    return [np.unique(hashes[a:z]) for a, z in zip(begin, begin[1:])]


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums that identify a set, as one 16-byte key each."""
    out = np.empty((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        out[i] = texts.mix(s).sum(), texts.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))
    return out


@dataclass(frozen=True)
class _Sign:
    words: int

    def __call__(self):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1), self.words)
            key = fingerprints(sets).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]),
                 pa.array([s.tobytes() for s in signatures(sets)], pa.binary())], ["id", "n", "f1", "f2", "signature"])

        return work


@dataclass(frozen=True)
class _Trees:
    """One row per tree: the hashes of the prefixes."""

    def __call__(self, batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                n = batch.num_rows
                values = np.stack([np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(1)])
                parts = values.reshape(n, TREES, DEPTH).astype(np.uint64)
                hashed = np.broadcast_to(np.arange(TREES, dtype=np.uint64)[None, :] + np.uint64(1), (n, TREES))
                at = {}
                for d in range(DEPTH):
                    hashed = texts.mix(hashed * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, d])
                    at[d + 1] = hashed
                take = pa.array(np.repeat(np.arange(n), TREES))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), *(pa.array(at[d].ravel().view(np.int64)) for d in DEPTHS)],
                    ["id", *(f"p{d}" for d in DEPTHS)])


@dataclass(frozen=True)
class _Sketches:
    """A byte of every second value of the signature."""

    def __call__(self, batches):
        for batch in batches:
            made = [np.frombuffer(v.as_buffer(), np.uint32)[::2].astype(np.uint8).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "sketch"])


@dataclass(frozen=True)
class _Shared:
    """The rows of regions with two documents or more."""

    def __call__(self, table: pa.Table, starts: np.ndarray) -> pa.Table:
        sizes = np.diff(starts)
        return table.filter(pa.array(np.repeat(sizes > 1, sizes)))


@dataclass(frozen=True)
class _Candidates:
    """A spanning forest of each region's documents whose sketches agree in ``share`` of their bytes;
    with ``mark``, of pairs of a marked and an unmarked one of different components ``c``."""

    share: float

    def __call__(self, table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        ids, sketches = table.column("id").to_numpy(), table.column("sketch").chunk(0)
        crossing = "mark" in table.column_names
        if crossing:
            mark, c = table.column("mark").to_numpy(zero_copy_only=False), table.column("c").to_numpy()
        one, other = [], []
        for k in np.flatnonzero(np.diff(starts) > 1):
            a, z = int(starts[k]), int(starts[k + 1])
            sketch = np.stack([np.frombuffer(sketches[i].as_buffer(), np.uint8) for i in range(a, z)])
            linked = np.stack([(sketch == row).mean(1) for row in sketch]) >= self.share
            if crossing:
                linked &= (mark[a:z, None] != mark[None, a:z]) & (c[a:z, None] != c[None, a:z])
            root = forest(linked)
            hit = np.flatnonzero(root != np.arange(z - a))
            one.append(ids[a:z][hit])
            other.append(ids[a:z][root[hit]])
        if not one:
            return None
        return pa.table({"a": np.concatenate(one), "b": np.concatenate(other)})


@dataclass(frozen=True)
class _Sets:
    words: int

    def __call__(self):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(batch.num_columns - 1), self.words)
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())],
                                              [*batch.schema.names[:-1], "s"])

        return work


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; both ascending and distinct."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


@dataclass(frozen=True)
class _Confirm:
    """A spanning forest of the true links of each part of a candidate group; rows are compared
    unless they are already connected."""

    percent: int

    def __call__(self, table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        ids, data = table.column("id").to_numpy(), table.column("s").chunk(0)
        one, other = [], []
        for k in np.flatnonzero(np.diff(starts) > 1):
            a, z = int(starts[k]), int(starts[k + 1])
            sets = [np.frombuffer(data[i].as_buffer(), np.uint64) for i in range(a, z)]
            parts: list[list[int]] = []  # components so far, each with its rows
            for i in range(z - a):
                joined = [i]
                rest = []
                for part in parts:
                    # The newest first: near copies sort next to each other.
                    if any(ids[a + i] != ids[a + j] and alike(sets[i], sets[j], self.percent) for j in reversed(part)):
                        joined = part + joined
                    else:
                        rest.append(part)
                parts = [*rest, joined]
            for part in parts:
                if len(part) > 1:
                    own = ids[a:z][part]
                    one.append(own[1:])
                    other.append(np.full(len(own) - 1, own[0]))
        if not one:
            return None
        return pa.table({"a": np.concatenate(one), "b": np.concatenate(other)})


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept. Ids are integers.

    A text's set are its distinct shingles of ``words`` words (A-Z
    lower-cased), or its whole sequence of words if it has fewer; texts without
    words and null texts have an empty set and link with nothing. Two documents
    link if 100 * intersection >= percent * union of their full sets. The
    component is the smallest id reachable. Rows with a null id link with
    nothing and are kept; rows that repeat an id are one vertex, with the links
    of all its texts. Other columns are not read; an empty table gives no rows.

    Documents with equal sets are put together first. Whole texts are read
    twice: for the signatures, and for the sets of those in candidate groups.
    """
    spark = ship(docs.sparkSession)
    root = scratch_dir(spark, "minhash")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = kept(texts.map_rows(source, ["id", "text"], _Sign(words),
                                 "id long, n long, f1 long, f2 long, signature binary"), "signatures")
    usable = signed.where("n > 0 and id is not null")
    copies = kept(usable.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
                  .where("rep < last").select("f1", "f2", "rep"), "copies")
    same = kept(usable.select("id", "f1", "f2").join(_small(copies), ["f1", "f2"]).where("id <> rep")
                .select(F.col("id").alias("a"), F.col("rep").alias("b")), "same")
    # One document per set; the others hang on it.
    alone = usable.join(_small(copies), ["f1", "f2"], "left").where("rep is null or rep = id").select("id", "signature")
    trees = kept(alone.mapInArrow(_Trees(), "id long, p4 long, p6 long, p8 long"), "trees")
    sketches = alone.mapInArrow(_Sketches(), "id long, sketch binary")
    groups = connected_components(_candidate_edges(trees, sketches, percent, kept).union(same))
    groups = kept(groups.select(F.col("node").alias("id"), F.col("component").alias("g")), "groups")
    links = _confirm(source, groups, same, percent, words, kept)
    found = connected_components(links.union(same))
    component = F.coalesce("component", "id")
    return signed.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if the table (of a few numbers a row) is small enough, as counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that ``near_duplicates`` (``found``) keeps, with their columns: one of each
    component. Of rows that repeat an id the smallest (by all columns) stays; null ids stay."""
    dropped = found.where(~F.col("kept")).select(id_col).distinct()
    left = docs.join(_small(dropped), id_col, "left_anti")
    again = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    if again.isEmpty():
        return left.select(*docs.columns)
    once = (left.join(again, id_col, "left_semi").groupBy(id_col)
            .agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")).select("_row.*"))
    return left.join(again, id_col, "left_anti").select(*docs.columns).union(once)


def _candidate_edges(trees: DataFrame, sketches: DataFrame, percent: int, kept) -> DataFrame:
    """Edges between documents of a region with well-agreeing sketches; at most one per document and region."""
    current = trees.withColumn("region", F.col(f"p{DEPTHS[0]}")).withColumn("pivot", F.lit(None).cast("long"))
    columns = "region long, part int, id long, pivot long"
    done = []
    cut = None
    for at, depth in enumerate(DEPTHS):
        sizes = kept(current.groupBy("region").agg(F.count("*").alias("size"), F.min("id").alias("least"))
                     .where(F.col("size") > REGION), f"large{depth}")
        sized = current.join(_small(sizes), "region", "left")
        rest = sized.where("size is null").select("region", F.lit(0).alias("part"), "id", "pivot")
        # Alone in a region: no candidate, but for the pivot of the shallower region.
        done.append(rest if at else kept(grouped(rest, ["region"], _Shared(), columns), "shared"))
        if sizes.isEmpty():
            break
        large = kept(sized.where("size is not null").withColumn("pivot", F.coalesce("pivot", "least")), f"crowded{depth}")
        if at == len(DEPTHS) - 1:  # crowded at full depth
            part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / (REGION // 2))).cast("int").alias("part")
            done.append(large.select("region", part, "id", "pivot"))
            cut = large.select("region", "id")
        else:
            current = large.select(*trees.columns, F.xxhash64(F.col(f"p{DEPTHS[at + 1]}")).alias("region"), "pivot")
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    pivots = rows.where("pivot is not null and pivot <> id").select("region", "part", F.col("pivot").alias("id")).distinct()
    rows = rows.select("region", "part", "id").union(pivots).join(sketches, "id")
    share = max(0.0, percent / 100 - 0.19)  # four standard deviations of the sketch's agreement
    edges = kept(grouped(rows, ["region", "part"], _Candidates(share), "a long, b long").where("a <> b").distinct(), "candidates")
    return edges if cut is None else edges.union(_across(cut, edges, sketches, share, kept))


def _across(cut: DataFrame, edges: DataFrame, sketches: DataFrame, share: float, kept) -> DataFrame:
    """Edges between parts of the regions crowded at full depth (``cut``): of each region, what its
    largest component doesn't hold is compared with every part."""
    state = connected_components(edges).withColumnRenamed("node", "id")
    state = kept(cut.join(state, "id", "left").select("region", "id", F.coalesce("component", "id").alias("c")), "cut")
    tops = kept(state.groupBy("region", "c").agg(F.count("*").alias("k")).groupBy("region").agg(
        F.max_by("c", F.struct("k", "c")).alias("top"), F.sum("k").alias("size"), F.max("k").alias("most")).where("most < size").select(
        "region", "top", F.ceil(F.col("size") / (REGION // 2)).cast("int").alias("parts"),
        F.ceil((F.col("size") - F.col("most")) / (REGION // 2)).cast("int").alias("blocks")), "cut_tops")
    split = state.join(_small(tops), "region")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    block = F.pmod(F.xxhash64(F.lit("rest"), "id"), F.col("blocks")).cast("int")
    every = split.select("region", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                         "id", "c", F.lit(False).alias("mark"))
    moved = split.where("c <> top").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                           block.alias("block"), "id", "c", F.lit(True).alias("mark"))
    rows = every.union(moved).join(sketches, "id")
    return kept(grouped(rows, ["region", "part", "block"], _Candidates(share), "a long, b long").where("a <> b").distinct(), "across")


def _confirm(source: DataFrame, groups: DataFrame, same: DataFrame, percent: int, words: int, kept) -> DataFrame:
    """Spanning edges of the true links within the candidate groups."""
    # One document per set stands for its copies.
    members = groups.join(same.select(F.col("a").alias("id")), "id", "left_anti")
    sizes = kept(members.groupBy("g").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    large = sizes.where(F.col("size") > GROUP)
    members = kept(members.join(sizes, "g").select(
        "id", "g", F.ceil(F.col("size") / GROUP).cast("int").alias("parts")), "members")
    rows = members.count()
    small = F.broadcast(members) if rows <= BROADCAST_ROWS else members
    texts_of = source.where("id is not null").join(small, "id").select("id", "g", "parts", "text")
    sets = kept(texts.map_rows(texts_of, ["id", "g", "parts", "text"], _Sets(words), "id long, g long, parts int, s binary"), "sets")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    pivots = None
    first = sets.select("g", part.alias("part"), "id", "s")
    if not large.isEmpty():
        # The pivots, some documents of each large group, meet every part of it.
        names = sets.where("parts > 1").select("g", "id")
        chosen = [names.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
                  .where(F.col("rank") <= PIVOTS // 2).drop("rank") for order in (["id"], [F.xxhash64("id"), "id"])]
        pivots = kept(sets.join(_small(kept(chosen[0].union(chosen[1]).distinct(), "chosen")), ["g", "id"], "left_semi"), "pivots")
        first = first.union(pivots.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "s"))
    schema = "a long, b long"
    links = kept(grouped(first, ["g", "part"], _Confirm(percent), schema, ("id",)), "links")
    if pivots is None:
        return links
    # In large groups: what the largest component doesn't hold is compared with every part.
    state = connected_components(links).withColumnRenamed("node", "id")
    labelled = kept(sets.where("parts > 1").select("id", "g", "parts").join(state, "id", "left")
                    .select("id", "g", "parts", F.coalesce("component", "id").alias("c")), "labelled")
    tops = labelled.groupBy("g", "c").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("c", F.struct("k", "c")).alias("top"))
    rest = kept(labelled.join(kept(tops, "tops"), "g").where("c <> top").select("id", "g"), "rest")
    if rest.isEmpty():
        return links
    blocks = kept(rest.groupBy("g").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks")), "blocks")
    state = labelled.select("id", "c").join(rest.select("id", F.lit(True).alias("open")), "id", "left")
    bits = kept(sets.where("parts > 1").join(_small(blocks), "g").select("id", "g", "parts", "blocks", "s")
                .mapInArrow(_Bits(), "id long, g long, parts int, blocks int, n long, bits binary")
                .join(state, "id").withColumn("open", F.coalesce("open", F.lit(False))), "bits")
    block = F.pmod(F.xxhash64(F.lit("rest"), "id"), F.col("blocks")).cast("int")
    every = bits.select("g", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                        "id", "c", "n", "bits", F.lit(False).alias("mark"))
    moved = bits.where("open").select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), block.alias("block"),
                                      "id", "c", "n", "bits", F.lit(True).alias("mark"))
    pairs = kept(grouped(every.union(moved), ["g", "part", "block"], _Bound(percent), schema).distinct(), "pairs")
    needed = kept(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    own = sets.select("id", "s").join(_small(needed), "id", "left_semi")
    both = pairs.join(own.withColumnRenamed("id", "a"), "a").withColumnRenamed("s", "x").join(own.withColumnRenamed("id", "b"), "b")
    return links.union(kept(both.select("a", "b", "x", "s").mapInArrow(_Alike(percent), schema), "more"))


@dataclass(frozen=True)
class _Bits:
    """The parity of how many of a set's elements fall on each of 4 to 8 bits per element."""

    def __call__(self, batches):
        for batch in batches:
            made, sizes = [], []
            for v in batch.column(4):
                x = np.frombuffer(v.as_buffer(), np.uint64)
                m = max(64, 1 << int(4 * len(x) - 1).bit_length())
                parity = np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1
                made.append(np.packbits(parity, bitorder="little").tobytes())
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(made, pa.binary())],
                                             ["id", "g", "parts", "blocks", "n", "bits"])


@dataclass(frozen=True)
class _Bound:
    """Pairs (marked and not, of different components) whose sets may link: two sets differ in as many
    elements, at least, as their parities differ in bits, and that bounds what they share."""

    percent: int

    def __call__(self, table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        ids, comp, n = (table.column(c).to_numpy() for c in ("id", "c", "n"))
        mark, bits = table.column("mark").to_numpy(zero_copy_only=False), table.column("bits").chunk(0)
        one, other = [], []
        for a, z in zip(starts, starts[1:]):
            rows = np.arange(a, z)
            open_, rest = rows[mark[a:z]], rows[~mark[a:z]]
            if not len(open_) or not len(rest):
                continue
            words = {i: np.frombuffer(bits[i].as_buffer(), np.uint64) for i in rows.tolist()}
            by_size = {m: [i for i in rest.tolist() if len(words[i]) == m] for m in {len(words[i]) for i in rest.tolist()}}
            stacked = {m: np.stack([words[i] for i in own]) for m, own in by_size.items()}
            for i in open_.tolist():
                for m, own in by_size.items():
                    x, y = words[i], stacked[m]
                    while len(x) > m:  # a table of half the size is the parity of both halves
                        x = x[:len(x) // 2] ^ x[len(x) // 2:]
                    while y.shape[1] > len(x):
                        y = y[:, :y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
                    at = np.array(own)
                    total = n[i] + n[at]
                    shared = np.minimum((total - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)) // 2, np.minimum(n[i], n[at]))
                    hit = at[(100 * shared >= self.percent * (total - shared)) & (comp[at] != comp[i])]
                    one.append(np.minimum(ids[hit], ids[i]))
                    other.append(np.maximum(ids[hit], ids[i]))
        if not one:
            return None
        return pa.table({"a": np.concatenate(one), "b": np.concatenate(other)})


@dataclass(frozen=True)
class _Alike:
    percent: int

    def __call__(self, batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            hit = [alike(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), self.percent)
                   for p, q in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(hit, pa.bool_()))
