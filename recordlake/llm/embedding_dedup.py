"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction on the sphere and holds the vectors whose cosine with
it is at least ``height``. Directions are the product of short random codes:
the vector is turned, cut into blocks, and each block has a code of random unit
vectors; every combination of one code word per block is a direction. A vector
lists all directions it exceeds by walking the blocks, leaving a branch when
even the best remaining code words cannot reach the height. Vectors that share
a filter are compared; several turns make a link's miss unlikely.

The height follows from the wanted number of filters per vector (a quantile for
random vectors), and the codes' size from the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.llm.components import connected_components
from recordlake.llm.groups import forest, grouped
from recordlake.llm.ship import ship
from recordlake.session import scratch_dir

BLOCK = 384  # vectors of a filter that meet in one group


@dataclass(frozen=True)
class Filters:
    """``turns`` independent product codes over ``dims`` dimensions, ``words`` code words for each of two blocks."""

    dims: int
    words: int
    turns: int
    height: float
    at_least: int  # filters per turn that every vector gets

    def codes(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        rng = np.random.default_rng(20_240_607)
        out = []
        for _ in range(self.turns):
            turn = np.linalg.qr(rng.normal(size=(self.dims, self.dims)))[0]
            blocks = [rng.normal(size=(self.words, len(x))) for x in np.array_split(np.arange(self.dims), min(2, self.dims))]
            out.append((turn, [b / np.linalg.norm(b, axis=1, keepdims=True) for b in blocks]))
        return out


def choose(dims: int, words: int, turns: int = 3, wanted: float = 6, at_least: int = 5) -> Filters:
    """Filters whose caps hold, of random vectors, ``wanted`` per turn on average."""
    plain = Filters(dims, words, turns, 0.0, at_least)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(64, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, blocks = plain.codes()[0]
    scores = block_scores(x @ turn, blocks)
    best = np.concatenate([_top(parts, 1 << 14) for parts in zip(*scores)])
    total = words ** len(blocks)
    height = float(np.sort(best)[::-1][min(len(best) - 1, int(wanted * len(x)))]) if total > wanted else -1.0
    return Filters(dims, words, turns, height, at_least)


def block_scores(x: np.ndarray, blocks: list[np.ndarray]) -> list[np.ndarray]:
    edges = np.cumsum([0, *(b.shape[1] for b in blocks)])
    return [x[:, a:z] @ b.T / np.sqrt(len(blocks)) for a, z, b in zip(edges, edges[1:], blocks)]


def decode(parts: tuple[np.ndarray, ...], height: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes and scores of all combinations that reach ``height``."""
    rest = np.append(np.cumsum([p.max() for p in parts][::-1])[::-1][1:], 0.0)
    code, score = np.zeros(1, np.int64), np.zeros(1)
    for p, best in zip(parts, rest):
        score = score[:, None] + p[None, :]
        code = code[:, None] * len(p) + np.arange(len(p))[None, :]
        keep = score + best >= height
        code, score = code[keep], score[keep]
    return code, score


def _top(parts: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    reach = [np.sort(p)[::-1][:n if n <= 64 else int(np.sqrt(n))] for p in parts]
    score = np.zeros(1)
    for p in reach:
        score = (score[:, None] + p[None, :]).ravel()
    return np.sort(score)[::-1][:n]


def listed(x: np.ndarray, filters: Filters) -> list[np.ndarray]:
    """For each unit vector the numbers of its filters, ascending."""
    per_turn = filters.words ** min(2, filters.dims)
    out: list[list[np.ndarray]] = [[] for _ in x]
    for t, (turn, blocks) in enumerate(filters.codes()):
        for i, parts in enumerate(zip(*block_scores(x @ turn, blocks))):
            code, _ = decode(parts, filters.height)
            if len(code) < filters.at_least:  # the best ones instead
                lowest = _top(parts, filters.at_least)[-1]
                code, _ = decode(parts, lowest - 1e-12)
            out[i].append(np.sort(code) + t * per_turn)
    return [np.concatenate(c) for c in out]


def unit(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows (as indices) of full, finite, non-zero vectors, and these as unit vectors in double precision."""
    rows: dict[int, list[int]] = {}
    for i, v in enumerate(column):
        if v.is_valid and len(v.values) and v.values.null_count == 0:
            rows.setdefault(len(v.values), []).append(i)
    out = {}
    for width, own in rows.items():
        x = np.stack([column[i].values.to_numpy(zero_copy_only=False).astype(np.float64) for i in own])
        scale = np.abs(x).max(1)
        ok = np.isfinite(scale) & (scale > 0)
        x = x[ok] / scale[ok, None]
        out[width] = np.array(own)[ok], x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def linkable(vector: str) -> Column:
    """Whether an array has components, none of them null, NaN or infinite, and not all of them zero (as in ``unit``)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


_chosen: dict[tuple[int, int, int], Filters] = {}


@dataclass(frozen=True)
class _List:
    words: int
    turns: int

    def __call__(self, batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                for width, (rows, x) in unit(batch.column(2)).items():
                    if not len(rows):
                        continue
                    key = width, self.words, self.turns
                    if key not in _chosen:
                        _chosen[key] = choose(*key)
                    own = listed(x, _chosen[key])
                    owner = np.repeat(np.arange(len(rows)), [len(f) for f in own])
                    take = pa.array(rows[owner])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), batch.column(3).take(take),
                         pa.array([width] * len(owner), pa.int32()), pa.array(np.concatenate(own)),
                         pa.array([f.astype("<i4").tobytes() for f in own], pa.binary()).take(pa.array(owner)),
                         pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(owner))],
                        ["id", "label", "n", "width", "filter", "filters", "x"])


@dataclass(frozen=True)
class _Compare:
    """Links of one filter's vectors (or of two of its parts) that no lower filter shows, counted per vector."""

    cosine: float

    def __call__(self, table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        sizes = np.diff(starts)
        ids, links, roots, weight = [], [], [], table.column("n").to_numpy()
        key, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        one, other = table.column("one").to_numpy(), table.column("other").to_numpy()
        number, check = table.column("filter").to_numpy(), table.column("check").to_numpy()
        xs, fs = table.column("x").chunk(0), table.column("filters").chunk(0)
        for k in np.flatnonzero(sizes > 1):
            a, z = int(starts[k]), int(starts[k + 1])
            x = np.stack([np.frombuffer(xs[i].as_buffer(), np.float64) for i in range(a, z)])
            linked = x @ x.T >= self.cosine
            np.fill_diagonal(linked, False)
            if len(np.unique(check[a:z])) > 1:  # the bucket's hash holds several filters or labels
                linked &= check[a:z, None] == check[None, a:z]
            if one[a] != other[a]:  # two parts: each compares its own rows elsewhere
                linked &= part[a:z, None] != part[None, a:z]
            if not linked.any():
                continue
            root = forest(linked)
            hit = np.flatnonzero(linked.any(1))
            own = [np.frombuffer(fs[a + i].as_buffer(), "<i4") for i in hit]
            lower = [f[f < number[a]] for f in own]
            values = np.concatenate(lower)
            if len(values):
                names, column = np.unique(values, return_inverse=True)
                member = np.zeros((len(hit), len(names)), np.float32)
                member[np.repeat(np.arange(len(hit)), [len(f) for f in lower]), column] = 1
                linked[np.ix_(hit, hit)] &= member @ member.T < 0.5
            ids.append(key[a:z][hit])
            links.append((linked * weight[None, a:z]).sum(1)[hit])
            roots.append(key[a:z][root[hit]])
        if not ids:
            return None
        return pa.table({"id": np.concatenate(ids), "n_links": np.concatenate(links).astype(np.int64), "root": np.concatenate(roots)})


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str | None = "label", words: int | None = None, turns: int = 3) -> DataFrame:
    """Per row: id, n_links, component_id, kept. Ids are integers.

    Linked are vectors with equal labels (not null; ``label_col=None``: all)
    whose cosine in double precision is at least ``cosine``; n_links counts
    the other vectors linked directly, copies included. Null, empty and zero
    vectors and such with null or non-finite components link with nothing;
    vectors of different lengths do neither. Rows with a null id or label link
    with nothing; a null id is kept, with a null component. Rows that repeat an
    id are one vertex: their links add up on each of the rows. Ties need no rule: the component is
    the smallest id. Other columns are not read.

    Exact copies (label and components) are put together first and stand for
    their number. A filter with many vectors is cut into parts, and every pair
    of parts is a group, so no group is unbounded. A pair is counted in the
    first filter that it shares and goes nowhere itself: groups return counts
    and a spanning forest. ``words`` (code words per block) grows with the
    number of vectors, so that filters stay small.
    """
    spark = ship(vectors.sparkSession)
    root = scratch_dir(spark, "embeddings")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    keyed = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("v"))
    # Equal vectors, by label and components; distinct ids only.
    digest = F.sha2(F.concat_ws(",", "label", F.to_json(F.col("v"))), 256)
    usable = keyed.where("id is not null and label is not null and v is not null").where(linkable("v")).withColumn("digest", digest)
    usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").write.parquet(f"{root}/copies")
    copies = spark.read.parquet(f"{root}/copies")
    usable.select("id", "digest").join(copies, "digest").select("id", "rep", "n").write.parquet(f"{root}/members")
    members = spark.read.parquet(f"{root}/members")
    alone = usable.join(copies, "digest", "left").where("rep is null or rep = id").select(
        "id", "label", "v", F.coalesce("n", F.lit(1)).alias("n")).dropDuplicates(["id", "label", "v"])
    alone.write.parquet(f"{root}/distinct")
    distinct = spark.read.parquet(f"{root}/distinct")
    total = distinct.count()
    words = words or int(min(2048, max(128, 2 ** np.ceil(np.log2(np.sqrt(max(1, total) / 4))))))
    same = ["label", "width", "filter"]
    distinct.select("id", "label", "v", "n").mapInArrow(
        _List(words, turns), "id long, label string, n long, width int, filter long, filters binary, x binary").select(
        "id", "n", "filter", "filters", "x", F.xxhash64(*same).alias("bucket"),
        F.xxhash64(F.lit("check"), *same).alias("check")).write.parquet(f"{root}/filters")
    rows = spark.read.parquet(f"{root}/filters")
    rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").write.parquet(f"{root}/sizes")
    sizes = spark.read.parquet(f"{root}/sizes").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    cut = rows.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    pairs = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("other"), "part", "id", "n",
        "filter", "check", "filters", "x")
    grouped(pairs, ["bucket", "one", "other"], _Compare(cosine), "id long, n_links long, root long").write.parquet(f"{root}/links")
    links = spark.read.parquet(f"{root}/links")
    edges = links.select(F.col("id").alias("a"), F.col("root").alias("b")).union(members.select("id", "rep"))
    components = connected_components(edges)
    direct = links.groupBy("id").agg(F.sum("n_links").alias("between"))
    shared = members.groupBy("id").agg(F.first("rep").alias("rep"), F.first("n").alias("n"))
    per_copy = shared.join(direct.withColumnRenamed("id", "rep"), "rep", "left").select(
        "id", (F.col("n") - 1 + F.coalesce("between", F.lit(0))).alias("copied"))
    found = (keyed.select("id").join(components.withColumnRenamed("node", "id"), "id", "left")
             .join(direct, "id", "left").join(per_copy, "id", "left"))
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias(id_col), F.coalesce("copied", "between", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
