"""SimHash near-duplicates (operator 3): exact search within a Hamming radius, then components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete
from .common import bands_needed, fresh, join_per_key, materialize, shingle_hashes, table, written
from .containment import SHINGLE, norm_words, shingled

BITS = 64
SEED = 42
#: Largest bucket that is compared pair by pair, in one NumPy call; larger ones are split by more bits.
BUCKET = 4096
#: Shingles whose bits are summed at a time.
_CHUNK = 1 << 16
#: MinHashes of a text in :func:`marked`, and of a band of them; MinHashes by which groups are compared.
MINHASHES, BAND, WIDE = 48, 3, 512
#: Nodes, and shingles of nodes, that a chunk of a cell has at most, about; two chunks are compared at a time.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
#: Chunks of a cell beyond which it is cut by bands of this many of its wide MinHashes.
SPLIT, ROWS = 64, 8
#: Columns of links.
LINK = {"a": "long", "b": "long"}
#: Ids of candidates that are broadcast at most (about 30 bytes each); beyond that their texts are found by shuffle.
BROADCAST_IDS = 4_000_000


def text_words(text: str | None) -> list[bytes]:
    """The words of ``text``, A-Z as a-z."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def fingerprint(w: list[bytes], shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the shingles of the words ``w``; 0 without a word.

    A bit is 1 if set in over half of the shingles' XXH64 values, repeats included.
    """
    if not w:
        return 0
    runs = [b" ".join(x) for x in zip(*(w[i:] for i in range(shingle)), strict=False)] if len(w) >= shingle else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), dtype="<u8", count=len(runs))
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(h)))
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``key, fingerprint`` (long) of each row's ``text``."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(text_words(t.as_py()), shingle) for t in b.column(1)], pa.int64())
            yield pa.record_batch([b.column(0), found], names=[key, "fingerprint"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, fingerprint long")


# --- The search: general pigeonhole over groups of bits ---------------------------------------


def bit_counts(values: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how often each pair of bits is set together, over all ``fingerprint`` rows.

    Each task sends one 64 x 64 table; Spark adds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        n = 0
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            x = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(x), _CHUNK):
                total += x[i : i + _CHUNK].T @ x[i : i + _CHUNK]
            n += len(h)
        cells = np.append(total.ravel(), n).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    sums = values.select("fingerprint").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1)
    for r in sums.collect():  # 4097 rows whatever the input
        flat[r[0]] = r[1]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """``parts`` groups of bits of near-equal size, bits that are correlated in one group."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        size = len(left) // (parts - i)
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: corr[b, group].mean())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def within(agree: np.ndarray, most: int) -> list[float]:
    """Share of pairs that differ in at most 0..``most`` of some bits, if bits were independent."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for a in agree:
        dist = dist * a + np.append(0, dist[:-1]) * (1 - a)
    return np.cumsum(dist).tolist()


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds (-1, 0, 1, ...) of the parts that sum to ``total`` at the least cost; ``costs[i][t + 1]`` is part i's at t.

    Dynamic programming over parts and the sum so far.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                new = (c + cost[t + 1], [*chosen, t])
                if used + t not in step or new[0] < step[used + t][0]:
                    step[used + t] = new
        best = step
    return best[total][1]


def plan_masks(values: DataFrame, radius: int, row_cost: float = 4.0) -> list[int]:
    """Bit masks such that any two fingerprints within ``radius`` agree on all bits of at least one.

    General pigeonhole: if the thresholds of ``m`` parts sum to ``radius - m + 1``, such a pair is
    within the threshold in some part. Threshold -1 leaves a part out; threshold t means every choice
    of t of its bits is masked out in turn. Candidates at 0 are counted exactly, over all values; at
    1 and more they are that count scaled by a model of independent bits.
    """
    parts = (3 + radius // 6, 4 + radius // 6)
    n, together = bit_counts(values)
    p = np.diag(together) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    layouts = {m: group_bits(n, together, m) for m in parts}
    keyed = F.array(
        *[
            F.struct(F.lit(m * 100 + i).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(mask_of(g)).cast("long")).alias("v"))
            for m, groups in layouts.items()
            for i, g in enumerate(groups)
        ]
    )
    buckets = values.select(F.explode(keyed).alias("k")).groupBy("k.part", "k.v").agg(F.count(F.lit(1)).alias("n"))
    pairs = buckets.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs"))
    exact = {r[0]: r[1] for r in pairs.collect()}
    options = []
    for m, groups in layouts.items():
        costs = []
        for i, g in enumerate(groups):
            model = within(agree[g], radius)
            scale = max(exact.get(m * 100 + i, 0.0), 1.0) / max(model[0], 1e-300)
            keys = [len(list(combinations(g, t))) for t in range(radius + 1)]
            costs.append([0.0, *[model[t] * scale + row_cost * n * keys[t] for t in range(radius + 1)]])
        chosen = allocate(costs, radius - m + 1)
        options.append((sum(c[t + 1] for c, t in zip(costs, chosen, strict=True)), groups, chosen))
    _, groups, chosen = min(options, key=lambda o: o[0])
    return [mask_of([b for b in g if b not in left]) for g, t in zip(groups, chosen, strict=True) if t >= 0 for left in combinations(g, t)]


def links_in_bucket(values: np.ndarray, radius: int) -> np.ndarray:
    """For each of the (distinct, unsigned, sorted) values the least value of its component within the bucket."""
    root, left = values.copy(), np.arange(len(values))
    while left.size:
        first, left = left[0], left[1:]
        queue = [first]
        while queue and left.size:
            near = np.bitwise_count(values[left] ^ values[queue.pop()]) <= radius
            if near.any():
                found, left = left[near], left[~near]
                root[found] = values[first]
                queue += found.tolist()
    return root


def _bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """``a, b``: a star for each component within each (``k``, ``v``) bucket; buckets have ``BUCKET`` values at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), dtype=np.int64)

        def star(rows: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            starts = np.concatenate(([0], edge))
            sizes = np.diff(np.append(starts, rows.shape[1]))
            values = np.ascontiguousarray(rows[2]).view(np.uint64)
            two = starts[sizes == 2]
            near = two[np.bitwise_count(values[two] ^ values[two + 1]) <= radius]
            a, b = [values[near]], [values[near + 1]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                own = np.unique(values[s : s + n])
                root = links_in_bucket(own, radius)
                a.append(own[own != root])
                b.append(root[own != root])
            cols = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
            return pa.record_batch(cols, names=["a", "b"])

        for batch in batches:
            rows = np.vstack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            rest = np.hstack([rest, rows])
            if rest.shape[1]:
                last = np.flatnonzero((rest[0] != rest[0, -1]) | (rest[1] != rest[1, -1]))
                whole = last[-1] + 1 if len(last) else 0
                if whole:
                    yield star(rest[:, :whole])
                    rest = rest[:, whole:]
        if rest.shape[1]:
            yield star(rest)

    dealt = keyed.repartition("k", "v").sortWithinPartitions("k", "v", "fingerprint")
    return dealt.select("k", "v", "fingerprint").mapInArrow(run, "a long, b long")


def find_links(values: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links between distinct ``fingerprint`` values whose components are those of all pairs within ``radius``.

    Buckets of equal masked value are compared whole if they hold ``bucket`` values or fewer. A larger
    one is split exactly: its values agree on the mask, so two near ones agree on one of
    ``radius + 1`` shares of the other bits too; each value goes on under each of these wider masks.
    Few bits are left after a few rounds, and then a bucket cannot be large.
    """
    masks = plan_masks(values, radius)
    cell = lambda masks: F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(masks)])
    keyed = values.select("fingerprint", F.explode(cell(masks)).alias("c")).select("fingerprint", "c.k", "c.v")
    found = None
    while True:
        sizes = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = materialize(sizes, "simhash-buckets")
        links = _bucket_links(keyed.join(sizes.where(F.col("n") <= bucket), ["k", "v"]), radius)
        found = links if found is None else found.unionByName(links)
        hot = sizes.where(F.col("n") > bucket).select("k", "v")
        if hot.isEmpty():
            return found.distinct()
        wider: list[int] = []
        for m in masks:
            free = [b for b in range(BITS) if not (m >> b) & 1]
            wider += [mask_of([b for b in range(BITS) if (m >> b) & 1] + free[i :: radius + 1]) for i in range(radius + 1)]
        table_ = F.array(*[F.lit(m).cast("long") for m in wider])
        sub = F.explode(F.sequence(F.col("k") * (radius + 1), F.col("k") * (radius + 1) + radius))
        keyed = keyed.join(hot, ["k", "v"]).select("fingerprint", sub.alias("k"))
        keyed = keyed.select("fingerprint", "k", F.col("fingerprint").bitwiseAND(F.get(table_, F.col("k").cast("int"))).alias("v")).distinct()
        keyed = materialize(keyed, "simhash-split")
        masks = wider


# --- Components ---------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``): the least node that it reaches.

    Alternating large-star and small-star rounds, each written to the shared folder in place of the
    one before; a chain of n nodes takes about log n of them. A node with many links is summed in
    parts and joined by broadcast, never gathered.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))

    path, edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    now = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = join_per_key(both, least(both), "a", total=2 * now[0]).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        middle, large = written(large, "links")
        pairs = join_per_key(large, least(large), "a", total=now[0])
        stars = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        last, (path, edges) = path, written(pairs.select(stars.alias("e")).select("e.a", "e.b").where("a > b").distinct(), "links")
        for old in (last, middle):
            delete(edges.sparkSession, old)
        was, now = now, state(edges)
        if was == now:
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs`` (``doc_id, text``).

    Fingerprints (16 lower-case hex digits) link at ``radius`` or fewer differing bits;
    ``component_id`` is the least doc_id reachable. Copies share a fingerprint and are searched once,
    whatever their number. Null, empty and wordless texts have fingerprint 0 and link like others;
    repeated rows are rows of one component; rows without doc_id get their component's least doc_id,
    or null if it has none; an empty table gives an empty result. A bit that just half of the shingles
    have is not set. Texts of any length count whole; other columns are not read.
    """
    rows = materialize(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), shingle=shingle), "fingerprints")
    values = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-values")
    roots = materialize(components(find_links(values, radius, bucket)), "fingerprint-roots")
    rooted = values.join(roots, values["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.col("n").alias("rows"), F.coalesce("root", "fingerprint").alias("root"))
    rooted = materialize(rooted, "fingerprint-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    labels = join_per_key(rooted, ids, "root").select("fingerprint", "component_id", F.col("rows").alias("n"))
    return join_per_key(rows, labels, "fingerprint").select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


# --- One document of each group of near copies ----------------------------------------------------


def least_agreement(similarity: float, miss: float, of: int = MINHASHES) -> int:
    """MinHashes of ``of`` in which a pair of this Jaccard similarity agrees, or in more, with probability ``1 - miss`` at least."""
    below, m = 0.0, 0
    while below <= miss:
        below += comb(of, m) * similarity**m * (1 - similarity) ** (of - m)
        m += 1
    return m - 1


def minhashes(h: np.ndarray, n: int = MINHASHES) -> np.ndarray:
    """``n`` minima of the shingle hashes ``h`` (unsigned, not empty)."""
    draw = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, n), dtype=np.uint64)
    flip, times = draw[0][:, None], draw[1][:, None] | np.uint64(1)
    low = np.full(n, np.iinfo(np.uint64).max)
    step = max(1, (1 << 16) // n)
    for i in range(0, len(h), step):
        low = np.minimum(low, ((h[None, i : i + step] ^ flip) * times).min(axis=1))
    return low


def wide_signs(hashed: DataFrame) -> DataFrame:
    """``node, sign, size``: a byte of each of ``WIDE`` MinHashes of the shingle hashes ``h``, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [x.values.to_numpy(zero_copy_only=False).astype("<i8").view(np.uint64) for x in b.column(1)]
            signs = pa.array([minhashes(h, WIDE).astype(np.uint8).tobytes() for h in hashes], pa.binary())
            yield pa.record_batch([b.column(0), signs, pa.array([len(h) for h in hashes], pa.int32())], names=["node", "sign", "size"])

    return hashed.select("node", "h").mapInArrow(run, "node long, sign binary, size int")


def marked(docs: DataFrame, bands: int, shingle: int) -> DataFrame:
    """``doc_id, same, fingerprint, keys, sign`` of each row, in one pass over the texts.

    ``same``: 128-bit hash of the words; ``keys``: one of each of ``bands`` groups of ``BAND``
    MinHashes of the five-word shingles; ``sign``: a byte of each MinHash. The last two are null for
    texts without a shingle. Nothing here depends on other rows.
    """
    weight = np.random.default_rng(SEED + 1).integers(0, 1 << 64, size=BAND, dtype=np.uint64) | np.uint64(1)
    schema = "doc_id long, same binary, fingerprint long, keys array<long>, sign binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, prints, keys, signs = [], [], [], []
            for text, hashes in zip(b.column(1), b.column(2), strict=True):
                w = text_words(text.as_py())
                same.append(xxhash.xxh3_128_digest(b" ".join(w)))
                prints.append(fingerprint(w, shingle))
                h = hashes.values.to_numpy(zero_copy_only=False).astype("<i8").view(np.uint64)
                low = minhashes(h) if len(h) else None
                keys.append(None if low is None else (low[: bands * BAND].reshape(bands, BAND) * weight).sum(axis=1, dtype=np.uint64).view(np.int64))
                signs.append(None if low is None else low.astype(np.uint8).tobytes())
            cols = [b.column(0), pa.array(same, pa.binary()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.record_batch(cols, names=["doc_id", "same", "fingerprint", "keys", "sign"])

    hashed = docs.select(F.col("doc_id").cast("long"), "text", F.transform(norm_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    return hashed.select("doc_id", "text", shingle_hashes(F.col("w"), SHINGLE).alias("h")).mapInArrow(run, schema)


def spanning_pairs(ids: np.ndarray, signs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs that join all that agree in ``least`` MinHashes or more, most alike first (Prim's trees)."""
    left, out = np.ones(len(ids), dtype=bool), []
    best, parent = np.full(len(ids), -1), np.zeros(len(ids), dtype=np.int64)
    for _ in range(len(ids)):
        reach = np.where(left, best, -2)
        at = int(reach.argmax())
        if best[at] >= least:
            out.append((int(ids[at]), int(ids[parent[at]])))
        left[at] = False
        agree = (signs == signs[at]).sum(axis=1)
        closer = left & (agree > best)
        best[closer], parent[closer] = agree[closer], at
    return out


def agreeing(signs: np.ndarray, least: int, group: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each row with the later rows of other groups that agree with it in ``least`` MinHashes or more.

    Where there are two ``part`` values, only rows of different parts are compared.
    """
    two = part.min() != part.max()
    for i in range(len(signs) - 1):
        other = group[i + 1 :] != group[i]
        if two:
            other &= part[i + 1 :] != part[i]
        later = i + 1 + np.flatnonzero(other)
        near = later[(signs[later] == signs[i]).sum(axis=1) >= least]
        if len(near):
            yield i, near


def linking_pairs(ids: list[int], hashes: list[np.ndarray], signs: np.ndarray, least: int, group: list[int], part: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of Jaccard ``similarity`` or more among those :func:`agreeing`, less those whose groups earlier ones have joined."""
    root = {g: g for g in group}

    def top(g: int) -> int:
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    place = np.split(np.unique(np.concatenate(hashes), return_inverse=True)[1], np.cumsum([len(h) for h in hashes])[:-1])
    mark, out = np.zeros(1 + max(int(x.max()) for x in place), dtype=bool), []
    for i, near in agreeing(signs, least, np.array(group), part):
        mark[place[i]] = True
        for j in near.tolist():
            x, y = top(group[i]), top(group[j])
            if x != y:
                both = int(np.count_nonzero(mark[place[j]]))
                if both >= similarity * (len(place[i]) + len(place[j]) - both):
                    out.append((ids[i], ids[j]))
                    root[x] = y
        mark[place[i]] = False
    return out


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The first three columns of each run of rows in which these are equal, and the other columns of its rows."""
    key, rows = None, []
    for b in batches:
        cols = [[x.values.to_numpy(zero_copy_only=False) for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in b.columns]
        for row in zip(*cols, strict=True):
            if row[:3] != key:
                if rows:
                    yield key, rows
                key, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield key, rows


def _by_block(blocks: DataFrame, columns: list[str], find: Callable[..., list[tuple]], out: dict[str, str]) -> DataFrame:
    """What ``find(key, *columns)`` gives for each block (``cell, i, j``) of two rows or more, as columns ``out``; a block has few rows."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in out.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [()] * len(schema)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for key, rows in _each_block(batches):
            if len(rows) > 1:
                done += find(key, *zip(*rows, strict=True))
            if len(done) >= CHUNK:
                yield table()
                done.clear()
        yield table()

    dealt = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")
    return dealt.select("cell", "i", "j", *columns).mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in out.items()))


def _matrix(signs: tuple[bytes, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), dtype=np.uint8).reshape(len(signs), -1)


def _only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` (``node, ...``) with a ``node`` of ``ids``; up to ``BROADCAST_IDS`` ids (counted) no row of ``df`` is shuffled."""
    ids = materialize(ids.select("node").distinct(), "near-ids")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")


def _cut_large(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``cell, node, comp, sign, size``) with cells of more than ``SPLIT`` chunks cut into smaller ones.

    The chunks of a cell are compared two by two, so a node is sent to each of them. Beyond ``SPLIT`` it
    is cheaper to cut the cell: a node goes to a cell for each band of ``ROWS`` of its ``WIDE`` MinHashes,
    ``WIDE / ROWS`` at most, and cells of one group are left out. Texts of similarity 0.8 have no
    band in common with a probability of (1 - 0.8 ** 8) ** 64, under one in a hundred thousand.
    """
    n = nodes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT * CHUNK)
    n = materialize(n, "near-large")
    if n.isEmpty():
        return nodes
    few = F.broadcast(n) if n.count() <= BROADCAST_IDS else n
    large = nodes.join(few, "cell").drop("n")
    band = F.explode(F.sequence(F.lit(0), F.lit(WIDE // ROWS - 1)))
    cut = large.withColumn("band", band).withColumn("cell", F.xxhash64("cell", "band", F.substring("sign", F.col("band") * ROWS + 1, F.lit(ROWS)))).drop("band")
    cut = materialize(cut, "near-cut")
    mixed = cut.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("cell", "n")
    kept = join_per_key(cut, mixed, "cell").drop("n")
    return materialize(nodes.join(few.select("cell"), "cell", "left_anti").unionByName(kept.select(*nodes.columns)), "near-members")


def similar_groups(docs: DataFrame, cells: DataFrame, signs: DataFrame, similarity: float, miss: float) -> DataFrame:
    """``node, root``: each doc_id that is linked to others, and the least one that its links reach.

    Linked are doc_ids that share a cell and whose shingles have Jaccard ``similarity`` or more;
    ``cells`` has distinct ``cell, node`` rows. Only pairs that agree in enough MinHashes are
    verified; a pair at ``similarity`` does with probability ``1 - miss`` at least. In a first round
    trees of the most alike of each cell are verified, which makes one group of most that belong
    together. Then pairs of different groups are, if they agree in enough of ``WIDE`` MinHashes:
    the nodes that have such a pair are sent with their shingles to where their chunks are compared,
    and only links come out, at most one less than the groups of a block. Cells are compared in
    chunks of about ``CHUNK`` nodes and ``CHUNK_SHINGLES`` shingles, two at a time, so no task gets
    a large one; a table has rows for tree pairs and links alone.
    """
    least, agree = least_agreement(similarity, miss), least_agreement(similarity, miss, WIDE)
    several = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1")
    members = materialize(join_per_key(cells, several, "cell").join(signs, "node"), "near-members")
    texts = _only(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), members)
    text = materialize(shingled(texts, "node").select("node", F.array_distinct("h").alias("h")), "near-shingles")

    def alike(pairs: DataFrame) -> DataFrame:
        some = _only(text, pairs.select(F.explode(F.array("a", "b")).alias("node")))
        sides = pairs.join(some.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(some.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
        both = F.size(F.array_intersect("ha", "hb"))
        return materialize(sides.where(both >= similarity * (F.size("ha") + F.size("hb") - both)).select("a", "b"), "near-links")

    def trees(_: tuple, ids: tuple, s: tuple) -> list[tuple]:
        return [(max(p), min(p)) for p in spanning_pairs(np.array(ids), _matrix(s), least)]

    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = lambda parts: F.pmod(F.xxhash64("node", F.lit(SEED)), parts).cast("int")
    dealt = members.select("cell", chunk(parts).alias("i"), F.lit(0).alias("j"), "node", "sign")
    heads = members.where(F.col("n") > CHUNK).groupBy("cell", chunk(parts).alias("i")).agg(F.min("node").alias("a"), F.min("lead").alias("b")).where("a > b").select("a", "b")
    first = materialize(_by_block(dealt, ["node", "sign"], trees, LINK).unionByName(heads).distinct(), "near-pairs")
    roots = materialize(components(alike(first)), "near-roots")

    grouped = members.join(roots, "node", "left").select("cell", "node", F.coalesce("root", "node").alias("comp"))
    grouped = materialize(grouped, "near-members")
    open_ = grouped.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("cell", "n")
    rest = join_per_key(grouped, open_, "cell").drop("n")
    rest = materialize(rest.join(wide_signs(_only(text, rest)), "node"), "near-members")
    rest = _cut_large(rest)
    sizes = rest.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    parts = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int")
    rest = join_per_key(rest, sizes, "cell").withColumn("c", chunk(parts)).withColumn("o", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = rest.select("cell", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "comp", "sign")

    def near(key: tuple, c: tuple, ids: tuple, comp: tuple, s: tuple) -> list[tuple]:
        found = {x for i, late in agreeing(_matrix(s), agree, np.array(comp), np.array(c)) for x in (i, *late.tolist())}
        return [(*key, c[x], ids[x], comp[x], s[x]) for x in sorted(found)]

    def links(_: tuple, c: tuple, ids: tuple, comp: tuple, s: tuple, h: tuple) -> list[tuple]:
        return [(max(p), min(p)) for p in linking_pairs(ids, h, _matrix(s), agree, comp, np.array(c), similarity)]

    close = _by_block(blocks, ["c", "node", "comp", "sign"], near, {"cell": "long", "i": "int", "j": "int", "c": "int", "node": "long", "comp": "long", "sign": "binary"})
    close = materialize(close, "near-blocks")
    more = _by_block(close.join(_only(text, close), "node"), ["c", "node", "comp", "sign", "h"], links, LINK)
    more = materialize(more, "near-links")
    if more.isEmpty():
        return roots
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    across = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    joined = materialize(components(across).select(F.col("node").alias("root"), F.col("root").alias("first")), "near-roots")
    known = roots.join(joined, "root", "left").select("node", F.coalesce("first", "root").alias("root"))
    alone = joined.select(F.col("root").alias("node"), F.col("first").alias("root")).join(roots, "node", "left_anti")
    return known.unionByName(alone)


def keep_one(docs: DataFrame, radius: int = 3, shingle: int = 3, similarity: float = 0.8, miss: float = 0.001) -> DataFrame:
    """The rows of ``docs``, with their columns, less all but one of those alike.

    Texts of the same words (A-Z as a-z) are one text, that of the least doc_id. Of these, texts
    whose SimHashes are linked within ``radius`` bits are candidates, and so are texts with a
    common band of MinHashes: at ``similarity`` SimHashes often differ in more bits than any radius
    that can be searched; a pair at ``similarity`` has no common band with probability ``miss`` at
    most, taking the minima as independent. Candidates are linked if the Jaccard similarity of their
    own five-word shingles (runs of letters and digits, in lower case) is ``similarity`` or more,
    whichever of them is the first (see :func:`similar_groups`); the least doc_id of what the links
    reach stays.

    Null, empty and wordless texts are copies of each other; texts of under five words have no
    shingle and are copies only if equal. Of rows that share a doc_id one counts, the one of the
    least text hash; rows without doc_id stay; an empty table gives an empty result.
    """
    d, n, again = fresh(docs, "__gone"), fresh(docs, "__nth"), fresh(docs, "__again")
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(again)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    twice = materialize(twice.select(again), "near-repeated")
    if not twice.isEmpty():  # one row of each of these; the others, and their texts, stay where they are
        few = F.broadcast(twice) if twice.count() <= BROADCAST_IDS else twice
        rest = [c for c in docs.columns if c != "doc_id"]
        least = F.struct(F.xxhash64("text"), F.xxhash64(*rest))
        one = docs.join(few, F.col("doc_id") == F.col(again), "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*rest), least).alias(n)).select("doc_id", f"{n}.*")
        docs = docs.join(few, F.col("doc_id") == F.col(again), "left_anti").unionByName(one.select(*docs.columns))
    own = docs.where("doc_id is not null").select("doc_id", "text")
    bands = bands_needed(similarity, miss, BAND)
    rows = materialize(marked(own, bands, shingle), "near-marks")
    same = rows.groupBy("same").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    same = materialize(same, "near-texts")
    copies = join_per_key(rows.select("doc_id", "same"), same.where("n > 1"), "same").where("doc_id <> node").select(F.col("doc_id").alias(d))
    copies = materialize(copies, "copies")
    texts = rows.where(F.col("sign").isNotNull()).join(copies, F.col("doc_id") == F.col(d), "left_anti").withColumnRenamed("doc_id", "node")

    values = materialize(texts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "fingerprint-values")
    stars = find_links(values, radius).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), "b"))).alias("e"))
    near = values.where("n > 1").select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).unionByName(stars.select("e.a", "e.b"))
    near = near.distinct().withColumnRenamed("a", "fingerprint")
    by_bits = texts.select("node", "fingerprint").join(near, "fingerprint").select(F.xxhash64(F.lit(-1), "b").alias("cell"), "node")
    by_band = texts.select("node", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("cell"), "node")
    cells = materialize(by_band.unionByName(by_bits), "near-cells")
    groups = similar_groups(own, cells, texts.select("node", "sign"), similarity, miss)
    gone = groups.where("node <> root").select(F.col("node").alias(d)).unionByName(copies)
    return docs.join(materialize(gone, "copies"), F.col("doc_id") == F.col(d), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
