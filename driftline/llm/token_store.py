"""Token ids in a content-addressed binary store.

Writing: every text is encoded, a rolling hash over the ids cuts the stream
where the content says so, and each chunk is known by its digest. The first
document (in ascending order) that holds a chunk stores it; the others hold its
digest alone. A document's recipe lists its chunks in order and has their Merkle
root; a part's manifest has the root over its documents.

File format, a folder:
    recipes/part=P/state=S/*.parquet  ascending by doc_id; P ascends with doc_id. S is 0
        for documents that hold all their chunks, 1 if later documents refer to
        some of them, 2 for documents that lack chunks of earlier ones.
        doc_id, rid, start, n_tokens, root, chunks: array of
        (digest, n, ids): ids are little-endian unsigned integers of WIDTH bytes,
        null where an earlier document stores the chunk; ``shared`` tells that
        a later one refers to it.
    manifest/*.parquet        part, docs, tokens, start, root.

Reading first compares the recipes with the manifest, part by part (documents,
tokens, start, root), and finds each document starting where the one before ends;
then it checks every chunk's digest, every recipe's root and count. It fails on a
difference, and on a store without a manifest.

Defined cases: a null text is an empty one and holds the end id alone; repeated
rows and equal ids are documents of their own, in the order of their place in
the input (rid); a null doc_id sorts first; an empty table gives an empty store;
other input columns are not stored.

Shuffles: digests and places of all chunks (about 40 bytes for each 256 ids),
the ids once to bring them into order (a document's part is known when it is
encoded, from cuts by text bytes), and on reading only what documents with
foreign chunks need. Chunks are counted by partial aggregation, and those of very many
places meet them by broadcast (``join_by_size``).
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, new_path, stored
from .arrowtext import given_back, lists_of, sums, texts_of
from .skew import join_by_size
from .tokens import encoded_slices

WINDOW, MASK, LEAST, MOST = 16, 255, 64, 1024
PART_BYTES = (8 << 20, 128 << 20)
SAMPLES = 8
#: Rows of a batch that goes back to the JVM.
BATCH_ROWS = 256
GEAR = np.uint32(0x9E3779B1)
STAGED = "part int, doc_id long, rid long, n long, ids binary, lengths array<int>, digests binary"
CHUNKS = "array<struct<digest:binary,n:int,shared:boolean,ids:binary>>"
RECIPES = f"part int, state int, doc_id long, rid long, start long, n_tokens long, root binary, chunks {CHUNKS}"
DIGEST = 16


def digest(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node is lifted as it is. No leaves: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        pairs = [digest(b"\x01" + a + b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = pairs + leaves[len(leaves) & ~1 :]
    return leaves[0]


def rolling(ids: np.ndarray) -> np.ndarray:
    """For each position a hash of the WINDOW ids that end there, by doubling: h(2k) = h(k) + M^k * h(k) shifted by k."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    factor, k = GEAR, 1
    while k < WINDOW:
        shifted = h[:-k] * factor
        h = h.copy()
        h[k:] += shifted
        factor, k = np.uint32((int(factor) * int(factor)) & 0xFFFFFFFF), 2 * k
    return h ^ (h >> np.uint32(16))


def chunk_lengths(marks: np.ndarray, n: int) -> list[int]:
    """Lengths of chunks: cut at marks (ends of chunks) at least LEAST apart, and after MOST ids in any case."""
    out, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            out.append(MOST)
            last += MOST
        if m - last >= LEAST or m == n and m > last:
            out.append(m - last)
            last = m
    return out


def _encode(path: str, end_id: int, width: int, parts: Parts):
    kind = np.dtype(f"<u{width}")

    def task(batches):
        for batch in batches:
            texts, doc_ids, rids = texts_of(batch.column(0)), batch.column(1).cast(pa.int64()), batch.column(2)
            part = pa.array(parts.of(doc_ids.fill_null(Parts.LEAST_ID).to_numpy(zero_copy_only=False), rids.to_numpy(zero_copy_only=False)), pa.int32())
            for lo, hi, flat, ends in encoded_slices(path, texts):
                flat = np.insert(flat, ends[1:], end_id).astype(kind)
                ends = ends + np.arange(len(ends))
                marks = np.flatnonzero((rolling(flat) & np.uint32(MASK)) == 0) + 1
                at = np.searchsorted(marks, ends, side="right")
                marks = marks[at[0] :]
                at = at - at[0]
                data = pa.py_buffer(flat.tobytes())
                view, lengths, digests = memoryview(data), [], []
                for a, b, own in zip(ends[:-1].tolist(), ends[1:].tolist(), np.split(marks, at[1:-1])):
                    lengths.append(chunk_lengths(own - a, b - a))
                    edges = list(accumulate(lengths[-1], initial=a))
                    digests.append(b"".join([digest(view[x * width : y * width]) for x, y in pairwise(edges)]))
                n = np.diff(ends)
                yield pa.RecordBatch.from_arrays(
                    [part.slice(lo, hi - lo), doc_ids.slice(lo, hi - lo), rids.slice(lo, hi - lo), pa.array(n, pa.int64()), _binaries(n * width, data), pa.array(lengths, pa.list_(pa.int32())), pa.array(digests, pa.binary())],
                    ["part", "doc_id", "rid", "n", "ids", "lengths", "digests"],
                )
        given_back()

    return task


class Parts:
    """Cuts of the order (doc_id, rid), null ids first, into parts of about equal numbers of text bytes."""

    LEAST_ID = -(1 << 63)

    def __init__(self, rows: list[tuple[int | None, int]], parts: int):
        rows = sorted((self.LEAST_ID if d is None else d, r) for d, r in rows)
        cuts = [rows[len(rows) * k // parts] for k in range(1, parts)] if rows else []
        self.ids = np.array([d for d, _ in cuts], np.int64)
        self.rids = np.array([r for _, r in cuts], np.int64)

    def of(self, doc_ids: np.ndarray, rids: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.ids, doc_ids, "left"), np.searchsorted(self.ids, doc_ids, "right")
        out = lo.copy()
        for k in np.flatnonzero(lo < hi):
            out[k] = lo[k] + np.searchsorted(self.rids[lo[k] : hi[k]], rids[k], "right")
        return out


def _binaries(lengths: np.ndarray, data: pa.Buffer, valid: np.ndarray | None = None) -> pa.Array:
    """A binary array whose values lie one after another in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(lengths), [bits, pa.py_buffer(offsets), data])


def _data(values: pa.Array) -> pa.Buffer:
    """The bytes of a binary array without nulls, one value after another."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4)
    whole = values.buffers()[2]
    return pa.py_buffer(b"") if whole is None else whole.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def _recipes(starts: dict[int, int], width: int):
    """Of one part: its documents in order, each chunk with its ids unless an earlier document stores it."""

    def group(key, staged: pa.Table, places: pa.Table) -> pa.Table:
        part = key[0].as_py()
        ids = staged["doc_id"].fill_null(Parts.LEAST_ID).to_numpy()
        docs = staged.take(pa.array(np.lexsort((staged["rid"].to_numpy(), ids, staged["doc_id"].is_valid().to_numpy())))).combine_chunks()
        n, rids = docs["n"].to_numpy(), docs["rid"].to_numpy()
        lengths, edges = lists_of(docs["lengths"].chunk(0))
        lengths = lengths.to_numpy(zero_copy_only=False)
        names = _binaries(np.full(len(lengths), DIGEST), _data(docs["digests"].chunk(0)))
        by_rid = np.argsort(rids)
        at = edges[by_rid[np.searchsorted(rids, places["in_rid"].to_numpy(), sorter=by_rid)]] + places["pos"].to_numpy()
        own = places["own"].to_numpy().astype(bool)
        here, shared = np.ones(len(lengths), bool), np.zeros(len(lengths), bool)
        here[at[~own]], shared[at[own]] = False, True
        leaves = names.to_pylist()
        roots = [merkle(leaves[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        chunk = pa.StructArray.from_arrays(
            [names, pa.array(lengths, pa.int32()), pa.array(shared), _binaries(lengths.astype(np.int64) * width, _data(docs["ids"].chunk(0)), here)], fields=list(ARROW.field("chunks").type.value_type)
        )
        chunks = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), chunk)
        start = starts[part] + np.cumsum(n) - n
        state = np.where(sums(~here, edges) > 0, 2, np.where(sums(shared, edges) > 0, 1, 0))
        made = pa.Table.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(state, pa.int32()), docs["doc_id"], docs["rid"], pa.array(start), docs["n"], pa.array(roots, pa.binary()), chunks], schema=ARROW)
        return pa.Table.from_batches(made.to_batches(BATCH_ROWS), ARROW)

    return group


ARROW = pa.schema(
    [("part", pa.int32()), ("state", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]
    + [("chunks", pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("shared", pa.bool_()), ("ids", pa.binary())])))]
)


def _cuts(rows: DataFrame, part_bytes: tuple[int, int]) -> Parts:
    """Cuts from a sample by size: SAMPLES rows for each part, so what comes to the driver follows the number of parts."""
    sizes = rows.select("doc_id", "rid", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 64).alias("size"))
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    n_parts = max(1, -(-whole // min(max(whole // 1000, part_bytes[0]), part_bytes[1])))
    if n_parts == 1:
        return Parts([], 1)
    draw = F.pmod(F.xxhash64("doc_id", "rid"), F.lit(1 << 30)) / float(1 << 30)
    picked = sizes.filter(draw < F.col("size") * (SAMPLES * n_parts / whole)).select("doc_id", "rid").toArrow()
    return Parts(list(zip(picked["doc_id"].to_pylist(), picked["rid"].to_pylist())), n_parts)


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, text: str = "text", key: str = "doc_id", width: int = 2, part_bytes: tuple[int, int] = PART_BYTES) -> None:
    """Encode ``df`` and write the store to ``path``. ``width``: bytes of an id (2 for vocabularies up to 65,536).

    A part holds a thousandth of all text, but at least and at most about ``part_bytes``: one part is one task's group.
    """
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"))
    at = new_path(spark, "encoded")
    staged = stored(rows.mapInArrow(_encode(tokenizer, end_id, width, _cuts(rows, part_bytes)), STAGED), "encoded", at)
    starts, total = {}, 0
    for r in sorted(staged.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts[r["part"]] = total
        total += r["n"]
    # of digests that stand in several places, the first place owns the chunk
    places = staged.select("part", "doc_id", "rid", "digests", F.posexplode("lengths").alias("pos", "length")).select(
        "part", "doc_id", "rid", "pos", F.expr(f"substring(digests, {DIGEST} * pos + 1, {DIGEST})").alias("digest")
    )
    owners = places.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "rid", "pos")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    owners = stored(owners.select("digest", "times", F.col("first.rid").alias("owner"), F.col("first.pos").alias("owner_pos")), "owners")
    told = join_by_size(places, owners, "digest", "times").select(F.col("part").alias("in_part"), F.col("rid").alias("in_rid"), "pos", ((F.col("rid") == F.col("owner")) & (F.col("pos") == F.col("owner_pos"))).alias("own"))
    recipes = staged.groupBy("part").cogroup(told.groupBy("in_part")).applyInArrow(_recipes(starts, width), RECIPES)
    recipes.sortWithinPartitions("part", "state", "start").write.option("compression", "zstd").partitionBy("part", "state").parquet(f"{path}/recipes")
    drop(spark, at)
    written = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", "start", "n_tokens", "root")
    _summed(written).write.parquet(f"{path}/manifest")


MANIFEST = "part int, docs long, tokens long, start long, root binary"


def _summed(recipes: DataFrame) -> DataFrame:
    """The manifest of these recipes; its tokens are null where a part's documents do not follow each other."""
    leaves = F.array_sort(F.collect_list(F.struct("start", "n_tokens", "root")))
    parts = recipes.groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("start").alias("start"), leaves.alias("leaves"))

    def rooted(batches):
        for batch in batches:
            tokens, roots = [], []
            for total, leaves in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                whole = all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(leaves, leaves[1:]))
                tokens.append(total if whole else None)
                roots.append(merkle([x["root"] for x in leaves]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(tokens, pa.int64()), batch.column(3), pa.array(roots, pa.binary())], ["part", "docs", "tokens", "start", "root"])

    return parts.mapInArrow(rooted, MANIFEST)


def _check_manifest(recipes: DataFrame, path: str) -> None:
    spark = recipes.sparkSession
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        raise ValueError(f"token store: the manifest is missing or damaged in {path}") from e
    names = ("docs", "tokens", "start", "root")
    found = _summed(recipes).select("part", F.struct(*names).alias("found"))
    told = manifest.select("part", F.struct(*names).alias("told"))
    bad = told.join(found, "part", "full").filter(~F.col("told").eqNullSafe(F.col("found")) | F.col("found.tokens").isNull())
    parts = sorted(r["part"] for r in bad.select("part").limit(10).collect())
    if parts:
        raise ValueError(f"token store: parts {parts} differ from the manifest, or are damaged")


READ = "part int, doc_id long, rid long, start long, n_tokens long, root binary, ids binary"
DIGESTED = "part int, doc_id long, rid long, start long, n_tokens long, root binary, ids_crc32 long"


def _rebuilt(docs: pa.Table, bodies: list[bytes], width: int, as_crc: bool, made: pa.Schema) -> pa.Table:
    """The documents' ids (or their checksums) from their chunks' bytes, after every digest, root and count is found right."""
    chunks, edges = lists_of(docs["chunks"].combine_chunks())
    names, edges = chunks.field("digest").to_pylist(), edges.tolist()
    n = docs["n_tokens"].to_numpy()
    size = np.concatenate([[0], np.cumsum(np.fromiter(map(len, bodies), np.int64, len(bodies)))])[edges]
    whole = np.diff(size) == n * width
    good = [digest(x) == y for x, y in zip(bodies, names)]
    for k, (a, b, root) in enumerate(zip(edges[:-1], edges[1:], docs["root"].to_pylist())):
        if not whole[k] or not all(good[a:b]) or merkle(names[a:b]) != root:
            raise ValueError(f"token store: document {docs['doc_id'][k].as_py()} is damaged")
    data = memoryview(np.frombuffer(b"".join(bodies), f"<u{width}").astype("<u4").tobytes())
    ends = (size // width * 4).tolist()
    own = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
    last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if as_crc else pa.array([bytes(x) for x in own], pa.binary())
    return pa.Table.from_arrays([*(docs[name] for name in made.names[:-1]), last], schema=made)


def read_store(spark: SparkSession, path: str, width: int = 2, as_crc: bool = False) -> DataFrame:
    """Every document, rebuilt from the files and checked: ids as little-endian unsigned 32-bit integers, or with ``as_crc`` their crc32."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    _check_manifest(recipes.select("part", "start", "n_tokens", "root"), path)
    last = ("ids_crc32", pa.int64()) if as_crc else ("ids", pa.binary())
    made = pa.schema([f for f in ARROW if f.name not in ("state", "chunks")] + [pa.field(*last)])

    def bodies_of(docs: pa.Table) -> list[bytes | None]:
        return lists_of(docs["chunks"].combine_chunks())[0].field("ids").to_pylist()

    def whole(batches):
        for batch in batches:
            docs = pa.Table.from_batches([batch])
            yield from _rebuilt(docs, bodies_of(docs), width, as_crc, made).to_batches()

    def filled(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        bodies, edges = bodies_of(docs), lists_of(docs["chunks"].combine_chunks())[1]
        first = dict(zip(docs["rid"].to_pylist(), edges[:-1].tolist()))
        for rid, pos, ids in zip(found["in_rid"].to_pylist(), found["pos"].to_pylist(), found["ids"].to_pylist()):
            bodies[first[rid] + pos] = ids
        return _rebuilt(docs, bodies, width, as_crc, made)

    schema = DIGESTED if as_crc else READ
    complete = recipes.filter("state < 2").mapInArrow(whole, schema)
    partial = recipes.filter("state = 2")
    wanted = partial.select("part", "rid", F.posexplode("chunks").alias("pos", "c")).filter("c.ids is null").select(F.col("part").alias("in_part"), F.col("rid").alias("in_rid"), "pos", F.col("c.digest").alias("digest"))
    stock = recipes.filter("state > 0").select(F.explode(F.filter("chunks", lambda c: c["shared"])).alias("c")).select(F.col("c.digest").alias("digest"), F.col("c.ids").alias("ids"))
    found = wanted.join(stock, "digest").select("in_part", "in_rid", "pos", "ids")
    rest = partial.groupBy("part").cogroup(found.groupBy("in_part")).applyInArrow(filled, schema)
    return complete.unionByName(rest)
