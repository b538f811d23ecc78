"""MinHash near-dedup with sequential Bayesian verification.

Texts are sets of distinct five-word shingles (lower-cased A-Z). Documents with equal sets (by a 128-bit digest of the
whole sorted set) are one class before anything else. Classes are the nodes that links join, each under a number of its
own, and have `BANDS * ROWS` min-hashes; equal bands make candidates. A pair at the
threshold shares no band with probability (1 - 0.75^5)^40 = 2e-5. Signatures of candidates are then compared in
batches of `BATCH` hashes; a pair goes as soon as the posterior probability (uniform prior on similarity) that it
reaches the threshold is below `MISS`. Survivors are checked exactly, on the full shingle sets of the whole texts.

Buckets of up to `SMALL` documents yield all their pairs. Of a larger one, every `STAR_BANDS`-th band yields a star
on its smallest document, of which a document keeps the `CENTRES` smallest. Afterwards large buckets that hold more
than one component are compared again: members with all members outside their own component (pairs inside one can't
change it), tile by tile, with the same batches and, on the texts themselves, the same exact check. A tile passes on
only links that join two of its components, so it makes fewer rows than it reads, and no link between components is
lost. Members of a bucket's main component meet the others only. Texts travel for documents that a bitmap holds.
Band entries travel packed, one row for each slice of the input and bucket; of more than `SMALL` equal bands in a
slice only the smallest document's goes on. What is broadcast is a bitmap of `2**SIEVE_BITS` bits.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer than five words make one
shingle of the whole sequence; repeated rows are copies of each other; rows that share a doc_id but not a text are
documents of their own; a row without doc_id is linked like others, and a component of such rows only has a null
component_id; empty input, empty output. Arrow batches are bounded by bytes (`common.text_rows`), so an executor's
memory doesn't follow the lengths of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K
from gridloom.llm.common import drop_scratch, keep_one_each, scratch_table, shuffle_width, text_rows
from gridloom.llm.components import FOLD, connected_components

SHINGLE, BANDS, ROWS, BATCH, MISS = 5, 40, 5, 25, 1e-6
THRESHOLD = (75, 100)
SMALL, BLOCK, BLOCK_BYTES, STAR_BANDS, CENTRES, SIEVE_BITS = 24, 1500, 8 << 20, 5, 3, 20
SLICE = 1 << 19
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
FACTORS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=U64) | U64(1)
SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])
SKETCH_DDL = "doc_id long, text_hash long, n_bytes long, n_shingles long, set_a long, set_b long, signature binary"
SET = ["set_a", "set_b", "n_shingles"]


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after another, and where each row's begin."""
    data = K.LOWER[data]
    starts, ends, first = K.spans(data, offs)
    words = K.word_hashes(data, starts, ends)
    counts = np.diff(first)
    # rows of fewer words than a shingle are padded with a value that no word has, at their end
    room = np.where((counts > 0) & (counts < SHINGLE), SHINGLE, counts)
    base = np.concatenate(([0], np.cumsum(room)))
    padded = np.full(base[-1], U64(0x1357))
    row = np.repeat(np.arange(len(counts)), counts)
    padded[base[row] + np.arange(len(words)) - first[row]] = words
    all_grams = K.grams(padded, SHINGLE)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for r, (a, n) in enumerate(zip(base.tolist(), room.tolist(), strict=False)):
        if n:
            seg = np.sort(all_grams[a : a + n - SHINGLE + 1])
            seg = seg[K.group_starts(seg)]
            sizes[r] = len(seg)
            out.append(seg)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[rows with shingles, hashes] of uint32: the least of each hash over a row's shingles."""
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), len(FACTORS)), np.uint32)
    buffer = np.empty_like(sets)
    heads = at[:-1][full]
    for k, f in enumerate(FACTORS):
        np.multiply(sets, f, out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, heads) >> U64(32) if len(full) else 0
    return out


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, text_hash -> sketches."""
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            data, offs = K.buffers(part.column(1))
            sets, at = shingle_sets(data, offs)
            n = np.diff(at)
            digest = np.zeros((len(n), 2), np.int64)
            signs: list[bytes | None] = [None] * len(n)
            for r, s in zip(np.flatnonzero(n).tolist(), signatures(sets, at), strict=True):
                digest[r] = np.frombuffer(hashlib.blake2b(sets[at[r] : at[r + 1]], digest_size=16).digest(), np.int64)
                signs[r] = s.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(offs).astype(np.int64)), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(signs, pa.binary())], schema=SKETCH)


# -- candidates ---------------------------------------------------------------------------------------------------

PACK = "bucket long, docs binary, keys binary, large binary"
PACK_ARROW = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("large", pa.binary())])
PAIRS = "a long, b long, kind int"
PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32())])


def band_keys(signs: np.ndarray) -> np.ndarray:
    """[rows, bands]: a hash of each band, the band's number in the low 6 bits."""
    out = np.empty((len(signs), BANDS), U64)
    for b in range(BANDS):
        x = np.full(len(signs), K.GRAM[63 - b])
        for r in range(ROWS):
            x = K.mix(x + signs[:, b * ROWS + r].astype(U64) * K.GRAM[r])
        out[:, b] = (x & ~U64(63)) | U64(b)
    return out


def star_or_pairs(docs: np.ndarray, keys: np.ndarray, forced: np.ndarray) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Pairs (a, b, star) inside runs of equal keys (keys sorted, docs ascending in a run), and keys of large runs.

    forced: entries of runs that are large elsewhere.
    """
    pairs: set[tuple[int, int, int]] = set()
    large: list[int] = []
    heads = K.group_starts(keys)
    tails = np.append(heads[1:], len(keys))
    elsewhere = np.maximum.reduceat(forced, heads) if len(heads) else forced
    wanted = (tails - heads > 1) | elsewhere
    for a, b, more in zip(heads[wanted].tolist(), tails[wanted].tolist(), elsewhere[wanted].tolist(), strict=True):
        ids = np.unique(docs[a:b]).tolist()
        if more or len(ids) > SMALL:
            key = int(keys[a : a + 1].view(np.int64)[0])
            if (key & 63) % STAR_BANDS == 0:
                pairs.update((ids[0], x, 1) for x in ids[1:])
            large.append(key)
        else:
            pairs.update((x, y, 0) for i, x in enumerate(ids) for y in ids[i + 1 :])
    return sorted(pairs), large


def pack_bands(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Bands of a slice of sketches, by bucket; bucket -1 has what the slice has settled: pairs (a, b), entries (a, key)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4000):
            part = batch.slice(at, 4000)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            signs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(len(ids), -1)
            keys = band_keys(signs).ravel()
            docs = np.repeat(ids, BANDS)
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            heads = K.group_starts(keys)
            sizes = np.diff(np.append(heads, len(keys)))
            big = np.repeat(sizes > SMALL, sizes)
            first = np.zeros(len(keys), bool)
            first[heads] = True
            rows = []
            if big.any():
                stars, large = star_or_pairs(docs[big], keys[big], np.ones(int(big.sum()), bool))
                x = np.array([(a, b) for a, b, _ in stars] or np.zeros((0, 2)), np.int64)
                rows.append({"bucket": -1 - int(ids[0]) % buckets, "docs": x.tobytes(), "keys": np.array(large, np.int64).tobytes(), "large": b""})
            send = first | ~big
            keys, docs, big = keys[send], docs[send], big[send]
            bucket = (keys % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = K.group_starts(bucket[order])
            rows += [{"bucket": int(bucket[order[a]]), "docs": K.narrow(docs[order[a:b]]), "keys": keys[order[a:b]].tobytes(), "large": big[order[a:b]].tobytes()} for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=PACK_ARROW)


def candidates_of(table: pa.Table) -> pa.Table:
    """kind 0: a pair, 1: an edge of a star, 2: the key (in a) of a large bucket."""
    packs = list(zip(*(table.column(k).to_pylist() for k in ("bucket", "docs", "keys", "large")), strict=True))
    if packs[0][0] < 0:
        stars = np.unique(np.concatenate([np.frombuffer(p[1], np.int64).reshape(-1, 2) for p in packs]), axis=0)
        pairs, large = [(a, b, 1) for a, b in stars.tolist()], np.concatenate([np.frombuffer(p[2], np.int64) for p in packs]).tolist()
    else:
        docs, keys = np.concatenate([K.widen(p[1]) for p in packs]), np.concatenate([np.frombuffer(p[2], U64) for p in packs])
        forced = np.concatenate([np.frombuffer(p[3], bool) for p in packs])
        order = np.lexsort((docs, keys))
        pairs, large = star_or_pairs(docs[order], keys[order], forced[order])
    large = sorted(set(large))
    a = [p[0] for p in pairs] + large
    return pa.table({"a": a, "b": [p[1] for p in pairs] + [None] * len(large), "kind": [p[2] for p in pairs] + [2] * len(large)}, schema=PAIRS_ARROW)


# -- verification -------------------------------------------------------------------------------------------------


@cache
def least_agreements() -> tuple[int, ...]:
    """After each batch, the fewest agreeing hashes with which P(similarity >= threshold) is still MISS or more.

    With a uniform prior, m agreements among n give Beta(m + 1, n - m + 1); the integral is a binomial sum:
    P(J >= t) = P(Binomial(n + 1, t) <= m).
    """
    t, out = THRESHOLD[0] / THRESHOLD[1], []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        k = np.arange(n + 2)
        logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 2)))))
        mass = np.exp(logs[n + 1] - logs[k] - logs[n + 1 - k] + k * np.log(t) + (n + 1 - k) * np.log1p(-t))
        out.append(int(np.argmax(np.cumsum(mass) >= MISS)))
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two signature matrices that no batch rules out."""
    alive = np.arange(len(a))
    agree = np.zeros(len(a), np.int64)
    for k, least in enumerate(least_agreements()):
        s = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (a[alive, s] == b[alive, s]).sum(1)
        stay = agree >= least
        alive, agree = alive[stay], agree[stay]
    return alive


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            stay = plausible(matrix(part.column(2)), matrix(part.column(3)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(stay)), part.column(1).take(pa.array(stay))], names=["a", "b"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for batch in batches:
        a, b = [], []
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            (x, xs), (y, ys) = (shingle_sets(*K.buffers(part.column(k))) for k in (2, 3))
            ids = [part.column(k).to_pylist() for k in (0, 1)]
            for i in range(part.num_rows):
                p, q = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                both = np.sort(np.concatenate((p, q)))
                common = int((both[1:] == both[:-1]).sum())
                if common and THRESHOLD[1] * common >= THRESHOLD[0] * (len(both) - common):
                    a.append(ids[0][i])
                    b.append(ids[1][i])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


#: Texts of the nodes (column doc_id) of a table: doc_id, text.
Texts = Callable[[DataFrame], DataFrame]


def verified(pairs: DataFrame, sketches: DataFrame, texts_of: Texts) -> DataFrame:
    """Candidate pairs that hold: pruned by signatures, then confirmed on the texts."""
    signs = sketches.select("doc_id", "signature")
    both = pairs.join(signs.toDF("a", "sign_a"), "a").join(signs.toDF("b", "sign_b"), "b").select("a", "b", "sign_a", "sign_b")
    stay = both.mapInArrow(prune, "a long, b long")
    stay = scratch_table(stay, "plausible", FOLD)
    texts = texts_of(stay.select(F.explode(F.array("a", "b")).alias("doc_id")))
    full = stay.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(linked, "a long, b long")


def forest(table: pa.Table) -> pa.Table:
    """Links that join components in one tile of a large bucket, confirmed on full sets: fewer than it has components."""
    side = np.array(table.column("side").to_pylist())
    ids, label = (np.array(table.column(k).to_pylist(), np.int64) for k in ("doc_id", "component"))
    signs = matrix(table.column("signature").combine_chunks())
    parts = [shingle_sets(*K.buffers(part.column(0))) for batch in table.select(["text"]).combine_chunks().to_batches() for part in K.slices(batch, "text", SLICE)]
    sets, sizes = np.concatenate([x for x, _ in parts]), np.concatenate([np.diff(at) for _, at in parts])
    at = np.concatenate(([0], np.cumsum(sizes)))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    found: list[tuple[int, int]] = []
    for i in left.tolist():
        near = THRESHOLD[1] * np.minimum(sizes[right], sizes[i]) >= THRESHOLD[0] * np.maximum(sizes[right], sizes[i])
        other = right[near & (label[right] != label[i]) & ((ids[right] > ids[i]) | (side[i] != 2))]
        hit = other[plausible(np.broadcast_to(signs[i], (len(other), signs.shape[1])), signs[other])]
        if not len(hit):
            continue
        own, ends = sets[at[i] : at[i + 1]], np.cumsum(sizes[hit])
        theirs = sets[np.arange(ends[-1]) + np.repeat(at[hit] - ends + sizes[hit], sizes[hit])]
        same = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        common = np.add.reduceat(same.astype(np.int64), ends - sizes[hit])
        for j in hit[THRESHOLD[1] * common >= THRESHOLD[0] * (sizes[i] + sizes[hit] - common)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def bitmap_of(slots: DataFrame) -> np.ndarray:
    """Which of 2**SIEVE_BITS slots occur, put together by partial aggregates; its size is fixed, whatever the input."""
    out = np.zeros(1 << SIEVE_BITS, bool)
    spot = F.col("slot") + 1
    for r in slots.groupBy(F.bitmap_bucket_number(spot).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect():
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        at = (r["page"] - 1) * len(bits)
        out[at : at + len(bits)] = bits[: len(out) - at]
    return out


def sieve(keys: DataFrame) -> np.ndarray:
    return bitmap_of(keys.select(F.shiftright("key", 6).bitwiseAND((1 << SIEVE_BITS) - 1).alias("slot")))


def sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows (doc_id, text, text_hash) without most of those that wanted lacks: spares their move, the join that follows is exact."""
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << SIEVE_BITS)).alias("slot")
    bitmap = bitmap_of(wanted.select(slot))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "text", "text_hash"]).filter(pa.array(bitmap[batch.column(3).to_numpy()]))

    return rows.select("doc_id", "text", "text_hash", slot).mapInArrow(held, "doc_id long, text string, text_hash long")


def texts_from(rows: DataFrame, classes: DataFrame, repeated: bool) -> Texts:
    """Texts by the row that stands for a class; repeated: that row may be there more than once."""

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select(F.col("node").alias("doc_id"), "stands").join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "stands.doc_id", "stands.text_hash")
        found = sieved(rows, wanted)
        named = found.join(wanted.toDF("node", "of_id", "of_hash"), found["doc_id"].eqNullSafe(F.col("of_id")) & (found["text_hash"] == F.col("of_hash"))).select(F.col("node").alias("doc_id"), "text")
        return named.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else named

    return texts_of


def sifted(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
    """Entries of sieved keys (key, doc_id, component, n_bytes), or for each slice only the key's least and largest component."""
    for batch in batches:
        ids, comp, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        keys = band_keys(matrix(batch.column(1)))
        hit = np.argwhere(bitmap[((keys >> U64(6)) & U64((1 << SIEVE_BITS) - 1)).astype(np.int64)])
        key, ids, comp = keys[hit[:, 0], hit[:, 1]].view(np.int64), ids[hit[:, 0]], comp[hit[:, 0]]
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(comp), pa.array(size[hit[:, 0]])], names=["key", "doc_id", "component", "n_bytes"])
            continue
        order = np.lexsort((comp, key))
        heads = K.group_starts(key[order])
        tails = np.append(heads[1:], len(key)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(key[order][heads]), pa.array(comp[order][heads]), pa.array(comp[order][tails[: len(heads)]])], names=["key", "lo", "hi"])


def residual_links(large: DataFrame, labels: DataFrame, sketches: DataFrame, texts_of: Texts) -> DataFrame:
    """Links between components inside large buckets, compared tile by tile."""
    named = sketches.join(labels, "doc_id", "left").select("doc_id", "signature", F.coalesce("component", "doc_id").alias("component"), "n_bytes")
    first = sieve(large)
    held = named.mapInArrow(lambda it: sifted(it, first, False), "key long, lo long, hi long")
    mixed = scratch_table(held.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").join(large, "key", "left_semi").select("key"), "mixed", FOLD)
    second = sieve(mixed)
    if not second.any():
        return mixed.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0)
    hits = named.mapInArrow(lambda it: sifted(it, second, True), "key long, doc_id long, component long, n_bytes long")
    entries = scratch_table(hits.join(mixed, "key", "left_semi"), "entries", FOLD)
    shares = entries.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    whole = shares.groupBy("key").agg(F.max(F.struct("n", "component", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    cut = whole.select("key", F.col("main.component").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("many"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("few"))
    # members of the main component have blocks few, few + 1, ...; they meet the blocks before those only
    is_main = F.col("component") == F.col("main")
    block = F.when(is_main, F.col("few") + F.pmod(F.xxhash64("doc_id"), F.col("many"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("few"))).cast("int")
    dealt = entries.join(cut, "key").withColumn("block", block).withColumn("last", F.when(is_main, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))
    others = F.transform(F.sequence(F.lit(0), F.col("last")), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    tiles = dealt.withColumn("tile", F.explode(others)).withColumn("side", F.when(F.col("tile.i") == F.col("tile.j"), 2).when(F.col("block") == F.col("tile.i"), 0).otherwise(1))
    texts = texts_of(entries)
    members = tiles.join(sketches.select("doc_id", "signature"), "doc_id").join(texts, "doc_id").select("key", "tile", "side", "doc_id", "component", "signature", "text")
    return members.groupBy("key", "tile").applyInArrow(forest, "a long, b long").distinct()


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """doc_id, text_hash, n_shingles, class_id, component_id, component (its number; null for the unlinked) and stands
    (doc_id and text_hash of a component's least row) of every row, and whether rows repeat."""
    rows = text_rows(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    sketches = scratch_table(rows.mapInArrow(sketch, SKETCH_DDL), "sketches")
    repeated = bool(sketches.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count())
    # rows without doc_id come last
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("stands")
    grouped = sketches.where("n_shingles > 0").groupBy(*SET).agg(least, F.min("n_bytes").alias("n_bytes"), F.any_value("signature").alias("signature"))
    classes = scratch_table(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    own = classes.select(F.col("node").alias("doc_id"), "n_bytes", "signature")
    texts_of = texts_from(rows, classes, repeated)
    buckets = shuffle_width(docs)
    banded = own.select("doc_id", "signature").mapInArrow(lambda it: pack_bands(it, buckets), PACK).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(candidates_of, PAIRS)
    found = scratch_table(banded, "candidates", 4)
    stars = found.where("kind = 1").groupBy("b").agg(F.slice(F.sort_array(F.collect_set("a")), 1, CENTRES).alias("a")).select(F.explode("a").alias("a"), "b")
    pairs = found.where("kind = 0").select("a", "b").unionByName(stars).distinct()
    links = scratch_table(verified(pairs, own, texts_of), "links", FOLD)
    labels = connected_components(links)
    large = found.where("kind = 2").select(F.col("a").alias("key")).distinct()
    if large.limit(1).count():
        more = scratch_table(residual_links(large, labels, own, texts_of), "links")
        if more.limit(1).count():
            labels = connected_components(links.unionByName(more))
    of_class = classes.select("node", *SET, "stands").join(labels.select(F.col("doc_id").alias("node"), "component"), "node", "left")
    of_class = of_class.select(*SET, "stands", F.coalesce("component", "node").alias("component"))
    first = of_class.groupBy("component").agg(F.min("stands").alias("first"))
    # a table of its own, so that a hot class's rows can be split in the join that follows
    named = scratch_table(of_class.join(first, "component"), "named")
    drop_scratch(found, links, classes)
    out = sketches.select("doc_id", "text_hash", *SET).join(named, SET, "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("stands.doc_id", "doc_id").alias("class_id"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), "component", F.col("first").alias("stands")), repeated


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept."""
    rows, _ = components_of(docs, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "class_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: the least doc_id, then the least hash of the text; rows without shingles stay."""
    rows, repeated = components_of(docs, id_col, text_col)
    stays = F.col("component").isNull() | (F.col("doc_id").eqNullSafe(F.col("stands.doc_id")) & (F.col("text_hash") == F.col("stands.text_hash")))
    keys = rows.where(stays).select("doc_id", F.col("text_hash").alias("key"), F.col("component").isNotNull().alias("once"))
    return keep_one_each(docs, keys, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), id_col, repeated)
