"""Near-duplicate documents by MinHash, banding, signature verification and star contraction.

``near_duplicates`` links documents whose word-shingle sets have a Jaccard similarity of at least
``threshold_percent`` / 100 and labels each document with its connected component.

1. One scan hashes each document's shingles and takes ``BANDS * ROWS`` minima under universal hash functions
   ``(a * x + b) mod 2**64``, a odd, of which the high 32 bits count. Documents with the same shingle set (compared by
   a 128-bit digest of the whole sorted set) share a representative, so copies cost nothing afterwards.
2. Representatives with the same band key form a bucket. Each member is compared with the bucket's smallest
   member only: a bucket of n documents gives n - 1 candidates.
3. Candidates that the signatures rule out go (``SLACK`` below the threshold, over four standard deviations);
   the rest are confirmed on their full shingle sets.
4. Components come from alternating large-star and small-star steps.
5. Buckets whose members still lie in different components are looked at again, so that a link between two members
   that are both unlike the smallest is not lost: small buckets by all pairs of different components, larger ones
   in pairs of blocks of about ``BLOCK_BYTES``, compared and confirmed inside a task, which emits a link for each two
   components that it joins. Step 4 then runs again with these links.

Words enter by digests that are no polynomial, so equal shingle hashes mean equal shingles but for chance (2**-64 a pair). A pair
at similarity s shares no band with probability (1 - s**5)**25: 4e-7 at 0.85, 5e-5 at 0.8; that is the share of links at the
threshold itself that banding alone can lose, and links through other members make up for most of them.

Null and empty texts, and texts of white space, have an empty set: they are linked with nothing and form
components of their own. Repeated rows are one document for each distinct text; texts of one doc_id that differ are
documents of their own under that id. Rows without doc_id take part; a component of such rows alone has a null component_id
and all its rows are ``kept`` (``verdicts`` tells them apart). An empty table gives an empty result. Only ``id_col`` and
``text_col`` are read; other columns may have any name. Intermediate tables are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .runtime import Scratch, materialise

BANDS, ROWS = 25, 5
SLACK = 0.15
SMALL, BLOCK_BYTES = 16, 4_000_000

_SIGS = "doc_id long, text_key long, n_shingles long, set_lo long, set_hi long, sig binary, keys array<long>"
_SETS = "doc_id long, shingles binary"


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, a slice of texts at a time."""
    for lo, hi in scan.slices(texts):
        raw, at = scan.buffers(texts.slice(lo, hi - lo))
        raw = scan.LOWER[raw]
        starts, ends, first = scan.ranges(raw, at)
        words = scan.word_digests(raw, starts, ends)
        hashes, bounds = scan.shingle_hashes(words, first, width)
        yield [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1024) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(items), step):
        x = a[:, None] * items[None, k : k + step]
        x += b[:, None]
        np.minimum(out, (x.min(axis=1) >> np.uint64(32)).astype(np.uint32), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    keys = np.arange(len(sig) // rows, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(rows):
        keys = scan.mix(keys * np.uint64(0x9FB21C651E98DF25) + sig[k::rows].astype(np.uint64))
    return keys.view(np.int64)


def _signatures(width: int, bands: int, rows: int):
    def run(batches):
        a, b = coefficients(bands * rows)
        for batch in batches:
            ids, text_keys = batch.column(0), batch.column(1)
            done = 0
            for sets in shingle_sets(batch.column(2), width):
                out = {k: [] for k in ("n", "lo", "hi", "sig", "keys")}
                for items in sets:
                    digest = np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64)
                    sig = signature(items, a, b) if len(items) else None
                    out["n"].append(len(items))
                    out["lo"].append(int(digest[0]))
                    out["hi"].append(int(digest[1]))
                    out["sig"].append(sig.tobytes() if sig is not None else None)
                    out["keys"].append(band_keys(sig, rows) if sig is not None else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(done, len(sets)), text_keys.slice(done, len(sets)), pa.array(out["n"], pa.int64()), pa.array(out["lo"], pa.int64()), pa.array(out["hi"], pa.int64()), pa.array(out["sig"], pa.binary()), pa.array(out["keys"], pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "set_lo", "set_hi", "sig", "keys"],
                )
                done += len(sets)

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            done = 0
            for sets in shingle_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])
                done += len(sets)

    return run


def _similar_sigs(least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
                keep = pa.array((left == right).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _similar_sets(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return run


def _blocks(least: float, percent: int, rows: int):
    """Links between two blocks of a bucket whose ends lie in different components, confirmed on full sets.

    A pair is looked at in the first band that it shares. Once a link joins two components within the block pair, no
    other pair of these two is needed.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint32).reshape(group.num_rows, -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        size = np.array([len(x) for x in sets])
        ids, comp, block = (group.column(c).to_numpy() for c in ("doc_id", "comp", "block"))
        band = int(np.flatnonzero(band_keys(sigs[0], rows) == group.column("key")[0].as_py())[0])
        a, b = group.column("pa")[0].as_py(), group.column("pb")[0].as_py()
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        comp, u, v = comp.copy(), [], []
        for i in left:
            other = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
            if a == b:
                other = other[other > i]
            same = sigs[other] == sigs[i]
            other = other[(same.mean(axis=1) >= least) & ~same[:, : band * rows].reshape(len(other), band, rows).all(axis=2).any(axis=1)]
            if not len(other):
                continue
            mine, items = sets[i], np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(mine, items), len(mine) - 1)
            both = np.add.reduceat((mine[at] == items).astype(np.int64), np.concatenate([[0], np.cumsum(size[other])[:-1]]))
            for j in other[100 * both >= percent * (size[other] + size[i] - both)]:
                if comp[j] != comp[i]:
                    u.append(max(ids[i], ids[j]))
                    v.append(min(ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of each node of ``edges`` (u, v): alternating large-star and small-star until nothing changes.

    A step aggregates each node's smallest neighbour (partially before the shuffle) and joins it back, a join whose
    hot keys can be split. No node is listed with all its neighbours anywhere.
    """
    scratch = scratch or Scratch()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.min(F.xxhash64("v", "u"))).first()

    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links")
    seen = mark(now)
    while seen[0]:
        then = scratch.keep(star(star(now, True), False), "stars")
        scratch.drop(now)
        now, was, seen = then, seen, mark(then)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold_percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, node (names the component, also without ids), component_id, kept of each row."""
    scratch = Scratch()
    least = threshold_percent / 100 - SLACK
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    sigs = scratch.keep(source.mapInArrow(_signatures(shingle_words, bands, rows), _SIGS), "signatures")
    group = ["set_lo", "set_hi"]
    # copies of one set have one signature: any will do
    own = sigs.where("n_shingles > 0").groupBy(*group).agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    own = scratch.keep(own, "representatives")
    # a document's id names its set, unless it has several or none: then a hash of the set does
    odd = scratch.keep(own.groupBy("rep").count().where("count > 1 or rep is null").select(F.col("rep").alias("odd_rep")), "odd-ids")
    plain = odd.isEmpty()
    if plain:
        own = own.withColumn("node", F.col("rep"))
    else:
        own = own.join(odd, F.col("rep").eqNullSafe(F.col("odd_rep")), "left").withColumn("node", F.when(F.col("rep").isNull() | F.col("odd_rep").isNotNull(), F.xxhash64(*group)).otherwise(F.col("rep"))).drop("odd_rep")
        own = scratch.keep(own, "named")
    entries = own.select(F.col("node").alias("doc_id"), F.explode("keys").alias("key"))
    full = entries.groupBy("key").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("top"), F.count("*").alias("size")).where("center < top")
    buckets = scratch.keep(entries.join(full.drop("top"), "key"), "buckets")
    members = buckets.select("doc_id").distinct()
    small_sigs = scratch.keep(own.withColumn("doc_id", F.col("node")).join(members, "doc_id", "left_semi").select("doc_id", "rep", *group, "n_shingles", "sig"), "member-signatures")
    if plain:
        texts = source.join(members.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    else:
        one = sigs.join(small_sigs.select(F.col("doc_id").alias("node"), *group), group).groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("at")).select("node", F.col("at.doc_id").alias("_id"), F.col("at.text_key").alias("_key"))
        texts = source.join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    sets = scratch.keep(texts.mapInArrow(_full_sets(shingle_words), _SETS), "sets")

    def sided(pairs: DataFrame, what: DataFrame, value: str) -> DataFrame:
        left = what.select(F.col("doc_id").alias("u"), F.col(value).alias("x"))
        right = what.select(F.col("doc_id").alias("v"), F.col(value).alias("y"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = scratch.keep(sided(pairs, small_sigs, "sig").mapInArrow(_similar_sigs(least), "u long, v long"), "candidates")
        out = scratch.keep(sided(pairs, sets, "shingles").mapInArrow(_similar_sets(threshold_percent), "u long, v long"), "confirmed")
        scratch.drop(pairs)
        return out

    links = confirmed(buckets.where("doc_id != center").select(F.col("doc_id").alias("u"), F.col("center").alias("v")).distinct())
    labels = components(links, scratch)

    seen = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "size", F.coalesce("root", "doc_id").alias("comp"))
    open_keys = seen.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    left_over = scratch.keep(seen.join(open_keys, "key", "left_semi"), "open-buckets")
    few = left_over.where(F.col("size") <= SMALL)
    a, b = few.alias("a"), few.alias("b")
    pairs = (
        a.join(b, "key").where("a.doc_id > b.doc_id and a.comp != b.comp").select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"))
        .distinct().join(buckets.select(F.col("doc_id").alias("u"), F.col("center").alias("v")).distinct(), ["u", "v"], "left_anti")
    )
    extra = [confirmed(pairs)]
    many = left_over.where(F.col("size") > SMALL)
    if not many.isEmpty():
        # blocks are dealt by ids and sizes alone; signatures and sets are fetched by document afterwards, so that no join by a hot key moves them
        thin = many.join(small_sigs.select("doc_id", (F.col("n_shingles") * 8 + F.length("sig")).alias("bytes")), "doc_id")
        blocks = thin.groupBy("key").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("blocks"))
        dealt = thin.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", F.least("block", "other").alias("pa"), F.greatest("block", "other").alias("pb"), "block", "doc_id", "comp")
        dealt = dealt.join(small_sigs.select("doc_id", "sig"), "doc_id").join(sets, "doc_id").select("key", "pa", "pb", "block", "doc_id", "comp", "sig", "shingles")
        extra.append(scratch.keep(dealt.groupBy("key", "pa", "pb").applyInArrow(_blocks(least, threshold_percent, rows), "u long, v long"), "block-links"))
    more = extra[0] if len(extra) == 1 else extra[0].unionByName(extra[1])
    if not more.isEmpty():
        labels = components(links.unionByName(more), scratch)

    named = own.select("node", "rep", *group).join(labels.select("node", "root"), "node", "left").select("rep", *group, F.coalesce("root", "node").alias("node"))
    if plain:
        named = named.select(*group, "node", F.col("node").alias("component_id"))
    else:
        named = named.join(named.groupBy("node").agg(F.min("rep").alias("component_id")), "node").select(*group, "node", "component_id")
    out = sigs.select("doc_id", "text_key", "n_shingles", *group).join(named, group, "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    result = materialise(out.select("doc_id", "text_key", "n_shingles", "node", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "components")
    scratch.clear()
    return result


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document; see the module's text and the options of ``verdicts``."""
    return verdicts(docs, id_col, text_col, **options).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, of the smallest doc_id; rows without words all stay."""
    found = verdicts(docs, id_col, text_col, **options)
    worded = found.where("n_shingles > 0")
    # rows that share the kept doc_id (repeats, or several texts under one id, or no ids): one of them stays
    shared = materialise(worded.where("kept").groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("lead")).where("n > 1").select("node", "lead"), "shared-ids")
    several = not shared.isEmpty()
    lost = worded.where("not kept")
    if several:
        lost = lost.unionByName(worded.where("kept").join(shared.select("node"), "node", "left_semi"), allowMissingColumns=True)
    lost = lost.select(F.col("doc_id").alias("_nd_id"), F.col("text_key").alias("_nd_key")).distinct()
    text_key = F.xxhash64(F.col(text_col).cast("string"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_nd_id")) & (text_key == F.col("_nd_key"))
    out = docs.join(lost.hint("merge"), same, "left_anti")
    if several:
        leads = shared.select(F.col("lead.doc_id").alias("_nd_id"), F.col("lead.text_key").alias("_nd_key")).distinct()
        one = docs.join(leads.hint("merge"), same).dropDuplicates(["_nd_id", "_nd_key"])
        out = out.unionByName(one.select(*docs.columns))
    return out.select(*docs.columns)
