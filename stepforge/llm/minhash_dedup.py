"""MinHash near-duplicates with b-bit signatures.

Method: K minima per shingle set give (1) bands of r full minima, whose equal values make candidates, and (2) a b-bit
signature (the low bits of the mixed minima, packed into bit planes). A candidate goes on only if the
collision-corrected similarity, (p - 2^-b) / (1 - 2^-b) for the share p of equal b-bit values, is within MARGIN of
the threshold; survivors are confirmed on full shingle sets. No pair list of a group is made: documents with equal
sets are one class from the start; each bucket's members are compared with its leader, the member that shares most bands;
only what is then still apart in a bucket (another component than the bucket's largest) is compared with the bucket's
other members, in blocks that return no more than the links between components; a bucket too large for one block is dealt
over several, in which each of the one meets each of the other.
A pair of linked documents is missed only if no band agrees (at similarity 0.8: (1 - 0.8^4)^32 = 5e-8); the estimate only
chooses which pairs with a leader are confirmed early, and one that it passes over is compared in the late blocks.

Defined cases: null, empty or blank text has an empty set, linked with nothing; fewer than n words are one shingle, the
whole sequence; long texts are hashed in segments, whole; null ids keep component null and kept true and link with nothing;
ids are whole at any size; rows repeated under one id are one node; of several texts under one id one decides what it links
with; ties have no effect; an empty table gives no rows; extra columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from stepforge.llm.components import connected_components, hot_join
from stepforge.llm.hashing import batches_by_bytes, mix, shingle_sets
from stepforge.llm.storage import bounded_batches, bounded_broadcast, bounded_reads, discard, map_frames, materialize

BANDS, ROWS, BITS = 32, 4, 2
K = BANDS * ROWS
MARGIN = 0.21
_SUB = 1 << 16
#: Shingles of a block of late comparisons: strays and members.
STRAY_SHINGLES, MEMBER_SHINGLES = 1 << 17, 1 << 19


def _coefficients(seed: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, K + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) | np.uint64(1)
    return a, mix(a)


def minima(sets: np.ndarray, bounds: np.ndarray, seed: int = 7) -> np.ndarray:
    """K minima of each non-empty set: rows in the order of the sets with members."""
    a, b = _coefficients(seed)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    out = np.full((len(full), K), np.iinfo(np.uint64).max, np.uint64)
    if not len(full):
        return out
    starts = bounds[:-1][full]
    for lo in range(0, len(sets), _SUB):
        piece = sets[lo : lo + _SUB]
        first = int(np.searchsorted(starts, lo, "right")) - 1
        last = int(np.searchsorted(starts, lo + len(piece), "left"))
        cut = np.maximum(starts[first:last] - lo, 0)
        for k in range(K):
            np.minimum(out[first:last, k], np.minimum.reduceat(piece * a[k] + b[k], cut), out=out[first:last, k])
    return out


def signature_rows(texts: list, n: int) -> dict:
    """Columns n_shingles, d1, d2 (digest of the set), bands (band keys) and planes (packed b-bit signature)."""
    cols: dict = {"n_shingles": [], "d1": [], "d2": [], "bands": [], "planes": []}
    for lo, hi in batches_by_bytes(texts):
        sets, bounds = shingle_sets(texts[lo:hi], n)
        count = np.diff(bounds)
        full = np.flatnonzero(count)
        m = minima(sets, bounds)
        d1, d2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
        bands, planes = [[]] * (hi - lo), [[]] * (hi - lo)
        if len(full):
            d1[full], d2[full] = digests(sets, bounds[:-1][full])
            key = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            grouped = m.reshape(len(full), BANDS, ROWS)
            for r in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
            low = mix(m)
            packed = []
            for bit in range(BITS):
                on = ((low >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
                packed.append(np.packbits(on, axis=1).view(np.int64))
            sig = np.concatenate(packed, axis=1)
            kk = key.view(np.int64)
            for i, f in enumerate(full.tolist()):
                bands[f], planes[f] = kk[i], sig[i]
        for name, v in (("n_shingles", count.tolist()), ("d1", d1.view(np.int64).tolist()), ("d2", d2.view(np.int64).tolist()), ("bands", bands), ("planes", planes)):
            cols[name].extend(v)
    return cols


def signatures(docs: DataFrame, n: int) -> DataFrame:
    def sign(frames):
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **signature_rows([t if isinstance(t, str) else None for t in pdf["text"]], n)})

    return map_frames(bounded_batches(docs).select("doc_id", "text"), sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, planes array<long>")


def digests(sets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each of the non-empty sets that begin at starts."""
    return np.add.reduceat(mix(sets + np.uint64(17)), starts), np.add.reduceat(mix(sets ^ np.uint64(0x5555555555555555)), starts)


def shingle_arrays(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, shingles (the set's hashes) and its digests d1, d2 for the rows whose set is not empty."""

    def run(frames):
        for pdf in frames:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            for lo, hi in batches_by_bytes(texts):
                sets, bounds = shingle_sets(texts[lo:hi], n)
                full = np.flatnonzero(np.diff(bounds))
                if len(full):
                    d1, d2 = digests(sets, bounds[:-1][full])
                    shingles = [sets[bounds[k] : bounds[k + 1]].tobytes() for k in full.tolist()]
                    yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[lo + full], "shingles": shingles, "d1": d1.view(np.int64), "d2": d2.view(np.int64)})

    return map_frames(bounded_batches(docs).select("doc_id", "text"), run, "doc_id long, shingles binary, d1 long, d2 long")


def _sets_of(ids: DataFrame, docs: DataFrame, reps: DataFrame, n: int, keep) -> DataFrame:
    """doc_id, shingles of the ids: of several texts under one id, the set whose digests reps has."""
    on = ["doc_id", *(c for c in ("d1", "d2") if c in reps.columns)]
    ids = keep(ids.distinct().join(reps.select(*on), "doc_id"), "ids")
    few = bounded_broadcast(ids, ids.count())
    sets = keep(shingle_arrays(docs.select("doc_id", "text").join(few, "doc_id", "left_semi"), n), "sets")
    return sets.join(few, on, "left_semi").select("doc_id", "shingles").dropDuplicates(["doc_id"])


def _estimate(x: str, y: str):
    """Collision-corrected similarity from the packed planes of both sides."""
    words = K // 64
    unequal = None
    for w in range(words):
        diff = None
        for bit in range(BITS):
            i = bit * words + w
            d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
            diff = d if diff is None else diff.bitwiseOR(d)
        c = F.bit_count(diff)
        unequal = c if unequal is None else unequal + c
    chance = 2.0**-BITS
    return ((K - unequal) / F.lit(float(K)) - chance) / (1 - chance)


@F.pandas_udf(BooleanType())
def _overlap_at_least(x: pd.Series, y: pd.Series, percent: pd.Series) -> pd.Series:
    out = np.zeros(len(x), bool)
    for i, (a, b, t) in enumerate(zip(x, y, percent, strict=True)):
        p, q = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if t * max(len(p), len(q)) <= 100 * min(len(p), len(q)):
            both = np.concatenate((p, q))
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            out[i] = 100 * same >= t * (len(both) - same)
    return pd.Series(out)


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, percent: int, keep) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold, sets being made for the documents in pairs only."""
    sets = _sets_of(pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))), docs, reps, n, keep)
    left = pairs.join(sets.withColumnsRenamed({"doc_id": "u", "shingles": "su"}), "u")
    both = left.join(sets.withColumnsRenamed({"doc_id": "v", "shingles": "sv"}), "v")
    return both.where(_overlap_at_least("su", "sv", F.lit(percent))).select("u", "v")


def _block_links(rows: list, percent: int) -> list:
    """Links between the strays (side 0) and members (side 1) of one block that join components. rows, strays first:
    (bucket, side, doc, component, the bucket's main component, set, bands)."""
    strays = sum(1 for r in rows if r[1] == 0)
    if not 0 < strays < len(rows):
        return []
    sets = [np.frombuffer(r[5], np.uint64) for r in rows]
    sizes = np.array([len(x) for x in sets])
    doc, comp, main = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), rows[0][4]
    bands = np.stack([r[6] for r in rows])
    band = int(np.flatnonzero(bands[0] == rows[0][0])[0])  # a pair that shares an earlier band was met in its bucket
    ids, starts, mark = None, None, None
    found: dict = {}

    def root(c):
        while found.get(c, c) != c:
            c = found[c]
        return c

    out: list = []
    size_m, doc_m, comp_m, bands_m = sizes[strays:], doc[strays:], comp[strays:], bands[strays:, :band]
    for i in range(strays):
        fits = (100 * np.minimum(size_m, sizes[i]) >= percent * np.maximum(size_m, sizes[i])) & (comp_m != comp[i]) & ((comp_m == main) | (doc_m < doc[i]))
        todo = np.flatnonzero(fits)
        todo = todo[~(bands_m[todo] == bands[i, :band]).any(1)]
        if not len(todo):
            continue
        if len(rows) <= 8:  # few: no numbering of shingles
            same = np.array([len(np.intersect1d(sets[i], sets[strays + j], assume_unique=True)) for j in todo])
            n = size_m[todo]
        else:
            if ids is None:
                _, ids = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.cumsum(sizes) - sizes
                mark = np.zeros(int(ids.max()) + 1, np.int32)
            own = ids[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            n = size_m[todo]
            at = np.repeat(starts[strays:][todo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            same = np.add.reduceat(mark[ids[at]], np.cumsum(n) - n)
            mark[own] = 0
        for j in todo[100 * same >= percent * (sizes[i] + n - same)].tolist():
            x, y = root(comp[i]), root(comp_m[j])
            if x != y:
                found[max(x, y)] = min(x, y)
                out.append((int(doc[i]), int(doc_m[j])))
    return out


def _apart_links(percent: int):
    """_block_links over rows in the order of their blocks, many small blocks a batch."""

    def run(frames):
        key, rows, out = None, [], []
        for pdf in frames:
            cols = [pdf[c].tolist() for c in ("bucket", "i", "j", "side", "doc_id", "c", "main")]
            for bucket, i, j, side, doc, comp, main, shingles, bands in zip(*cols, pdf["shingles"], pdf["bands"], strict=True):
                if (bucket, i, j) != key:
                    out += _block_links(rows, percent)
                    key, rows = (bucket, i, j), []
                rows.append((bucket, side, doc, comp, main, shingles, bands))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["u", "v"])
                out = []
        out += _block_links(rows, percent)
        if out:
            yield pd.DataFrame(out, columns=["u", "v"])

    return run


def _open_buckets(label: DataFrame, keep=materialize) -> DataFrame:
    """Buckets of (bucket, doc_id, c, n_shingles) rows that hold more than one component: bucket, main (the largest one) and
    in how many parts strays and members are compared."""
    parts = label.groupBy("bucket", "c").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("total"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("size", "c", "total")).alias("m"), F.count("*").alias("parts"), F.sum("total").alias("total")).where("parts > 1")
    cut = lambda n, by: F.ceil(n / F.lit(by)).cast("int")
    return keep(main.select("bucket", F.col("m.c").alias("main"), cut(F.col("total") - F.col("m.total"), STRAY_SHINGLES).alias("ns"), cut(F.col("total"), MEMBER_SHINGLES).alias("nm")), "open")


def _late_links(members: DataFrame, comps: DataFrame, docs: DataFrame, reps: DataFrame, n: int, percent: int, keep=materialize) -> DataFrame:
    """Links between different components that share a bucket: all members outside the bucket's largest component are
    compared with all others, in blocks of bounded bytes; a block returns only links that join components. A bucket too large
    for one block is dealt over several, so that every pair meets whatever the bucket's size."""
    label = members.select("bucket", "doc_id").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    label = keep(label.join(reps.select("doc_id", "n_shingles"), "doc_id"), "labels")
    main = _open_buckets(label, keep)
    open_ = keep(label.join(bounded_broadcast(main, main.count()), "bucket"), "open-members")
    sets = _sets_of(open_.select("doc_id"), docs, reps, n, keep).join(reps.select("doc_id", "bands"), "doc_id")
    salt = lambda k: F.pmod(F.xxhash64("doc_id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    strays = open_.where("c <> main").select("bucket", "doc_id", "c", "main", F.lit(0).alias("side"), salt("ns").alias("i"), every("nm").alias("j"))
    others = open_.select("bucket", "doc_id", "c", "main", F.lit(1).alias("side"), salt("nm").alias("j"), every("ns").alias("i")).select(*strays.columns)
    rows = strays.union(others).join(sets, "doc_id")
    blocks = bounded_batches(rows.repartition("bucket", "i", "j")).sortWithinPartitions("bucket", "i", "j", "side", "doc_id")
    return map_frames(blocks, _apart_links(percent), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept: one row for each row of docs.
    Links: 100 * intersection >= percent * union of the sets of distinct n-word shingles."""
    docs, key, made = bounded_reads(docs).select("doc_id", "text"), ["n_shingles", "d1", "d2"], []

    def keep(df: DataFrame, label: str) -> DataFrame:  # until the next table that is built on it is written
        made.append(materialize(df, label))
        return made[-1]

    def done(df: DataFrame) -> DataFrame:
        discard(*made)
        made.clear()
        return df

    sig = materialize(signatures(docs, n), "signatures")
    classed = sig.where("doc_id is not null and n_shingles > 0")
    classes = materialize(classed.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "copies")
    first = classes.select(F.col("rep").alias("doc_id"), *key).hint("shuffle_hash")
    reps = materialize(classed.select("doc_id", *key, "planes", "bands").join(first, ["doc_id", *key], "left_semi").dropDuplicates(["doc_id"]), "classes")  # read several times below
    entries = reps.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = materialize(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = materialize(entries.join(bounded_broadcast(buckets, buckets.count()), "bucket"), "members")
    # a bucket's leader is its member that shares most bands with others: of a group of edited copies, the original
    score = members.groupBy("doc_id").agg(F.sum("size").alias("score"))
    led = members.join(score, "doc_id").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("low"))).alias("m"), F.count("*").alias("n"))
    leaders = materialize(led.select("bucket", (-F.col("m.low")).alias("leader"), "n"), "leaders")
    stars = hot_join(members, leaders, ["bucket"], "n", members.count()).where("doc_id <> leader").select(F.col("doc_id").alias("u"), F.col("leader").alias("v")).distinct()
    side = lambda key, name: reps.select(F.col("doc_id").alias(key), F.col("planes").alias(name))
    likely = stars.join(side("u", "pu"), "u").join(side("v", "pv"), "v").where(_estimate("pu", "pv") >= percent / 100 - MARGIN).select("u", "v")
    likely = materialize(likely, "stars")
    links = done(materialize(confirm(likely, docs, reps, n, percent, keep), "links"))
    comps = materialize(connected_components(links), "components")
    late = done(materialize(_late_links(members, comps, docs, reps, n, percent, keep), "late-links"))
    if not late.isEmpty():
        comps = materialize(connected_components(comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(late)), "components")
    found = materialize(classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*key, "copies", F.coalesce("component", "rep").alias("component_id")), "class-components")
    discard(classes, reps, buckets, members, leaders, likely, links, late)
    named = hot_join(classed.select("doc_id", *key), found, key, "copies", sig.count())
    alone = sig.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = named.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
