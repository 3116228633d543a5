"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct five-word shingles (64-bit hashes). Two sets
link when 100 * |intersection| >= 80 * |union|.

1. Equal sets form a class; its least doc_id stands for it.
2. A class of n shingles has t = ceil(0.8 n) at least in common with a class that it
   links with, so the l-th of these in order of hashes is among the n - t + l least of
   its own, for any l. Every class sends that many, with l = l(n) = max(1, n // LEAD). The
   other class has t shingles at least, and so l(t) of the class's own are among those
   that the other sends. A class of which fewer than l(t) are sent by any other links
   with none, and goes no further. No link is lost.
3. PartEnum: sizes fall into bands (l, l / 0.8); linked sets lie in one band or in
   adjacent ones, and differ in k = (r_i + r_(i+1)) / 9 shingles at most. For each
   family i (bands i and i+1) the domain of shingles is cut into n1 partitions of n2
   parts; at least n1 - k // (k2 + 1) partitions differ in k2 shingles at most, and
   there one of the subsets of n2 - k2 parts is equal. Each subset of each partition
   is a signature. Empty subsets are left out, unless a set has so many partitions
   with empty subsets that this could hide a link; then it emits those as well.
4. In each group of equal signatures every member is compared with the group's most
   connected member; linked ones are one component. Members of one group that are in
   different components after that are compared with each other, inside the group's
   task, by parity sketches (their distance never exceeds the sets' difference), and
   the pairs that the sketch can't exclude are verified. No pair inside a component
   and no pair that the sketch excludes is ever a row, yet no link is lost.
5. Pairs are verified on whole sets; components of the links.

Defined results: null text, empty text and text without words have size 0 and link
with nothing; rows that repeat a doc_id are one document for linking; rows with a
null doc_id link with nothing new (their class's least non-null id stands for them);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import ids, scratch, workers
from textveil.llm import shingles as sh
from textveil.llm.columns import unused
from textveil.llm.components import components

PERCENT = 80
SKETCH_WORDS = 16  # of 64 bits
BLOCK = 512
SMALL = 48
LEAD = 16
SIGNED = 200_000  # signatures in a batch


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in sh.chunks(texts):
        values, ends = sh.shingles(*sh.words(part))
        at = 0
        for end in ends:
            yield np.unique(values[at:end])
            at = end


def lead(n: int, percent: int = PERCENT) -> int:
    """How many of the least hashes of a set of n are sent to tell classes that may link."""
    return n - -(-percent * n // 100) + max(1, n // LEAD) if n else 0


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles that fall on each of the bits."""
    bits = np.bincount((sh.mix(values ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(SKETCH_WORDS * 64 - 1)).astype(np.int64), minlength=SKETCH_WORDS * 64) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def bands(size: int, percent: int = PERCENT) -> tuple[int, list[int]]:
    """The band that holds size, and the upper bounds of bands up to the one after it."""
    bounds, low = [], 1
    while True:
        bounds.append(low * 100 // percent)
        if len(bounds) > 1 and bounds[-2] >= size:
            return len(bounds) - 2, bounds
        low = bounds[-1] + 1


def family(i: int, bounds: list[int], percent: int = PERCENT) -> tuple[int, int, int, int]:
    """(k, n1, n2, k2) of family i."""
    k = (bounds[i] + bounds[i + 1]) * (100 - percent) // (100 + percent)
    if k <= 2:
        return k, 1, k + 3, k
    return k, k // 2 + 3 + k // 16, 3, 1


def signatures(values: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set in its band's family and in the family before."""
    own, bounds = bands(len(values), percent)
    out = []
    for i in (own, own - 1):
        if i < 0:
            continue
        k, n1, n2, k2 = family(i, bounds, percent)
        if k == 0:  # only equal sets link, and these are one class
            continue
        salted = sh.mix(values + np.uint64(i * 7919 + 1))
        cell = (salted % np.uint64(n1 * n2)).astype(np.int64)
        parts = np.zeros(n1 * n2, np.uint64)
        np.add.at(parts, cell, sh.mix(salted))
        full = (np.bincount(cell, minlength=n1 * n2) > 0).reshape(n1, n2)
        parts = parts.reshape(n1, n2)
        hidden = int((full.sum(axis=1) <= k2).sum()) >= n1 - k // (k2 + 1)
        for number, subset in enumerate(combinations(range(n2), n2 - k2)):
            value = np.full(n1, i * 1_000_003 + number, np.uint64)
            some = np.zeros(n1, bool)
            for q in subset:
                value = sh.mix(value * np.uint64(31) + parts[:, q])
                some |= full[:, q]
            value = sh.mix(value + np.arange(n1, dtype=np.uint64))
            out.append(value if hidden else value[some])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _repeats(key: str, columns: list[str]):
    """Keeps rows, sorted by key and doc, whose key another doc has as well."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # rows of the last key so far
        told = False
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            k, d = pdf[key].to_numpy(), pdf["doc"].to_numpy()
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            lengths = np.diff(np.r_[starts, len(k)])
            several = d[starts] != d[starts + lengths - 1]
            if held is not None and told:
                several[0] = True
            keep = np.repeat(several, lengths)
            last = starts[-1]
            skip = len(held) if held is not None and told else 0  # these went out before
            keep[:skip] = False
            if not several[-1]:
                keep[last:] = False  # may still repeat in the next batch
            yield pdf.loc[keep, columns]
            # One row stands for the open key: all of its rows so far have one doc, or went out.
            held, told = pdf.iloc[last : last + 1], bool(several[-1])

    return run


def _leftovers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (sig, doc, comp, n, sketch) sorted by sig: pairs of different components
    that sizes and sketches allow. Small groups are compared all at once, row by row
    at every distance; larger ones in blocks."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        sig = pdf["sig"].to_numpy()
        if held and (sig == held[0]["sig"].iloc[0]).all():
            held.append(pdf)
            continue
        last = int(np.searchsorted(sig, sig[-1]))
        yield from _across(pd.concat([*held, pdf.iloc[:last]], ignore_index=True))
        held = [pdf.iloc[last:]]
    if held:
        yield from _across(pd.concat(held, ignore_index=True))


def _across(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    sig, comp, doc, n = (rows[c].to_numpy() for c in ("sig", "comp", "doc", "n"))
    bits = np.frombuffer(b"".join(rows["sketch"]), "<u8").reshape(len(rows), SKETCH_WORDS)

    def near(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        keep = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        i, j = i[keep], j[keep]
        far = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        keep = far * (100 + PERCENT) <= (n[i] + n[j]) * (100 - PERCENT)
        return pd.DataFrame({"x": np.minimum(doc[i], doc[j])[keep], "y": np.maximum(doc[i], doc[j])[keep]})

    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(sig)])
    small = np.repeat(lengths <= SMALL, lengths)
    for distance in range(1, min(SMALL, len(sig))):
        i = np.flatnonzero((sig[distance:] == sig[:-distance]) & small[:-distance])
        if not len(i):
            break
        yield near(i, i + distance)
    for start, length in zip(starts[lengths > SMALL], lengths[lengths > SMALL], strict=True):
        for a in range(0, length, BLOCK):
            for b in range(a, length, BLOCK):
                i, j = np.meshgrid(np.arange(a, min(a + BLOCK, length)), np.arange(b, min(b + BLOCK, length)), indexing="ij")
                keep = (i < j) & (comp[start + i] != comp[start + j])
                if keep.any():
                    yield near(start + i[keep], start + j[keep])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among pairs (x, y), as edges (u, v)."""
    x = sets.select(F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("s").alias("sx"))
    y = sets.select(F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("s").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy")).cast("long")
    found = pairs.join(y, "y").join(x, "x").withColumn("both", both)
    return found.filter(100 * F.col("both") >= PERCENT * (F.col("nx") + F.col("ny") - F.col("both"))).select(F.col("x").alias("u"), F.col("y").alias("v"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(ids.filled(doc_id).alias("doc"), F.col(text).alias("text"))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, h1, h2, prefix = [], [], [], []
            for s in sets_of([(t or "").encode() for t in pdf["text"]]):
                n.append(len(s))
                h1.append(int(sh.mix(s).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(sh.mix(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).astype(np.int64)))
                prefix.append(s[: lead(len(s))].view(np.int64))
            yield pd.DataFrame({"doc": pdf["doc"], "n": n, "h1": h1, "h2": h2, "prefix": prefix})

    described = scratch.table(rows.mapInPandas(workers.lean(describe), "doc long, n long, h1 long, h2 long, prefix array<long>"), "described")
    known = scratch.table(described.drop("prefix"), "known")
    named = known.filter((F.col("n") > 0) & (F.col("doc") != ids.NONE))
    classes = named.groupBy("n", "h1", "h2").agg(F.min("doc").alias("rep"))
    classes = scratch.table(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc"))
    prefixes = described.join(reps, "doc", "left_semi").select(F.explode("prefix").alias("key"), "doc")
    # several documents have sent this shingle
    shared = prefixes.repartition(parallel, "key").sortWithinPartitions("key", "doc").mapInPandas(workers.lean(_repeats("key", ["doc"])), "doc long")
    shared = shared.groupBy("doc").agg(F.count(F.lit(1)).alias("shared"))
    least = F.greatest(F.lit(1), F.expr(f"(({PERCENT} * n + 99) div 100) div {LEAD}"))
    shared = shared.join(named.select("doc", "n"), "doc").filter(F.col("shared") >= least).select("doc").distinct()

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = list(sets_of([t.encode() for t in pdf["text"]]))
            yield pd.DataFrame({"doc": pdf["doc"], "n": [len(s) for s in found], "s": [s.view(np.int64) for s in found], "sketch": [sketch(s).tobytes() for s in found]})

    sets = rows.filter("text IS NOT NULL").join(shared, "doc", "left_semi").mapInPandas(workers.lean(build), "doc long, n long, s array<long>, sketch binary")
    sets = scratch.table(sets, "sets")
    scratch.drop(described)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, docs, held = [], [], 0
            for doc, s in zip(pdf["doc"], pdf["s"], strict=True):
                found.append(signatures(np.asarray(s, np.int64).view(np.uint64)).view(np.int64))
                docs.append(doc)
                held += len(found[-1])
                if held >= SIGNED:
                    yield pd.DataFrame({"sig": np.concatenate(found), "doc": np.repeat(docs, [len(x) for x in found])})
                    found, docs, held = [], [], 0
            if held:
                yield pd.DataFrame({"sig": np.concatenate(found), "doc": np.repeat(docs, [len(x) for x in found])})

    signed = sets.select("doc", "s").mapInPandas(workers.lean(sign), "sig long, doc long")
    members = signed.repartition(parallel, "sig").sortWithinPartitions("sig", "doc").mapInPandas(workers.lean(_repeats("sig", ["sig", "doc"])), "sig long, doc long")
    members = scratch.table(members, "members")
    weight = members.groupBy("doc").agg(F.count(F.lit(1)).alias("w"))
    hubs = members.join(weight, "doc").groupBy("sig").agg(F.max(F.struct("w", (-F.col("doc")).alias("d"))).alias("m")).select("sig", (-F.col("m.d")).alias("hub"))
    pairs = members.join(hubs, "sig").filter("doc <> hub").select(F.col("doc").alias("x"), F.col("hub").alias("y")).distinct()
    sizes = sets.select("doc", "n", "sketch")
    links = scratch.table(_verified(pairs.join(_allowed(pairs, sizes), ["x", "y"], "left_semi"), sets), "links")
    joined = components(links)

    sized = members.join(joined.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    split = sized.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("sig")
    rest = sized.join(split, "sig", "left_semi").distinct().join(sizes, "doc")
    rest = rest.repartition(parallel, "sig").sortWithinPartitions("sig", "doc").mapInPandas(workers.lean(_leftovers), "x long, y long").distinct()
    more = scratch.table(_verified(rest, sets), "links")
    found = components(links.unionByName(more))

    out = known.select("doc", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left")
    out = out.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.withColumn("doc", ids.emptied("doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc").alias("component_id"))


def _allowed(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs that sizes and sketches allow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = (np.stack([np.frombuffer(s, "<u8") for s in pdf[c]]) for c in ("kx", "ky"))
                n, m = pdf["nx"].to_numpy(), pdf["ny"].to_numpy()
                far = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
                near = (far * (100 + PERCENT) <= (n + m) * (100 - PERCENT)) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
                yield pdf.loc[near, ["x", "y"]]

    x = sizes.select(F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("kx"))
    y = sizes.select(F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("ky"))
    return pairs.join(y, "y").join(x, "x").mapInPandas(workers.lean(run), "x long, y long")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that link, directly or not, with a smaller doc_id.

    Of rows that repeat a doc_id all stay or go; rows with a null doc_id stay.
    """
    (gone,) = unused(docs, "gone")
    found = near_duplicates(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs["doc_id"] == found[gone], "left_anti")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(node, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.node, l.b FROM reach JOIN l ON reach.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, documents.doc_id) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN c ON c.node = documents.doc_id
"""
