"""Near-duplicate classes by weighted dart signatures, banded joins and exact verification.

Signatures throw hashed darts into the region of every shingle. A shingle of weight w (its count in the text)
owns the area [0, w) x [0, oo) of weight and time; darts fall into it as a Poisson process of rate one whose
every gap comes from a hash of the shingle, so texts that share a shingle share its darts. Only darts earlier than
t / (total weight), t = k ln k + 2k, are thrown, about t of them for a text of any length; each dart's hash deals it
to one of k coordinates, and the earliest dart of a coordinate is kept. Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity, sum(min) / sum(max).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bytewords import GOLDEN, combine, group_hash, mix, windows, words
from plumbline.llm.common import Workspace, chunks, counted, cut

SHINGLE_WORDS, THRESHOLD = 5, 0.8
#: 30 bands of 5 coordinates: a pair at the threshold shares no band with probability 7e-6.
BANDS, ROWS = 30, 5
#: Holders up to which a shingle counts as rare, so that its holders may be paired.
RARE = 8
#: Ratio of the lengths that one class of lengths holds.
STEP = 1.1
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]+")


def shingles(texts: list[str | None], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count) of each distinct shingle; fewer words than ``size`` make one shingle."""
    found = words(texts)
    hashes, counts = found.hashes(), found.counts
    value, first = windows(hashes, found.doc, size)
    doc = found.doc[first]
    if len(short := np.flatnonzero((counts > 0) & (counts < size))):
        at = np.concatenate([np.flatnonzero(np.isin(found.doc, short))])
        lengths = counts[short]
        value = np.concatenate([value, group_hash(hashes[at], np.cumsum(lengths) - lengths, lengths)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(at, append=len(value))


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, k: int, spread: float = 1.0) -> np.ndarray:
    """(n_docs, k) dart hashes, 0 in rows without elements. Weights are positive; any real number will do."""
    out = np.zeros((n_docs, k), np.uint64)
    if not len(doc):
        return out
    until = spread * (k * np.log(k) + 2 * k) / np.maximum(np.bincount(doc, weight, n_docs), 1e-300)
    # The weight axis is cut at 1, 2, 4, ...: a piece of width d has darts of rate d, kept if they fall below the weight.
    pieces = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), pieces)
    level = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    width = np.exp2(np.maximum(level - 1, 0))
    low = np.where(level > 0, width, 0.0)
    seed = mix(value[of] + (level + 1).astype(np.uint64) * GOLDEN)
    own, top, when = doc[of], weight[of].astype(float), np.zeros(len(of))
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done, ahead = 0, 1
    while len(own):
        # Few pieces are left after the first rounds, so later rounds look more darts ahead.
        steps = np.arange(done + 1, done + ahead + 1, dtype=np.uint64) * GOLDEN
        done, ahead = done + ahead, min(2 * ahead, 64)
        drawn = mix(seed[:, None] + steps)
        times = when[:, None] + np.cumsum(-np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width[:, None], axis=1)
        row, col = np.nonzero(times <= until[own][:, None])
        dart = mix(drawn[row, col] ^ GOLDEN)
        hit = low[row] + width[row] * ((mix(dart) >> np.uint64(11)).astype(float) * 2.0**-53) < top[row]
        got.append((own[row[hit]], dart[hit], times[row, col][hit]))
        when = times[:, -1]
        early = when <= until[own]
        own, top, when, low, width, seed = (x[early] for x in (own, top, when, low, width, seed))
    own, dart, when = (np.concatenate(x) for x in zip(*got, strict=True))
    key = own * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((when, key))
    key, dart = key[order], dart[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    filled = np.zeros(n_docs * k, bool)
    filled[key[first]] = True
    out.reshape(-1)[key[first]] = dart[first]
    filled = filled.reshape(n_docs, k).all(1)
    if len(again := np.flatnonzero(~filled & (np.bincount(doc, minlength=n_docs) > 0))):
        mine = np.isin(doc, again)
        out[again] = signatures(np.searchsorted(again, doc[mine]), value[mine], weight[mine], len(again), k, 2 * spread)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different bands apart."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = combine([parts[:, :, j].reshape(-1) for j in range(rows)]).reshape(len(signature), bands)
    return mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN).view(np.int64)


def digest(text: str | None) -> bytes | None:
    """16 bytes that texts of the same words share; texts without words share them if they are equal."""
    if text is None:
        return None
    raw = text.encode("utf-8", "replace")
    plain = _GAP.sub(b" ", raw.lower()).strip()
    return hashlib.blake2b(plain or b"\x00" + raw, digest_size=16).digest()


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if r is None else len(r) for r in rows]
    values = np.concatenate([*(r for r in rows if r is not None), np.zeros(0, np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes], dtype=np.int32)), pa.array(values), mask=pa.array([r is None for r in rows], pa.bool_()))


def _sketcher(bands: int, rows: int, size: int):
    """Rows of (id, digest, band keys); of equal digests in a batch only the first is sketched, the others have null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            digests = [digest(t) for t in texts]
            seen = {d: i for i, d in reversed(list(enumerate(digests))) if d is not None}
            first = sorted(seen.values())
            keys: list[np.ndarray | None] = [None] * len(texts)
            own = [texts[i] for i in first]
            for a, b in chunks(own):
                doc, value, count = shingles(own[a:b], size)
                got = band_keys(signatures(doc, value, count, b - a, bands * rows), bands, rows)
                some = np.bincount(doc, minlength=b - a) > 0
                for i, x, y in zip(first[a:b], got, some, strict=True):
                    keys[i] = x if y else x[:0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), _lists(keys)], ["id", "digest", "bands"])

    return run


def _shingler(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                doc, value, count = shingles(texts[a:b], size)
                # The n-th copy of a shingle becomes an element of its own: set Jaccard is then the weighted one.
                of = np.repeat(np.arange(len(doc)), count)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                element = mix(value[of] + nth.astype(np.uint64) * GOLDEN).view(np.int64)
                parts = np.split(element, np.searchsorted(doc[of], np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([pa.array([digest(t) for t in texts[a:b]], pa.binary()), _lists(parts)], ["digest", "elements"])

    return run


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(vertex, component) of undirected edges (a, b); a component is named by its smallest vertex.

    Alternates the large-star and the small-star step until every edge leads from a vertex to its component's name. All
    of it stays in tables: the driver sees one yes or no a round.
    """
    now = work.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), few=True)
    while True:
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        before, now = now, work.cut(small.select(F.col("a"), F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b"), F.col("m"))).distinct(), few=True)
        work.drop(before)


def _elements(source: DataFrame, needed: DataFrame, size: int, work: Workspace) -> DataFrame:
    """(v, elements, n): all shingles of the needed vertices (v, digest, id), each from the text of its row ``id``."""
    ids = counted(needed.select(F.col("id").alias("want")).distinct(), work)
    texts = source.join(ids, source["id"].eqNullSafe(ids["want"]), "left_semi").select("text")
    got = texts.mapInArrow(_shingler(size), "digest binary, elements array<long>")
    return got.join(needed.select("v", "digest"), "digest").select("v", "elements").dropDuplicates(["v"]).withColumn("n", F.size("elements"))


def _verified(edges: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The edges (a, b) whose texts are similar enough, compared by all their shingles."""
    left, right = elements.select(F.col("v").alias("a"), F.col("elements").alias("x")), elements.select(F.col("v").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    share = both / (F.size("x") + F.size("y") - both)
    return edges.join(left, "a").join(right, "b").where(share >= threshold).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per input row: the id, class_id (smallest id of its class) and n_copies (rows of the same words).

    Classes are the connected components of the relation "weighted Jaccard similarity of ``size``-word shingles is
    at least ``threshold``". Rows of the same words count as one vertex, so a group of copies is never paired up.
    In every bucket the vertex that shares most bands with others is the center; the most frequent center of each
    vertex is verified and components are formed. What is left are members outside their bucket's main component.
    The shingles that no other open vertex has bound the similarity that such a member can reach, and rare ones that
    which it can reach with those that share none of them: it meets the holders of its rare shingles and, only if the
    rest would do, the members of its buckets whose lengths allow it. Pairs whose ends are already connected need no comparison; every other pair that
    shares a band is compared or excluded by its bound.

    Buckets are counted and led by aggregates that combine on the map side, and joined by plain equi-joins that adaptive
    execution can split, so one band may hold any share of the rows.

    Null texts: each row is a class of its own, named by its id. Texts without words: equal ones form a class. Fewer
    words than ``size``: one shingle of all. Repeated rows and ids: one output row each. Null ids are ignored when
    a class is named (its name is null if all are). Empty table: no rows. Other columns are not looked at.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with Workspace(docs.sparkSession) as work:
        return cut(_classes(source, work, threshold, size, bands, rows), few=True).withColumnRenamed("id", id_col)


def _classes(source: DataFrame, work: Workspace, threshold: float, size: int, bands: int, rows: int) -> DataFrame:
    kind = source.schema["id"].dataType.simpleString()
    sketch = work.cut(source.mapInArrow(_sketcher(bands, rows, size), f"id {kind}, digest binary, bands array<long>"))
    whole = sketch.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n_copies"), F.first("bands", ignorenulls=True).alias("bands"))
    # Vertices get their numbers once, when this table is written.
    whole = work.cut(whole.withColumn("v", F.monotonically_increasing_id()), few=True)
    told = whole.select("v", F.explode("bands").alias("band"))
    shared = told.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = work.cut(told.join(shared, "band").groupBy("v").agg(F.sum("n").alias("reach"), F.collect_list("band").alias("bands")), few=True)

    placed = members.select("v", "reach", F.explode("bands").alias("band"))
    center = placed.groupBy("band").agg(F.max(F.struct("reach", "v")).alias("top")).select("band", F.col("top.v").alias("center"))
    best = placed.join(center, "band").where("v <> center").groupBy("v").agg(F.mode("center", True).alias("center"))
    tried = work.cut(best.select(F.greatest("v", "center").alias("a"), F.least("v", "center").alias("b")).distinct(), few=True)
    elements = work.cut(_elements(source, whole.select("v", "digest", "id").join(members.select("v"), "v", "left_semi"), size, work), few=True)
    first = work.cut(components(_verified(tried, elements, threshold), work), few=True)

    named = members.join(first.withColumnRenamed("vertex", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("component"), F.explode("bands").alias("band"))
    mixed = named.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band")
    opened = work.cut(named.join(mixed, "band", "left_semi").groupBy("v", "component").agg(F.collect_list("band").alias("bands")), few=True)
    held = elements.join(opened.select("v"), "v", "left_semi").select("v", F.explode("elements").alias("e"))
    holders = held.groupBy("e").agg(F.count("*").alias("k")).where(F.col("k") <= RARE)
    rare = work.cut(held.join(holders, "e"), few=True)
    few = rare.groupBy("v").agg(F.count(F.when(F.col("k") == 1, 1)).alias("own"), F.count("*").alias("rare"))
    # cap: the most elements that a vertex can share with another open one; rcap: with one that shares no rare element.
    zero = F.lit(0)
    facts = opened.join(elements.select("v", "n"), "v").join(few, "v", "left")
    facts = work.cut(facts.select("v", "component", "bands", "n", (F.col("n") - F.coalesce("own", zero)).alias("cap"), (F.col("n") - F.coalesce("rare", zero)).alias("rcap")), few=True)

    low = threshold - 1e-9
    # Members outside the largest component of a bucket, and the lengths of partners with whom the threshold is in reach.
    open_ = facts.select("v", "component", "n", "cap", "rcap", F.explode("bands").alias("band"))
    home = open_.groupBy("band", "component").agg(F.count("*").alias("k")).groupBy("band").agg(F.max(F.struct("k", "component")).alias("home"))
    shortest, longest = F.col("n") * low, lambda most: F.least(F.col("n") / low, F.col(most) * (1 + low) / low - F.col("n"))
    outside = open_.join(home, "band").where((F.col("component") != F.col("home.component")) & (longest("cap") >= shortest))
    outside = work.cut(outside.select("band", "v", "component", "n", "cap", "rcap"), few=True)
    # First the partners that share a rare element, at most RARE for each element; then, for those that could reach the
    # threshold without one, the members of their buckets.
    several = rare.where("k > 1").select("e", "v")
    renamed = lambda df: df.withColumnsRenamed({"v": "a", "component": "c", "n": "m", "cap": "most"})
    enough = lambda ours: F.least(ours, "most") >= low * (F.col("n") + F.col("m") - F.least(ours, "most"))
    lone = renamed(outside.select("v", "component", "n", "cap").distinct())
    near = lone.join(several.withColumnRenamed("v", "a"), "a").join(several, "e").select("a", "c", "m", "most", "v").distinct()
    near = near.join(facts.select("v", "component", "n", "cap"), "v").where((F.col("c") != F.col("component")) & enough("cap")).select("a", "v")
    step = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) / math.log(STEP) + 1e-9).cast("int")
    wide = outside.where(longest("rcap") >= shortest).withColumn("step", F.explode(F.sequence(step(F.floor(shortest)), step(F.ceil(longest("rcap"))))))
    wide = wide.select("band", "step", F.col("v").alias("a"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("rcap").alias("most"))
    far = wide.join(open_.withColumn("step", step(F.col("n"))), ["band", "step"]).where((F.col("c") != F.col("component")) & enough("rcap")).select("a", "v")
    crossing = near.union(far).select(F.greatest("a", "v").alias("a"), F.least("a", "v").alias("b")).distinct()
    second = work.cut(_verified(crossing.join(tried, ["a", "b"], "left_anti"), elements, threshold), few=True)
    name = lambda c, to: first.select(F.col("vertex").alias(c), F.col("component").alias(to))
    joined = second.join(name("a", "ca"), "a", "left").join(name("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(joined, work).select(F.col("vertex").alias("component"), F.col("component").alias("final"))

    classes = whole.select("v", "digest", "id", "n_copies").join(first.withColumnRenamed("vertex", "v"), "v", "left").withColumn("component", F.coalesce("component", "v")).join(merged, "component", "left")
    classes = work.cut(classes.select("digest", "id", "n_copies", F.coalesce("final", "component").alias("class")), few=True)
    ids = classes.groupBy("class").agg(F.min("id").alias("class_id"))
    told = classes.join(ids, "class").select("digest", "class_id", "n_copies")
    rest = sketch.select("id", "digest")
    known = rest.where("digest is not null").join(told, "digest").select("id", "class_id", "n_copies")
    alone = rest.where("digest is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return known.union(alone)
