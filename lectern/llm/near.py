"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

A document is the set of its distinct word shingles, as 64-bit hashes. SuperMinHash
walks one random permutation of the signature places per shingle: step j offers the
value j + random to the j-th place of the permutation, and a document is done as soon
as every place holds a value below j, so long documents need only a few steps. All
documents of a batch walk together.

Places are cut into bands; documents that agree on a band share a bucket. Equal texts
become one representative first. Then every bucket is a star: its members are compared
with its first member only, on their full sets. What a star cannot settle goes on:

* members that are not near the first member form a star of their own in the next round;
* a near miss x of the first member r can still be near a member y of the star, but as
  1 - similarity is a metric only where sim(y, r) <= sim(x, r) + (1 - threshold);
* buckets that are not settled after the rounds can hold links between any two members.

The documents at both ends of such links form families. Those outside the largest
component of their family are compared with the others of it, block against block, by
products of item matrices, which give links only.

No bucket is ever expanded into rows of pairs. Two texts at the threshold share no band with
probability (1 - threshold ** rows) ** bands, 3e-6 for the defaults.

Defined results: null and empty texts have no shingles and are linked with nothing, not
even each other; a text with fewer words than a shingle is one shingle; equal rows and
equal texts are one component; different texts under one id, or without an id, are compared
like those of different ids, as classes of equal texts have numbers of their own; a row
without an id links others but gives no component its name; an empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm import common


@dataclass(frozen=True)
class Settings:
    """Shingle length in words, similarity in percent, signature shape."""

    shingle: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    rounds: int = 2
    seed: int = 7


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingles of a batch: document number and hash, sorted by both."""
    import xxhash

    docs, hashes = [], []
    digest = xxhash.xxh3_64_intdigest
    for number, text in enumerate(texts):
        # bytes.lower and bytes.split know ASCII letters and white space only.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        ids = np.array([digest(w) for w in words], dtype=np.uint64)
        size = min(length, len(words))
        value = np.full(len(words) - size + 1, np.uint64(size), dtype=np.uint64)
        for k in range(size):
            value = mixed(value * _GOLDEN + ids[k : len(ids) - size + 1 + k])
        value = np.unique(value)
        hashes.append(value)
        docs.append(np.full(len(value), number, dtype=np.int64))
    if not docs:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(docs), np.concatenate(hashes)


#: Shingles that walk together: bounds the memory of their permutations.
_TOGETHER = 100_000


def signatures(docs: np.ndarray, hashes: np.ndarray, n_docs: int, places: int, seed: int) -> np.ndarray:
    """SuperMinHash signatures of all documents of a batch, as integers.

    A place holds (step << 50 | random bits): smaller is an earlier step or a smaller
    random part. Each active shingle keeps its own permutation and swaps one place per step.
    """
    signature = np.full((n_docs, places), np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    for at in range(0, len(docs), _TOGETHER):
        _walk(signature, docs[at : at + _TOGETHER], hashes[at : at + _TOGETHER], seed)
    return signature


def _walk(signature: np.ndarray, docs: np.ndarray, hashes: np.ndarray, seed: int) -> None:
    places = signature.shape[1]
    order = np.tile(np.arange(places, dtype=np.int16), (len(docs), 1))
    state = mixed(hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    for step in range(places):
        state = mixed(state + _GOLDEN)
        row = np.arange(len(docs))
        swap = step + (state >> np.uint64(40)).astype(np.int64) % (places - step)
        place = order[row, swap].astype(np.int64)
        order[row, swap] = order[row, step]
        value = (np.uint64(step) << np.uint64(50)) | (mixed(state ^ _MIX[0]) >> np.uint64(14))
        np.minimum.at(signature.reshape(-1), docs * places + place, value)
        # Later steps offer larger values only: documents without a larger one are done.
        here = np.unique(docs)
        open_ = np.zeros(len(signature), dtype=bool)
        open_[here] = signature[here].max(axis=1) >= np.uint64(step + 1) << np.uint64(50)
        going = open_[docs]
        if not going.any():
            return
        if not going.all():
            docs, state, order = docs[going], state[going], order[going]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per document and band."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for k in range(rows):
        key = mixed(key * _GOLDEN + parts[:, :, k])
    return key


_SKETCH = "id long, text_hash long, text_key string, n_shingles long, bands array<long>"


def _row_key(docs: DataFrame) -> tuple[Column, Column]:
    """What tells rows apart, but for equal ones: the id, and a hash of the text."""
    return docs["doc_id"].cast("long"), F.xxhash64(docs["text"])


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """Per document: a key of its words, the size of its set, and its band keys."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(batch.column(2)):
                keys_of = [batch.column(k).slice(start, stop - start) for k in (0, 1)]
                texts = batch.column(2).slice(start, stop - start).to_pylist()
                docs, hashes = shingle_sets(texts, settings.shingle)
                size = np.bincount(docs, minlength=len(texts))
                signature = signatures(docs, hashes, len(texts), settings.bands * settings.rows, settings.seed)
                keys = band_keys(signature, settings.bands, settings.rows).view(np.int64)
                keep = size > 0
                names = [
                    hashlib.md5(b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())).hexdigest()
                    for t in texts
                ]
                lengths = np.where(keep, settings.bands, 0)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *keys_of, pa.array(names), pa.array(size.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[keep].ravel())),
                    ],
                    names=["id", "text_hash", "text_key", "n_shingles", "bands"],
                )

    doc_id, text_hash = _row_key(docs)
    return docs.select(doc_id.alias("id"), text_hash.alias("text_hash"), "text").mapInArrow(run, _SKETCH)


def _slices(texts: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``limit`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) with the sizes of the intersection and the union of their full sets.

    Texts are joined rather than sets of hashes, which do not compress. A star gives many
    rows of one ``a``; they carry ids when they are joined, so that adaptive execution can
    split them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            both, union = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
            last, left = None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, left = a[i], shingle_sets([batch.column(2)[i].as_py()], settings.shingle)[1]
                right = shingle_sets([batch.column(3)[i].as_py()], settings.shingle)[1]
                both[i] = len(np.intersect1d(left, right, assume_unique=True))
                union[i] = len(left) + len(right) - both[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(both), pa.array(union)],
                names=["a", "b", "both", "union"],
            )

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long, both long, union long")


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of every partition as stars around its smallest reachable ids, by union-find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = sorted((find(a), find(b)))
                root[high] = low
        ends = [(x, find(x)) for x in list(root)]
        ends = [e for e in ends if e[0] != e[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


_SALTS = 64


def _smallest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, low): the smallest value by key, through salted keys.

    The exchange of the join that follows is then its own, which adaptive execution may
    split; an aggregate by the key alone would share it and forbid that.
    """
    salted = rows.groupBy(key, F.pmod(F.xxhash64(value), F.lit(_SALTS)).alias("__salt")).agg(F.min(value).alias("low"))
    return salted.groupBy(key).agg(F.min("low").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per id of ``edges`` (a, b).

    Union-find inside the partitions first, then alternating star rounds between them:
    every node links its larger neighbours, then its smaller ones, to its smallest. Both
    keep the components, and stars around the smallest ids are left after about
    log(diameter) rounds. A hub is never one row or one task.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = common.stage(_contracted(edges), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _smallest(both, "a", "b").select("a", F.least("low", "a").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = common.stage(large.where("a <> b"), "edges")
        least = _smallest(large, "a", "b")
        moved = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = common.stage(moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "edges")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def _buckets(postings: DataFrame) -> DataFrame:
    """Members (key, id) of buckets with several members, with the ``first`` of each."""
    several = (
        postings.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    )
    return postings.join(several.drop("last"), "key")


@dataclass(frozen=True)
class Stars:
    """What the star rounds found: links, scores of near misses and their stars by bucket,
    buckets that no round settled, and the texts of all members."""

    links: DataFrame
    misses: DataFrame
    rest: DataFrame
    pool: DataFrame


def star_links(postings: DataFrame, texts, settings: Settings) -> Stars:
    """Compare every bucket's members with its first one, the far ones again among themselves.

    ``texts(ids)`` gives the texts of some ids.
    """
    t = settings.percent
    members = common.stage(_buckets(postings), "buckets")
    pool = texts(members.select("id").distinct())
    links, misses, seen = [], [], None
    for number in range(settings.rounds):
        pairs = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen.select("a", "b"), ["a", "b"], "left_anti")
        fresh = common.stage(_verified(pairs, pool, settings), "verified")
        links.append(fresh.where(f"100 * both >= {t} * union").select("a", "b"))
        seen = fresh if seen is None else seen.unionByName(fresh)
        scored = common.stage(
            members.where("id <> first")
            .join(seen.withColumnsRenamed({"a": "first", "b": "id"}), ["first", "id"])
            .select(
                "key", "first", "id", (F.col("both") / F.col("union")).alias("sim"),
                F.expr(f"100 * both >= {t} * union").alias("near"),
            ),
            "scored",
        )
        misses.append(scored.where(F.col("near") | (F.col("sim") > (2 * t - 100) / 100 - 1e-9)).withColumn("round", F.lit(number)))
        members = common.stage(_buckets(scored.where("NOT near").select("key", "id")), "buckets")
    return Stars(_union(links), _union(misses), members, pool)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def open_families(stars: Stars, roots: DataFrame, settings: Settings) -> DataFrame:
    """Documents that may have a link to another component: (family, id, root, minor).

    A link that the stars did not compare lies between a near miss and a member of the same
    star, no nearer to the first member than the metric allows, or between two members
    of an unsettled bucket. Families hold both ends of every such link: they are the
    components of stars and near misses. Within a family, only documents outside its
    largest component (minor) are compared with the others.
    """
    slack = (100 - settings.percent) / 100 + 1e-9
    bucket = ["round", "key"]
    reach = stars.misses.where("NOT near").groupBy(*bucket).agg((F.max("sim") + slack).alias("reach"))
    taking = stars.misses.join(reach, bucket).where("NOT near OR sim <= reach")
    taking = taking.select("first", "id").unionByName(stars.rest.select("first", "id"))
    taking = common.stage(taking.distinct(), "open")
    families = components(taking.select(F.col("id").alias("a"), F.col("first").alias("b")))
    ids = taking.select("id").unionByName(stars.rest.select(F.col("first").alias("id"))).distinct()
    placed = (
        ids.join(families.withColumnRenamed("root", "family"), "id", "left")
        .join(roots, "id", "left")
        .select("id", F.coalesce("family", "id").alias("family"), F.coalesce("root", "id").alias("root"))
    )
    placed = common.stage(placed, "families")
    by_root = placed.groupBy("family", "root").agg(F.count("*").alias("n"))
    main = by_root.groupBy("family").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"),
        F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("n_minor"),
    )
    return placed.join(main.where("roots > 1"), "family").select(
        "family", "id", "root", (F.col("root") != F.col("main")).alias("minor"), "n", "n_minor"
    )


#: Documents of a block: two blocks are compared at a time.
_BLOCK = 256


def family_links(families: DataFrame, pool: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between components of a family: for a minor document, one per component.

    Minor documents and all documents are dealt into blocks by hash. A pair of blocks is a
    row group of bounded size: sizes of intersections come from products of their item
    matrices, and no pair of documents is ever a row unless it is a link.
    """
    a_blocks = F.ceil(F.col("n_minor") / _BLOCK).cast("int")
    b_blocks = F.ceil(F.col("n") / _BLOCK).cast("int")

    def deal(rows: DataFrame, own: str, other: str, own_blocks, other_blocks) -> DataFrame:
        return rows.select(
            "family", "id", "root", "text", F.lit(own).alias("side"),
            F.pmod(F.xxhash64("id"), own_blocks).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), other_blocks - 1)).alias(other),
        )

    rows = families.join(pool, "id")
    dealt = deal(rows.where("minor"), "a", "b", a_blocks, b_blocks).unionByName(
        deal(rows, "b", "a", b_blocks, a_blocks)
    )

    def run(table: pa.Table) -> pa.Table:
        side = np.array(table["side"].to_pylist())
        ids, root = table["id"].to_numpy(), table["root"].to_numpy()
        docs, hashes = shingle_sets(table["text"].to_pylist(), settings.shingle)
        sizes = np.bincount(docs, minlength=len(ids)).astype(np.float64)
        left, right = np.flatnonzero(side == "a"), np.flatnonzero(side == "b")
        both = _intersections(docs, hashes, left, right)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        near = (100 * both >= settings.percent * union) & (root[left][:, None] != root[right][None, :])
        found = {}
        for x, y in zip(*np.nonzero(near)):
            found.setdefault((ids[left[x]], root[right[y]]), ids[right[y]])
        return pa.table(
            {"a": pa.array([k[0] for k in found], pa.int64()), "b": pa.array(list(found.values()), pa.int64())}
        )

    return dealt.groupBy("family", "a", "b").applyInArrow(run, "a long, b long")


def _intersections(docs: np.ndarray, hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared items of every left and right document, by slices of the items."""
    places = np.zeros((2, docs.max(initial=-1) + 1 if len(docs) else 0), dtype=np.int64) - 1
    for k, part in enumerate((left, right)):
        part = part[part < places.shape[1]]
        places[k, part] = np.arange(len(part))
    _, item = np.unique(hashes, return_inverse=True)
    counts = [np.bincount(item[places[k][docs] >= 0], minlength=item.max(initial=-1) + 1) for k in (0, 1)]
    shared = np.flatnonzero((counts[0] > 0) & (counts[1] > 0))
    number = np.full(len(counts[0]), -1)
    number[shared] = np.arange(len(shared))
    both = np.zeros((len(left), len(right)))
    for at in range(0, len(shared), 4096):
        column = number[item] - at
        here = (column >= 0) & (column < 4096)
        part = []
        for k, n in ((0, len(left)), (1, len(right))):
            matrix = np.zeros((n, min(4096, len(shared) - at)), dtype=np.float32)
            mine = here & (places[k][docs] >= 0)
            matrix[places[k][docs[mine]], column[mine]] = 1
            part.append(matrix)
        both += part[0] @ part[1].T
    return both


@dataclass(frozen=True)
class Groups:
    """What ``groups`` found.

    ``rows``: (id, text_hash, text_key, n_shingles) of every row. ``texts``: (text_key,
    component_id, keeper_id, keeper_hash) of the texts in components of several rows;
    the keeper is the row that stays.
    """

    rows: DataFrame
    texts: DataFrame


def groups(docs: DataFrame, settings: Settings | None = None) -> Groups:
    """Components of the documents, as classes of equal texts.

    A class has a number of its own, which stars and components work with, so that rows
    may share an id or have none. A component has the smallest id of its rows.
    """
    settings = settings or Settings()
    rows = common.stage(sketches(docs, settings), "sketches")
    # The first row stands for its class; rows with an id come before those without.
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    classes = rows.where("n_shingles > 0").groupBy("text_key").agg(
        F.min(order).alias("first"), F.count("*").alias("n"), F.any_value("bands").alias("bands")
    )
    classes = common.stage(classes.withColumn("number", F.monotonically_increasing_id()), "texts")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids.withColumnRenamed("id", "number"), "number", "left_semi").select(
            F.col("number"), F.col("first.id").alias("__llm_id"), F.col("first.text_hash").alias("__llm_hash")
        )
        doc_id, text_hash = _row_key(docs)
        named = docs.select(doc_id.alias("id"), text_hash.alias("text_hash"), "text")
        same = (F.col("text_hash") == F.col("__llm_hash")) & F.col("id").eqNullSafe(F.col("__llm_id"))
        found = named.join(wanted, same).groupBy(F.col("number").alias("id")).agg(F.min("text").alias("text"))
        return common.stage(found, "pool")

    postings = classes.select(F.col("number").alias("id"), F.explode("bands").alias("key"))
    stars = star_links(postings, texts, settings)
    roots = components(stars.links)
    families = common.stage(open_families(stars, roots, settings), "open")
    more = common.stage(family_links(families, stars.pool, settings), "links")
    if more.limit(1).count():
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    placed = (
        classes.select("text_key", "number", "first", "n")
        .join(roots.withColumnRenamed("id", "number"), "number", "left")
        .withColumn("root", F.coalesce("root", "number"))
    )
    placed = common.stage(placed.select("text_key", "root", "first", "n"), "placed")
    named = placed.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("n").alias("rows")).where("rows > 1")
    return Groups(
        rows.drop("bands"),
        placed.join(named, "root").select(
            "text_key", F.col("keeper.id").alias("component_id"),
            F.col("keeper.id").alias("keeper_id"), F.col("keeper.text_hash").alias("keeper_hash"),
        ),
    )


def group(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    The smallest id of a component stays. Rows without shingles are their own component.
    """
    found = groups(docs, settings)
    several = found.texts.select("text_key", "component_id", F.lit(True).alias("several"))
    # Rows without words share a key, but no component.
    key = F.when(F.col("n_shingles") > 0, F.col("text_key"))
    return (
        found.rows.withColumn("text_key", key).join(several, "text_key", "left")
        .select(
            F.col("id").alias("doc_id"), "n_shingles",
            F.when(F.col("several"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


#: Rows to drop (16 bytes each) up to which they are sent to all executors.
BROADCAST_ROWS = 1_000_000


def _bounded(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def select(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents with one row of each component; rows without shingles stay.

    Rows go by id and text. Of equal rows, which nothing tells apart, one is taken.
    """
    found = groups(docs, settings)
    rows = found.rows.where("n_shingles > 0").join(found.texts, "text_key")
    keeper = (F.col("text_hash") == F.col("keeper_hash")) & F.col("id").eqNullSafe(F.col("keeper_id"))
    judged = rows.groupBy("id", "text_hash").agg(F.max(keeper).alias("keeper"), F.count("*").alias("n"))
    judged = judged.where("NOT keeper OR n > 1").select(
        F.col("id").alias("__llm_id"), F.col("text_hash").alias("__llm_hash"), F.col("keeper").alias("__llm_keeper")
    )
    judged = common.stage(judged, "gone")
    doc_id, text_hash = _row_key(docs)
    same = (text_hash == F.col("__llm_hash")) & doc_id.eqNullSafe(F.col("__llm_id"))
    stay = docs.join(_bounded(judged), same, "left_anti")
    repeated = judged.where("__llm_keeper")
    if repeated.isEmpty():
        return stay
    one = docs.join(_bounded(repeated), same).groupBy("__llm_id", "__llm_hash").agg(
        F.first(F.struct(*docs.columns)).alias("__llm_doc")
    )
    return stay.unionByName(one.select(*[F.col("__llm_doc")[c].alias(c) for c in docs.columns]))


def op6(spark, sf) -> DataFrame:
    return group(common.documents(spark, sf), Settings(shingle=2))


def sql(shingle: int = 2, percent: int = 80) -> str:
    """The exact answer for small tables: all pairs that share a shingle, and what they reach."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    joined = f"array_to_string(w[i : i + {shingle - 1}], chr(32))"
    return f"""
WITH RECURSIVE said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^ \t-\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, chr(32))]
         ELSE list_distinct(list_transform(range(1, len(w) - {shingle} + 2), lambda i: {joined})) END AS s FROM said),
items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b
    ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, any_value(len(s)) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM sets JOIN reach USING (doc_id) GROUP BY doc_id"""


# Functions of this module travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
