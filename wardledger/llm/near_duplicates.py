"""Near-duplicate texts: SuperMinHash signatures, banding, exact verification and union-find grouping.

A text's set holds its distinct runs of ``run`` words (all its words as one where it has fewer), as 64-bit hashes.
Texts with equal sets form a class, which is named after its smallest id and takes part once. The SuperMinHash
signature of a class draws for each element a random permutation of the slots and a random fraction; the k-th slot
of the permutation gets the value k + fraction if that is smaller. Elements advance level by level, all elements of
many texts at once, and a text stops at the level after which no slot can change.

Slots are grouped into bands. Each class is paired with the smallest class of each of its buckets, so a bucket of
any size makes one pair a member; pairs whose signatures are far apart are dropped, the others are verified on full
sets, and the verified links give components. Where members of a bucket are then still in different components,
each member outside the bucket's largest component is compared with all others of the bucket, in blocks, so that no
link is lost; what passes is verified likewise. Links are merged by ``connected_components``.

A text without words, or null, has an empty set and is linked with nothing. A row without an id takes part in no
link and has no component. Rows that share an id are one document. An empty table gives an empty result. Columns
other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.llm.batches import key_groups
from wardledger.llm.components import connected_components
from wardledger.llm.words import BLANKS, chunks, mixed, runs_hashes, utf8, word_hashes
from wardledger.session import Workspace


class Banding(NamedTuple):
    """``bands`` of ``rows`` slots: at similarity s a pair is found with probability 1 - (1 - s**rows)**bands."""

    bands: int = 24
    rows: int = 4

    @property
    def slots(self) -> int:
        return self.bands * self.rows


_EMPTY_SLOT = np.uint64(2**64 - 1)
#: Texts, and elements of sets on average, in a block.
_BLOCK, _BLOCK_ELEMENTS = 512, 1 << 20
#: A verified pair has at least this share of equal signature slots but for a chance of some 1 in 10**4: 4 standard
#: deviations below the threshold at 96 slots.
_SLACK = 0.18


def shingle_sets(texts: list[bytes], run: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of words."""
    hashes, bounds = word_hashes(texts, BLANKS)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        words = hashes[a:b]
        out.append(np.unique(runs_hashes(words, min(run, len(words)))) if len(words) else words)
    return out


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash: a row of slot values for each set, level in the high half and fraction in the low one."""
    values = np.full((len(sets), slots), _EMPTY_SLOT)
    sizes = np.array([len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.empty((0, slots), np.uint8 if slots <= 256 else np.int32)
    for level in range(slots):
        if not len(elements):
            break
        draw = mixed(elements + np.uint64(0xD1B54A32D192ED03 * (level + 1) % 2**64))
        fraction, rest = draw & np.uint64(0xFFFFFFFF), draw >> np.uint64(32)
        pick = level + ((rest * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            slot = pick
        else:
            rows = np.arange(len(elements))
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, level]
        value = (np.uint64(level) << np.uint64(32)) | fraction
        np.minimum.at(values.reshape(-1), owner * slots + slot, value)
        # A later level gives level + 1 at least: texts whose slots are all below are done.
        open_texts = values.max(axis=1) >= np.uint64(level + 1) << np.uint64(32)
        going = open_texts[owner]
        elements, owner = elements[going], owner[going]
        if level == 0:
            order = np.tile(np.arange(slots, dtype=order.dtype), (len(elements), 1))
            pick = pick[going]
            order[np.arange(len(elements)), pick] = 0
        else:
            order = order[going]
    return values


def band_keys(values: np.ndarray, banding: Banding) -> np.ndarray:
    """A key for each band of each signature; equal keys mean equal slots of the same band."""
    keys = np.zeros((len(values), banding.bands), np.uint64)
    for band in range(banding.bands):
        key = np.full(len(values), band + 1, np.uint64)
        for k in range(banding.rows):
            key = mixed(key * np.uint64(31) + values[:, band * banding.rows + k])
        keys[:, band] = key
    return keys.view(np.int64)


def described(docs: DataFrame, banding: Banding, run: int) -> DataFrame:
    """For each row: set size, digest of the set, band keys (none for an empty set) and a 16-bit signature."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], run)
                values = signatures(sets, banding.slots)
                keys, short = band_keys(values, banding), mixed(values).astype(np.uint16)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in short], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "bands", "signature"])

    return docs.mapInArrow(describe, _with_id(docs, "id {}, n long, digest binary, bands array<long>, signature binary"))


def _with_id(docs: DataFrame, schema: str) -> str:
    return schema.format(docs.schema["id"].dataType.simpleString())


def matching_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of ``a`` and each row of ``b`` in how many slots their signatures agree."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _closeness(banding: Banding, percent: int) -> int:
    return int(max(0.0, percent / 100 - _SLACK) * banding.slots)


def _star_pairs(members: DataFrame, nodes: DataFrame, banding: Banding, percent: int) -> DataFrame:
    """Each member of a bucket with the bucket's smallest one, where sizes and signatures allow a link."""
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    pairs = members.select("key", "node").join(leaders.select("key", "leader"), "key").filter("node != leader")
    pairs = pairs.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    small = nodes.select("node", "n", "signature")
    pairs = pairs.join(small.toDF("a", "n_a", "signature_a"), "a").join(small.toDF("b", "n_b", "signature_b"), "b")
    pairs = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    least = _closeness(banding, percent)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, banding.slots)
                for c in ("signature_a", "signature_b")
            )
            good = pa.array((a == b).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("a", "b")], ["a", "b"])

    return pairs.mapInArrow(close, pairs.select("a", "b").schema)


def _rest_links(
    members: DataFrame, nodes: DataFrame, roots: DataFrame, texts: DataFrame, banding: Banding, percent: int, run: int
) -> DataFrame:
    """Verified links between different components that share a bucket.

    Members outside the largest component of their bucket meet all members, in blocks of bounded size. A pair that
    shares several buckets is compared in the first of its bands, and only if sizes and signatures allow a link;
    of the links found in a block only those are returned that connect something new.
    """
    labelled = members.join(roots, "node", "left").select("key", "band", "node", "n", F.coalesce("root", "node").alias("root"))
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("elements"))
    blocks_of = lambda rows, elements: F.ceil(F.greatest(rows / _BLOCK, elements / _BLOCK_ELEMENTS)).cast("int")
    mixed_buckets = (
        sizes.groupBy("key")
        .agg(
            F.max(F.struct("rows", "elements", "root")).alias("main"),
            F.sum("rows").alias("rows"),
            F.sum("elements").alias("elements"),
            F.count("*").alias("parts"),
        )
        .filter("parts > 1")
        .select(
            "key",
            F.col("main.root").alias("main"),
            blocks_of(F.col("rows"), F.col("elements")).alias("blocks"),
            blocks_of(F.col("rows") - F.col("main.rows"), F.col("elements") - F.col("main.elements")).alias("outside_blocks"),
        )
    )
    space = Workspace(members.sparkSession)
    rows = space.keep(labelled.join(mixed_buckets, "key"), "rows")
    content = _texts_of(texts, rows.select("node")).withColumnRenamed("id", "node")
    content = nodes.select("node", "n", "bands", "signature").join(content, "node")
    own = lambda blocks: F.pmod(F.xxhash64("node", "key"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    columns = ["key", "i", "j", "outside", "band", "node", "root"]
    outside = rows.filter("root != main").withColumn("outside", F.lit(True)).withColumn("i", own("outside_blocks"))
    outside = outside.withColumn("j", every("blocks")).select(columns)
    inside = rows.withColumn("outside", F.lit(False)).withColumn("j", own("blocks"))
    inside = inside.withColumn("i", every("outside_blocks")).select(columns)
    blocks = outside.unionByName(inside).join(content, "node")
    blocks = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    least = _closeness(banding, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_groups(batches, ("key", "i", "j")):
            outside = np.array(rows.column("outside").to_pylist(), bool)
            node, root = (rows.column(c).to_pylist() for c in ("node", "root"))
            n = np.array(rows.column("n").to_pylist())
            signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(-1, banding.slots)
            keys = np.array(rows.column("bands").to_pylist(), np.int64)
            left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
            good = matching_slots(signature[left], signature[right]) >= least
            for earlier in range(rows.column("band")[0].as_py()):
                good &= keys[left, earlier][:, None] != keys[right, earlier][None, :]
            smaller = np.minimum(n[left][:, None], n[right][None, :])
            good &= 100 * smaller >= percent * np.maximum(n[left][:, None], n[right][None, :])
            x, y = np.nonzero(good)
            texts, sets = rows.column("text"), {}
            name: dict = {}  # of components that links of this block have joined

            def top(c):
                while c in name:
                    c = name[c]
                return c

            def set_of(place):
                if place not in sets:
                    sets[place] = shingle_sets([(texts[place].as_py() or "").encode()], run)[0]
                return sets[place]

            links = []
            for p, q in zip(left[x].tolist(), right[y].tolist(), strict=True):
                a, b = top(root[p]), top(root[q])
                if a != b and _similar(set_of(p), set_of(q), percent):
                    name[max(a, b)] = min(a, b)
                    links.append((node[p], node[q]))
            kind = rows.schema.field("node").type
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], kind) for i in (0, 1)], ["a", "b"])

    kind = nodes.schema["node"].dataType.simpleString()
    return blocks.mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose id is among the nodes, and few others, without a shuffle of texts.

    The ids' hashes set bits in at most 2**20 words of 64 bits, which every task gets.
    """
    hashed = lambda c: F.xxhash64(c).alias("hash")
    word, bit = "pmod(hash, 1048576)", "shiftleft(1L, cast(pmod(shiftright(hash, 20), 64) as int))"
    bits = nodes.select(hashed("node")).groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or({bit})").alias("bits"))
    rows = texts.withColumn("hash", F.xxhash64("id")).withColumn("word", F.expr(word))
    return rows.join(F.broadcast(bits), "word").filter(F.expr(f"(bits & {bit}) != 0")).select("id", "text")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, run: int) -> DataFrame:
    """The pairs whose full sets are similar enough.

    The texts of ``a`` travel to the text of ``b``; a ``b`` with many partners is copied to several places, each with
    a bounded number of them. Nothing but one set and the one it is compared with is held.
    """
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    many = counts.filter(F.col("n") > _BLOCK).select("b", F.ceil(F.col("n") / _BLOCK).cast("int").alias("places"))
    many = Workspace(docs.sparkSession).keep(many, "many")  # few, of known size: the pairs stay where they are
    places = F.coalesce("places", F.lit(1))
    members = pairs.join(many, "b", "left").select(
        F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a", "b"), places).cast("int").alias("place"), F.lit(1).alias("role")
    )
    heads = pairs.select("b").distinct().join(many, "b", "left").select(
        F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), places - 1)).alias("place"), F.lit(0).alias("role")
    )
    dealt = members.unionByName(heads)
    rows = _texts_of(docs, dealt.select(F.col("id").alias("node"))).join(dealt, "id").repartition("b", "place").sortWithinPartitions("b", "place", "role")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, place = np.empty(0, np.uint64), None
        for batch in batches:
            texts = utf8(batch.column("text"))
            ids, heads, places, roles = (batch.column(c).to_pylist() for c in ("id", "b", "place", "role"))
            good = []
            for a, b in chunks(texts):
                for i, found in enumerate(shingle_sets(texts[a:b], run), a):
                    if roles[i] == 0:
                        head, place = found, (heads[i], places[i])
                    elif place == (heads[i], places[i]):
                        if _similar(head, found, percent):
                            good.append(i)
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in good], kind), pa.array([heads[i] for i in good], kind)], ["a", "b"]
            )

    kind = docs.schema["id"].dataType.simpleString()
    return rows.select("id", "b", "place", "role", "text").mapInArrow(verify, f"a {kind}, b {kind}").distinct()


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 75,
    run: int = 5,
    banding: Banding = Banding(),
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles`` and ``component_id``, the smallest id of its group."""
    space = Workspace(docs.sparkSession)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = space.keep(described(texts, banding, run), "rows")
    named = rows.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = named.groupBy("digest").agg(
        F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    nodes = space.keep(classes, "nodes")
    members = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "n")
    pairs = space.keep(_star_pairs(members, nodes, banding, percent), "star-pairs")
    links = space.keep(_verified(pairs, texts, percent, run), "star-links")
    roots = connected_components(links, space)
    more = space.keep(_rest_links(members, nodes, roots, texts, banding, percent, run), "rest-links")
    if not more.isEmpty():
        roots = connected_components(links.unionByName(more), Workspace(docs.sparkSession))
    groups = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    # Empty sets share a digest and need no group.
    found = rows.filter("n > 0").select("id", "n", "digest").join(groups, "digest", "left")
    found = found.select("id", "n", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    found = found.unionByName(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def duplicate_report(docs: DataFrame) -> DataFrame:
    """Groups of near-duplicate documents; the smallest id of each stays."""
    return near_duplicates(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))
