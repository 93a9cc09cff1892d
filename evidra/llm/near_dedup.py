"""Near-duplicate detection with DartMinHash signatures and banded joining.

Words are what stands between white space; a text's set is its distinct
runs of five words (all words, if it has fewer), as 64-bit hashes. Darts
are thrown at the plane of weight and rank of each element: cells of the
plane hold a Poisson number of darts, their places and numbers drawn from
hashes of the element, so equal elements get equal darts in every text. A
dart counts where its weight lies below the element's weight in the text
and its rank below a bound chosen so that about k ln k + 2k darts count,
however long the text. Each dart belongs to one of the k coordinates, and
the earliest dart of each is the signature: two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. The
weights of the query are 1, so that is the similarity of the sets.

Texts with equal sets are one node, known by 128 bits of the set's digest.
Nodes that agree in all four coordinates of a band share a bucket; of
buckets with the same members one is kept. All nodes of a bucket are
compared exactly, on their whole sets: one matrix product counts what all
sets of a tile share, and a tile returns one link from each node to the
smallest one that it hangs together with, so no list of pairs is written.

A bucket of more than ``TILE`` nodes is dealt into blocks of about that
many. Each block meets the same ``PIVOTS`` nodes of its bucket first. Nodes
that hang together with the largest group of pivots are done: what else
they are similar to is in that class already, or is itself left over. Those
left over meet all blocks, so that no link between classes is lost, and a
group of m near copies costs about m comparisons with pivots and m for each
one left over, rather than m * m. Components of the links are classes, found
by rounds of joining every node to the smallest in its neighbourhood.

Two texts of similarity 0.8 miss all of the 20 bands with a probability of
3e-5, more similar ones with less.

Defined results: a null text and a text without words have an empty set
and stand alone, each its own class; equal rows are in one class; the
class id is the smallest id in the class, so an id that is null shows only
if no other is there; an empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import byte_batches, cut, drop_cut, field, flat, join_groups, nested

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
BATCH_BYTES = 1 << 20
#: Nodes of a bucket that meet in one block, those that meet every block, and elements whose columns a product takes at a time.
TILE = 256
PIVOTS = 32
COLUMNS = 4096
#: Places that a shared bucket is dealt to where its nodes are looked up.
PLACES = 16
#: Places that a node is dealt to where its neighbours, or the nodes of its class, learn of the smallest one.
HUB_PLACES = 8

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number from each of ``x`` (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... events."""
    top = int(mean + 12 * mean**0.5 + 20)
    logs = -mean + np.arange(top) * np.log(mean) - np.cumsum(np.log(np.maximum(np.arange(top), 1)))
    return np.cumsum(np.exp(logs))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, k: int) -> np.ndarray:
    """Signatures of ``texts`` weighted sets as 32-bit numbers, one row each.

    ``elements``, ``weights`` (above 0) and ``owner`` (the set's number)
    are parallel. Sets without elements get a row of zeros.
    """
    signature = np.zeros((texts, k), dtype=np.uint32)
    norm = np.bincount(owner, weights=weights, minlength=texts)
    todo = np.flatnonzero(norm > 0)
    darts = k * np.log(k) + 2 * k
    with np.errstate(over="ignore"):
        while len(todo):
            chosen = np.zeros(texts, dtype=bool)
            chosen[todo] = True
            mine = chosen[owner]
            best = _throw(elements[mine], weights[mine], owner[mine], np.divide(darts, norm, out=np.zeros(texts), where=chosen), texts, k)
            full = (best[todo] != np.iinfo(np.uint64).max).all(axis=1)
            signature[todo[full]] = best[todo[full]].astype(np.uint32)  # the low half names the dart
            todo, darts = todo[~full], darts * 2  # a coordinate without a dart: look further
    return signature


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, bound: np.ndarray, texts: int, k: int) -> np.ndarray:
    """Per set and coordinate: rank (high half) and name (low half) of the earliest dart below the bound."""
    best = np.full(texts * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    most, scale = float(bound.max()), bound[owner]
    w_lo, w_hi, w_cell = 0.0, 1.0, 1
    while w_lo < float(weights.max()):
        heavy = weights > w_lo
        r_lo, r_hi, r_cell = 0.0, 1.0, 1
        while r_lo < most:
            near = np.flatnonzero(heavy & (scale > r_lo))
            steps = _poisson_steps((w_hi - w_lo) * (r_hi - r_lo))
            for part in np.array_split(near, max(1, int(len(near) * (r_hi - r_lo) / 2_000_000))):
                seed = mix64(elements[part] + _U(0x9E3779B97F4A7C15) * _U(w_cell * 1000 + r_cell))
                number = np.searchsorted(steps, _unit(mix64(seed ^ _U(0xD1B54A32D192ED03))), side="right")
                which = np.repeat(np.arange(len(part)), number)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
                dart = mix64(seed[which] + (nth.astype(np.uint64) + _U(1)) * _U(0xA24BAED4963EE407))
                rank = r_lo + (r_hi - r_lo) * _unit(mix64(dart ^ _U(0x8CB92BA72F3D8DD7)))
                source = part[which]
                counts = rank < scale[source]
                if w_cell > 1 or float(weights.min()) < 1:
                    counts &= w_lo + (w_hi - w_lo) * _unit(mix64(dart ^ _U(0x2545F4914F6CDD1D))) < weights[source]
                dart, rank, source = dart[counts], rank[counts], source[counts]
                place = owner[source] * k + ((dart >> _U(33)) % _U(k)).astype(np.int64)
                order = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)  # positive floats sort as integers
                np.minimum.at(best, place, order | (dart & _U(0xFFFFFFFF)))
            r_lo, r_hi, r_cell = r_hi, r_hi * 2, r_cell + 1
        w_lo, w_hi, w_cell = w_hi, w_hi * 2, w_cell + 1
    return best.reshape(texts, k)


def shingle_sets(texts: pa.Array, words_each: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of words of every text, sorted within the text, and where each text begins."""
    clean = pc.ascii_trim_whitespace(texts)
    split = pc.split_pattern_regex(clean, "[\\x20\\x09-\\x0D]+")
    words = split.flatten().dictionary_encode()
    known = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    hashes = known[words.indices.to_numpy()]
    starts = split.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    numbers = np.diff(starts)
    numbers[pc.equal(clean, "").to_numpy(zero_copy_only=False)] = 0
    with np.errstate(over="ignore"):
        runs = np.zeros(len(hashes), dtype=np.uint64)
        for i in range(words_each):
            runs[: len(hashes) - i] = runs[: len(hashes) - i] * _U(0x9E3779B97F4A7C15) + mix64(hashes[i:] + _U(i + 1))
        runs = mix64(runs)
        sets, begins = [], [0]
        for start, n in zip(starts, numbers, strict=False):
            if n >= words_each:
                sets.append(np.unique(runs[start : start + n - words_each + 1]))
            elif n:
                value = _U(n)
                for h in hashes[start : start + n]:
                    value = value * _U(0x9E3779B97F4A7C15) + mix64(np.array([h]))[0]
                sets.append(mix64(np.array([value])))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
            begins.append(begins[-1] + len(sets[-1]))
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), np.array(begins, dtype=np.int64)


def sketch(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, node (128 bits of the set's digest; null for an empty set), signature, and the set as 4-byte hashes."""
    k = bands * rows
    given = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            elements, begins = shingle_sets(batch["text"])
            sizes = np.diff(begins)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            signature = dart_signatures(elements, np.ones(len(elements)), owner, len(sizes), k)
            nodes, sets = [], []
            for start, stop in zip(begins[:-1], begins[1:], strict=True):
                own = elements[start:stop]
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                sets.append(np.unique((own >> _U(32)).astype(np.uint32)).tobytes())
            flat = pa.FixedSizeListArray.from_arrays(pa.array(signature.ravel().view(np.int32)), k).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(nodes, pa.binary()), flat, pa.array(sets, pa.binary())], names=["doc_id", "node", "signature", "shingles"])

    return given.mapInArrow(run, f"doc_id {id_type}, node binary, signature array<int>, shingles binary")


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of ``left`` shares with each of ``right`` (numbers into ``sets``)."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1  # others are shared with no one
    column = np.cumsum(often) - 1
    keep = often[code]
    owner, code = owner[keep], column[code[keep]]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for start in range(0, int(often.sum()), COLUMNS):
        part = slice(*np.searchsorted(code, [start, start + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        has[owner[part], code[part] - start] = 1
        out += has[left] @ has[right].T
    return out


def tile_groups(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Per set the number of the first one that it hangs together with.

    Links are looked for between the sets of ``side`` 0 and those of side
    1, or among all sets if every side is 0.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.float32)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    alike = np.zeros((len(sets), len(sets)), dtype=bool)
    if len(left) and len(right):
        both = _shared(sets, left, right)
        alike[np.ix_(left, right)] = both >= similarity * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-3
        alike |= alike.T
    group = np.full(len(sets), -1)
    for root in range(len(sets)):
        if group[root] < 0:
            group[root], stack = root, [root]
            while stack:
                new = np.flatnonzero(alike[stack.pop()] & (group < 0))
                group[new] = root
                stack += new.tolist()
    return group


def _star(nodes: list[bytes], group: np.ndarray) -> list[tuple[bytes, bytes]]:
    """A link from the smallest node of every group to each other one."""
    least: dict[int, bytes] = {}
    for g, node in zip(group.tolist(), nodes, strict=True):
        least[g] = min(node, least.get(g, node))
    return list(dict.fromkeys((least[g], node) for g, node in zip(group.tolist(), nodes, strict=True) if node != least[g]))


def _left_over(nodes: list[bytes], pivot: np.ndarray, group: np.ndarray) -> list[bytes]:
    """Nodes that do not hang together with the largest group of pivots, which is the same in all blocks of a bucket.

    Pivots are grouped by the links among themselves only, as other links
    differ from block to block; the first of equally large groups counts,
    by its smallest node.
    """
    return sorted({n for n, g in zip(nodes, group.tolist(), strict=True) if g != group[pivot]} - {nodes[pivot]})


def compare_tiles(tiles: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within tiles of (bucket, i, j, side, node, pivot), and rows (a, null, bucket) for nodes left over.

    Sides are as in ``tile_groups``. A tile with pivots compares all its
    nodes; nodes left over are told of such tiles only.
    """
    key = ["bucket", "i", "j"]
    filled = tiles.join(sets.hint("merge"), "node").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            yield from links_of(table, False)
            held = tail_of(table)
        if held is not None:
            yield from links_of(held, True)

    def edges_of(table: pa.Table) -> np.ndarray:
        keys = [table[c].to_numpy() for c in key]
        change = np.zeros(len(table), dtype=bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(change)

    def tail_of(table: pa.Table) -> pa.Table:
        return table.slice(int(edges_of(table)[-1])).combine_chunks() if len(table) else table

    def links_of(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """The links of all tiles that are whole: the last one may go on in the next batch."""
        if not len(table):
            return
        edges = np.r_[edges_of(table), len(table)]
        bucket, side, pivot = table["bucket"].to_numpy(), table["side"].to_numpy(), table["pivot"].to_numpy()
        nodes, column = table["node"].to_pylist(), table["shingles"].combine_chunks()
        found: list[tuple[bytes, bytes | None, int | None]] = []
        for start, stop in zip(edges[:-1], edges[1:] if last else edges[1:-1], strict=False):
            own = [np.frombuffer(column[i].as_buffer(), dtype=np.uint32) for i in range(start, stop)]
            group = tile_groups(own, side[start:stop], similarity)
            found += [(a, b, None) for a, b in _star(nodes[start:stop], group)]
            main = np.flatnonzero(pivot[start:stop])
            if len(main):
                # the largest group of pivots by their own links
                among = tile_groups([own[i] for i in main], np.zeros(len(main), dtype=int), similarity)
                names = [nodes[start + i] for i in main]
                chief = max(range(len(main)), key=lambda i: (int((among == among[i]).sum()), [-x for x in names[i]]))
                found += [(n, None, int(bucket[start])) for n in _left_over(nodes[start:stop], int(main[chief]), group)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "bucket"])

    return filled.mapInArrow(run, "a binary, b binary, bucket long")


def find_links(buckets: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Distinct links (lo, hi), lo < hi, that connect all similar nodes of each bucket of ``buckets`` (bucket, node), as a written table.

    ``sets_of`` gives (node, shingles) for a relation of nodes.
    """
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64(F.lit(2), "node")).alias("x"), F.expr("bit_xor(xxhash64(node))").alias("y"), F.expr("bit_xor(xxhash64(1, node))").alias("z")).filter("n > 1")
    # buckets with the same members are compared once
    sizes = cut(sizes.groupBy("n", "x", "y", "z").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "tiles")
    many = sizes.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    dealt = buckets.withColumn("place", F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(PLACES)).cast("int"))
    members = dealt.join(many.hint("merge"), ["bucket", "place"]).drop("place")
    members = cut(members.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")), "members")
    sets = cut(sets_of(members.select("node").distinct()), "sets")
    side = lambda n, pivot: (F.lit(n).alias("side"), F.lit(pivot).alias("pivot"))
    whole = members.select("node", "bucket", F.col("block").alias("i"), F.lit(0).alias("j"), *side(0, False))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(3), "node"), "node"))
    pivots = members.filter("blocks > 1").withColumn("nth", nth).filter(F.col("nth") <= PIVOTS)
    pivots = pivots.select("node", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), *side(0, True))
    first = cut(compare_tiles(whole.unionByName(pivots), sets, similarity), "found")
    rest = first.filter("b IS NULL").select(F.col("a").alias("node"), "bucket").distinct()
    links = first.filter("b IS NOT NULL").select("a", "b")
    if not rest.isEmpty():
        rest = cut(rest, "rest")
        parts = cut(rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts")).join(sizes, "bucket"), "parts")
        lone = rest.join(parts, "bucket").withColumn("j", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int"))
        lone = lone.select("node", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "j", *side(0, False))
        others = members.join(parts.select("bucket", "parts"), "bucket")
        others = others.select("node", "bucket", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), *side(1, False))
        links = links.unionByName(compare_tiles(lone.unionByName(others), sets, similarity).select("a", "b"))
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    drop_cut(sizes, members, sets, first)
    return edges


def _nearest(edges: DataFrame) -> DataFrame:
    """One round of joining nodes to the smallest in their neighbourhood; ``edges`` (lo, hi) are distinct and lo < hi."""
    both = edges.select(F.col("hi").alias("at"), F.col("lo").alias("to")).unionByName(edges.select(F.col("lo").alias("at"), F.col("hi").alias("to")))
    least = both.groupBy("at").agg(F.min("to").alias("least")).select("at", F.least("at", "least").alias("least"))
    # every larger neighbour goes to the smallest one, then all smaller ones do
    # the root of a large class has a neighbour for each of its nodes: dealt by these
    far = both.filter("to > at").withColumn("deal", F.xxhash64("to"))
    large = join_groups(far, least, "at", "deal", HUB_PLACES).select(F.col("least").alias("lo"), F.col("to").alias("hi")).distinct()
    root = large.groupBy("hi").agg(F.min("lo").alias("least"))
    small = large.join(root.hint("merge"), "hi").filter("lo <> least").select(F.col("least").alias("lo"), F.col("lo").alias("hi"))
    return small.unionByName(root.select(F.col("least").alias("lo"), "hi")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of ``edges`` that is not itself the smallest.

    ``edges`` is what ``find_links`` wrote, and goes. A round is one written
    table; rounds end when a round changes nothing, so that all links lead
    to roots.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(lo, hi))"), F.expr("bit_xor(xxhash64(1, lo, hi))")).first()
    before = state(edges)
    while before[0]:
        new = cut(_nearest(edges), "edges")
        drop_cut(edges)
        edges, after = new, state(new)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def near_dedup(documents: DataFrame, similarity: float = SIMILARITY, text: str = "text", doc_id: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept (whether it has the class's id)."""
    drawn = cut(sketch(documents, text, doc_id, bands, rows), "sketches")
    named = drawn.filter("node IS NOT NULL")
    # the smallest id, nulls last, and the number of rows of every node
    nodes = cut(named.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least"), F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature")), "nodes")
    band = lambda i: F.struct(F.lit(i).alias("i"), F.slice("signature", i * rows + 1, rows).alias("s"))
    buckets = nodes.select("node", F.explode(F.array(*(F.xxhash64(band(i)) for i in range(bands)))).alias("bucket"))

    def sets_of(some: DataFrame) -> DataFrame:
        # one row of a node gives its set: a row with the smallest id; merged at every size, as a broadcast that only small inputs allow would hide what large ones move
        first = nodes.select("node", F.col("least.doc_id").alias("first_id")).join(some.hint("merge"), "node", "left_semi").withColumnRenamed("node", "of")
        found = named.join(first.hint("merge"), (named["node"] == first["of"]) & named["doc_id"].eqNullSafe(first["first_id"]))
        return found.select("node", "shingles").dropDuplicates(["node"])

    roots = components(find_links(buckets, sets_of, similarity))
    # nodes that hang together with others; all others are classes of their own
    grouped = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    named_nodes = nodes.select("node", "least", "n")
    mine = named_nodes.join(grouped.hint("merge"), "node")
    per_root = mine.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("class_size"))
    shared = join_groups(mine.select("node", "root", F.xxhash64("node").alias("deal")), per_root, "root", "deal", HUB_PLACES)
    others = named_nodes.join(grouped.select("node").hint("merge"), "node", "left_anti").select("node", "least", F.col("n").alias("class_size"))
    classes = cut(shared.select("node", "least", "class_size").unionByName(others).select("node", F.col("least.doc_id").alias("class_id"), "class_size"), "classes")
    drop_cut(nodes)
    out = drawn.select("doc_id", "node").join(classes.hint("merge"), "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def drop_near_copies(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each class, with its columns; documents without words all stay."""
    stay = near_dedup(documents, text=text, doc_id=doc_id).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    rows = nested(documents)
    return flat(rows.join(stay.hint("merge"), field(doc_id).eqNullSafe(stay["id"]), "left_semi"), documents.columns)
