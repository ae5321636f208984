"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle of a text is hashed into one of ``COORDS``
bins with the value i + h_i. Rounds go on until all bins are filled; from round
COORDS on, round i fills bin i - COORDS from all shingles, so every coordinate
fills. Two texts agree in each coordinate with their Jaccard similarity as
probability, and the agreement of COORDS coordinates is concentrated about it.

Texts with equal shingle sets are one class from the start, so copies cost
nothing below. Bands of coordinates propose class pairs:

1. star: each class is paired with the least class of each of its buckets (so
   pairs grow with the rows, not with the square of a bucket);
2. neighbours: in buckets that hold several components, cut into random blocks
   of about BLOCK sketches, each class is paired with its most similar one of
   another component; this is repeated while it finds links;
3. rest: in buckets that still hold several components, all classes outside the
   main component are compared with all others, in blocks.

Pairs whose sketches or set sizes rule a link out (by more than five standard
deviations, or exactly) are dropped, all others are verified on the full
shingle sets of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm import textnum
from threadlens.llm.components import connected_components
from threadlens.llm.staging import bound_batches, stage, thinned, unstage

SHINGLE = 5
#: The bands share out the coordinates; all of them estimate the similarity.
COORDS = 504
BLOCK = 256
GROUP_ROWS = 4096
NEIGHBOUR_ROUNDS = 4
#: Another round of neighbours follows one that found a link for every so many classes.
WORTHWHILE = 4


@dataclass(frozen=True)
class Link:
    """What links two texts: a Jaccard similarity of ``percent`` or more."""

    percent: int
    rows: int  # coordinates of a band

    @property
    def bands(self) -> int:
        return COORDS // self.rows

    @property
    def agree(self) -> int:
        """Least number of agreeing sketch bytes: the expected one less five deviations."""
        return int(COORDS * self.percent / 100 - 5 * (COORDS * self.percent * (100 - self.percent)) ** 0.5 / 100)


#: By percent: a pair at the least similarity shares no band with a probability of 4e-7 and 9e-6.
LINKS = {85: Link(85, 9), 80: Link(80, 8)}

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64((1 << 40) - 1)
_SEEDS = textnum.mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(chunk: textnum.Chunk) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    starts, ends, offsets = textnum.words(chunk, textnum.NOT_SPACE)
    hashes = textnum.word_hashes(chunk, starts, ends)
    all_shingles = textnum.shingle_hashes(hashes, SHINGLE) if len(hashes) >= SHINGLE else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(all_shingles[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(textnum.shingle_hashes(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Documents x COORDS; a document without shingles keeps empty bins."""
    n = len(sets)
    out = np.full(n * COORDS, _EMPTY)
    items = np.concatenate([np.zeros(0, np.uint64), *sets])
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    unfilled = np.array([len(s) > 0 for s in sets], bool)
    for i in range(2 * COORDS):
        if not len(items):
            break
        x = textnum.mix(items ^ _SEEDS[i])
        value = np.uint64(i << 40) | (x & _LOW)
        if i < COORDS:
            at = doc * COORDS + (((x >> np.uint64(32)) * np.uint64(COORDS)) >> np.uint64(32)).astype(np.int64)
        else:
            at = doc * COORDS + (i - COORDS)
        free = out[at] == _EMPTY
        np.minimum.at(out, at[free], value[free])
        unfilled &= (out.reshape(n, COORDS) == _EMPTY).any(axis=1)
        keep = unfilled[doc]
        if not keep.all():
            items, doc = items[keep], doc[keep]
    return out.reshape(n, COORDS)


def band_keys(sketches: np.ndarray, link: Link) -> np.ndarray:
    """Documents x bands."""
    key = np.tile(_SEEDS[: link.bands], (len(sketches), 1))
    for r in range(link.rows):
        key = textnum.mix(key * np.uint64(0xD6E8FEB86659FD93) + sketches[:, r :: link.rows])
    return key


def _sketch_rows(link: Link, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in textnum.chunks(batch.column(3)):
            sets = shingle_sets(chunk)
            sketches = sketch(sets)
            size = np.array([len(s) for s in sets], np.int64)
            none = size == 0
            digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            short = textnum.mix(sketches).astype(np.uint8)
            keys = band_keys(sketches, link).view(np.int64)
            # A null list must be an empty range: the one before it ends where the next valid one starts.
            ends = np.append(0, np.cumsum(np.where(none, 0, link.bands))).astype(np.int32)
            keyed = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)), pa.array(keys[~none].ravel()))
            part = batch.slice(chunk.first, len(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(i) for i in range(3)), pa.array(size), pa.array(digests, pa.binary(), mask=none),
                    pa.array([s.tobytes() for s in short], pa.binary(), mask=none), keyed,
                ],
                ["doc_id", "t1", "t2", "n", "class", "sketch", "keys"],
            )


def _low_halves(link: Link, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, keys of all bands, as four bytes each."""
    for batch in batches:
        keys = batch.column(batch.num_columns - 1).flatten().to_numpy().view(np.uint64)
        packed = (keys & np.uint64(0xFFFFFFFF)).astype("<u4").reshape(-1, link.bands)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns + [pa.array([x.tobytes() for x in packed], pa.binary())], ["class", "rep", "n", "t1", "t2", "sketch", "bands"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t1, t2, text): t1 and t2 name the text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))


def _agreeing(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COORDS) for c in (a, b))
    return (x == y).sum(axis=1)


def _could_link(link: Link, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            keep = pa.array(_agreeing(batch.column(2), batch.column(3)) >= link.agree)
            yield batch.filter(keep).select([0, 1])


def _sizes_could_link(link: Link, a: str, b: str):
    small, large = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    return small * 100 >= large * link.percent


def _star_pairs(link: Link, buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): each class and the least class of each of its buckets (key, class, n, a, na, m)."""
    pairs = buckets.filter(_sizes_could_link(link, "n", "na")).select("a", F.col("class").alias("b")).distinct()
    a = classes.select(F.col("class").alias("a"), F.col("sketch").alias("sa"))
    b = classes.select(F.col("class").alias("b"), F.col("sketch").alias("sb"))
    joined = pairs.join(b, "b").join(a, "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(partial(_could_link, link), "a binary, b binary")


def _block_arrays(table: pa.Table) -> tuple:
    key = table.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    table, key = table.take(pa.array(order)), key[order]
    roots = np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)[1] if len(key) else key
    sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDS)
    edges = np.flatnonzero(np.diff(key)) + 1
    runs = list(zip([0, *edges.tolist()], [*edges.tolist(), len(key)]))
    return table, key, roots, table.column("n").to_numpy(), sketches, runs


def _partners(link: Link, i: int, others: np.ndarray, roots: np.ndarray, n: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``others`` in other components that could be linked with i, and their agreement."""
    others = others[(roots[others] != roots[i]) & (np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * link.percent)]
    agree = (sketches[others] == sketches[i]).sum(axis=1) if len(others) else np.zeros(0, np.int64)
    return others[agree >= link.agree], agree[agree >= link.agree]


def _pair_table(found: set, table: pa.Table) -> pa.Table:
    classes = table.column("class").to_pylist()
    pairs = sorted((min(classes[i], classes[j]), max(classes[i], classes[j])) for i, j in found)
    return pa.table([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def _nearest(link: Link, table: pa.Table) -> pa.Table:
    """Each class's best partner in another component of its blocks."""
    table, _, roots, n, sketches, runs = _block_arrays(table)
    found = set()
    for first, last in runs:
        for i in range(first, last):
            who, agree = _partners(link, i, np.arange(first, last), roots, n, sketches)
            if len(who):
                found.add(tuple(sorted((i, int(who[np.argmax(agree)])))))
    return _pair_table(found, table)


def _all_partners(link: Link, table: pa.Table) -> pa.Table:
    """All pairs of different components; of different sides where there are
    sides. A pair is made in the bucket of its first common band alone."""
    table, key, roots, n, sketches, runs = _block_arrays(table)
    side = table.column("side").to_numpy()
    bands = np.frombuffer(b"".join(table.column("bands").to_pylist()), "<u4").reshape(-1, link.bands)
    found = set()
    for first, last in runs:
        for i in range(first, last):
            rest = np.arange(i + 1, last)
            rest = rest[(side[i] == 0) | (side[rest] != side[i])]
            who = _partners(link, i, rest, roots, n, sketches)[0]
            first_band = np.argmax(bands[who] == bands[i], axis=1)
            here = bands[i][first_band] == np.uint32(int(key[first]) & 0xFFFFFFFF)
            found |= {(i, j) for j in who[here].tolist()}
    return _pair_table(found, table)


def _mixed(buckets: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, class, m, root) of the buckets (key, class, m) with several
    components, and (key, m, main, rest) of these: size, largest component and
    number of other classes.

    A bit table tells these buckets, so their rows don't meet in a join. It may
    let others pass: they have one component, so nothing in them is compared.
    """
    labelled = buckets.join(roots.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "m", F.coalesce("root", "class").alias("root"))
    labelled = stage(labelled, "labelled-buckets")
    sizes = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("top")).filter("m > top.n")
    mixed = stage(mixed.select("key", "m", F.col("top.root").alias("main"), (F.col("m") - F.col("top.n")).alias("rest")), "mixed-buckets")
    rows = stage(thinned(labelled, mixed, "key"), "mixed-rows")
    unstage(labelled)
    return rows, mixed


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (key, class, root, ...) with the columns of ``classes``.

    A class is in a bucket for each of its bands at most, so its buckets are one
    short list; the sketches join once per class, not once per bucket.
    """
    own = rows.groupBy("class", "root").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("class", "root")])).alias("own"))
    return own.join(classes, "class").select("class", "root", *[c for c in classes.columns if c != "class"], F.inline("own"))


def _near_roots(links: DataFrame) -> DataFrame:
    """(node, root): a node's least neighbour's least neighbour. Nodes with one
    root are of one component; the opposite needn't hold."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
    least = stage(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("near")), "least-neighbours")
    onward = least.select(F.col("node").alias("near"), F.col("near").alias("root"))
    return least.join(onward, "near").select("node", "root")


def _grouped(rows: DataFrame, small: int, function) -> DataFrame:
    """Blocks of one bucket are groups of their own; the ``small`` rows of small buckets share groups of about GROUP_ROWS rows."""
    groups = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-small // GROUP_ROWS))))
    rows = rows.withColumn("x", F.when(F.col("i") < 0, groups).otherwise(F.col("key")))
    return rows.groupBy("x", "i", "j").applyInArrow(function, "a binary, b binary").distinct()


def _neighbour_pairs(link: Link, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): within random blocks of the mixed buckets (key, class, m, root), each class and its best partner."""
    small = rows.filter(F.col("m") <= BLOCK).count()
    rows = _with_classes(rows, classes.select("class", "n", "sketch"))
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    own = F.when(F.col("m") <= BLOCK, -1).otherwise(F.pmod(F.xxhash64("class", "key"), blocks).cast("int"))
    rows = rows.select("key", "class", "root", "n", "sketch", own.alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    return _grouped(rows, small, lambda table: _nearest(link, table))


def _rest_pairs(link: Link, rows: DataFrame, mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): all possible links between components that share a mixed bucket, compared in blocks.

    Of a large bucket, the classes outside its main component meet each other
    in pairs of blocks, and meet every block of the main component; the main
    component's classes don't meet each other.
    """
    small = rows.filter(F.col("m") <= BLOCK)
    large = rows.filter(F.col("m") > BLOCK).join(mixed.filter(F.col("m") > BLOCK).select("key", "main", "rest"), "key")
    spread = _with_classes(small.unionByName(large, allowMissingColumns=True), classes.select("class", "n", "sketch", "bands"))
    half = F.lit(BLOCK // 2)
    parts = F.greatest(F.ceil(F.col("rest") / half), F.lit(1)).cast("int")
    blocks = F.greatest(F.ceil((F.col("m") - F.col("rest")) / half), F.lit(1)).cast("int")
    part, block = (F.pmod(F.xxhash64("class"), n).cast("int") for n in (parts, blocks))

    def place(i, j, side):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side"))

    def beside(other):
        side = F.when(part == other, 0).when(part < other, 1).otherwise(2)
        return place(F.least(part, other), F.greatest(part, other), side)

    # Groups of the main component are told from pairs of blocks by i beyond any part.
    beyond = F.lit(1 << 30)
    outside = F.concat(
        F.transform(F.sequence(F.lit(0), parts - 1), beside),
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: place(other + beyond, part, 1)),
    )
    within = F.transform(F.sequence(F.lit(0), parts - 1), lambda other: place(block + beyond, other, 2))
    places = F.when(F.col("m") <= BLOCK, F.array(place(F.lit(-1), F.lit(-1), 0))).when(F.col("root") == F.col("main"), within).otherwise(outside)
    spread = spread.select("key", "class", "root", "n", "sketch", "bands", F.inline(places))
    return _grouped(spread, small.count(), lambda table: _all_partners(link, table))


def _verified(link: Link, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose texts' full shingle sets are similar enough."""
    last_text, last_set = None, None
    for batch in batches:
        for part in (batch.slice(at, 64) for at in range(0, len(batch), 64)):
            keep = []
            other = [s for chunk in textnum.chunks(part.column(3)) for s in shingle_sets(chunk)]
            for text, y in zip(part.column(2).to_pylist(), other):
                if text != last_text:
                    last_text = text
                    (chunk,) = textnum.chunks(pa.array([text]))
                    (last_set,) = shingle_sets(chunk)
                both = len(np.intersect1d(last_set, y, assume_unique=True))
                keep.append(100 * both >= link.percent * (len(last_set) + len(y) - both))
            yield part.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _verify(link: Link, pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, checked on the texts."""
    pairs = stage(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    names = stage(classes.select("class", "t1", "t2").join(wanted, "class"), "wanted-classes")
    found = stage(thinned(texts, names, "t1").join(names, ["t1", "t2"]).groupBy("class").agg(F.first("text").alias("text")), "wanted-texts")
    a, b = (found.select(F.col("class").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    # Rows of one a lie together, so its set is made once.
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    links = stage(joined.mapInArrow(partial(_verified, link), "a binary, b binary"), "verified")
    for used in (pairs, names, found):
        unstage(used)
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, with_group: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, links, t1, t2.

    ``percent`` is the similarity of a link, one of LINKS.

    ``links`` counts the row's class's verified links to other classes of the
    proposed pairs; (t1, t2) names the row's text. Each row is judged by its
    own text. A null or empty text, or one of white space only, has no
    shingles and is linked with nothing: its component is its own id. A row
    with a null id can be linked, but an id of its component is never null
    unless all are; it is kept only if its component has no id. Rows that
    repeat an id and text share one fate. An empty table gives no rows.
    ``with_group`` adds the binary ``near_group`` that names the row's component
    even if that has no id; it is null for a text without shingles.
    """
    link = LINKS[percent]
    texts = _keyed(bound_batches(docs), id_col, text_col)
    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = stage(
        texts.mapInArrow(partial(_sketch_rows, link), f"doc_id {id_type}, t1 long, t2 long, n long, class binary, sketch binary, keys array<long>"),
        "sketches",
    )
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min(F.struct("t1", "t2")).alias("t"),
        F.first("sketch").alias("sketch"), F.first("keys").alias("keys"),
    )
    classes = stage(classes.select("class", "rep", "n", "t.t1", "t.t2", "sketch", "keys"), "classes")
    names = stage(rows.select("doc_id", "t1", "t2", "n", "class"), "named-rows")
    unstage(rows)
    buckets = classes.select("class", "n", F.explode("keys").alias("key"))
    # Most keys have one class; they are counted by their numbers alone, and their rows don't move.
    repeated = stage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key"), "repeated-keys")
    buckets = stage(thinned(buckets, repeated, "key"), "repeated-buckets")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("class", "n")).alias("least")).filter("m > 1")
    shared = stage(shared.select("key", "m", F.col("least.class").alias("a"), F.col("least.n").alias("na")), "shared-keys")
    buckets = stage(buckets.join(shared, "key").filter("class <> a"), "buckets")
    content = texts.select("t1", "t2", "text")
    links = _verify(link, _star_pairs(link, buckets, classes), classes, content)
    # The least class of a bucket has met all others; two more make a pair that hasn't met.
    buckets = buckets.filter("m > 2").select("key", "class", (F.col("m") - 1).alias("m"))
    # The low half of each band's key tells which band two classes share first.
    low = partial(_low_halves, link)
    packed = stage(
        classes.select("class", "rep", "n", "t1", "t2", "sketch", "keys").mapInArrow(
            low, f"class binary, rep {id_type}, n long, t1 long, t2 long, sketch binary, bands binary"
        ),
        "classes-packed",
    )
    unstage(classes)
    classes = packed
    many, roots = classes.count() // WORTHWHILE, _near_roots(links)
    for _ in range(NEIGHBOUR_ROUNDS):
        # Components only grow together, so a bucket of one component stays so: later rounds needn't read it.
        mixed_rows, _ = _mixed(buckets, roots)
        buckets = mixed_rows.drop("root")
        more = _verify(link, _neighbour_pairs(link, mixed_rows, classes), classes, content)
        links = stage(links.unionByName(more), "links-so-far")
        roots = connected_components(links)
        if more.count() <= many:
            break
    rest = _verify(link, _rest_pairs(link, *_mixed(buckets, roots), classes), classes, content)
    links = stage(links.unionByName(rest).distinct(), "all-links")
    if not rest.isEmpty():
        roots = connected_components(links)
    roots = roots.withColumnRenamed("node", "class")
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    labelled = stage(
        classes.select("class", "rep").join(roots, "class", "left").join(degree, "class", "left")
        .select("class", "rep", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links")),
        "class-roots",
    )
    least = stage(labelled.groupBy("root").agg(F.min("rep").alias("component_id")), "component-ids")
    by_class = stage(labelled.join(least, "root").select("class", "component_id", "links", "root"), "class-components")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (
        names.join(by_class, "class", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
            F.col("doc_id").eqNullSafe(component).alias("kept"),
            F.coalesce("links", F.lit(0)).cast("long").alias("links"), "t1", "t2",
            *([F.col("root").alias("near_group")] if with_group else []),
        )
    )
