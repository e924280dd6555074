"""Operator 9: near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has BANDS * ROWS coordinates. In round i each element of a set falls into a hashed bin with
a hashed value; a bin keeps the least value of the first round that reached it; from round
BANDS * ROWS on, round i sends every element to bin i - BANDS * ROWS, so every coordinate is filled.
Equal coordinates of two sets estimate their similarity with the concentration of full sampling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesnp as B
from . import common as C
from .components import merged

#: At a similarity of 0.8 a pair shares no band with a chance of (1 - 0.8 ** 6) ** 40, under 6e-6.
BANDS, ROWS = 40, 6
#: Bytes of text sketched at once.
CHUNK = 1 << 20
#: The first round takes one centre for each bucket, round r + 1 takes CENTRES ** r.
CENTRES = 64
#: Pairs that one copy of a centre's set is for, and shares in which the rows of a node are dealt out.
PAIRS, SALTS = 512, 16
#: Bits of the map of a set that later rounds hold pairs against before their sets, and words of its folded form.
MAP_BITS, FOLDED = 4096, 16
#: In later rounds the n members, or centres, of a bucket are dealt out in the root of n / CELL shares.
CELL = 128
#: Pairs that a last task of the verification is for, about.
TASK_PAIRS = 2000
FOLDS = [f"f{i}" for i in range(FOLDED)]
_ALL = B.U(0xFFFFFFFFFFFFFFFF)
_GOLD = B.U(0x9E3779B97F4A7C15)
_SOLID = ~B.SPACE


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct `width`-word shingles, rows together and in order, and how many each row has.

    A-Z lowered; a text of fewer words has its whole sequence as one; one without words has none.
    """
    n = len(offs) - 1
    w = B.words(B.LOWER[data], offs, _SOLID)
    words = np.bincount(w.doc, minlength=n)
    first = np.cumsum(words) - words
    h = B.mix(w.hash + _GOLD)
    for k in range(1, width):
        h = B.mix(h[: max(0, len(w.hash) - k)] * _GOLD + w.hash[k:])
    parts, counts = [], np.zeros(n, np.int64)
    for i in range(n):
        if words[i] >= width:
            x = h[first[i] : first[i] + words[i] - width + 1].copy()
            x.sort()
            x = x[np.r_[True, x[1:] != x[:-1]]]
        elif words[i]:
            x = B.mix(w.hash[first[i] : first[i] + 1] + _GOLD)
            for y in w.hash[first[i] + 1 : first[i] + words[i]]:
                x = B.mix(x * _GOLD + y)
            x = B.mix(x + B.U(int(words[i])))
        else:
            continue
        counts[i] = len(x)
        parts.append(x)
    return (np.concatenate(parts) if parts else np.zeros(0, B.U)), counts


def sketches(x: np.ndarray, counts: np.ndarray, t: int) -> np.ndarray:
    """t filled coordinates for each nonempty set; all ones for an empty one."""
    n = len(counts)
    out = np.full(n * t, _ALL, B.U)
    doc = np.repeat(np.arange(n), counts)
    missing = np.where(counts > 0, t, 0)
    for i in range(2 * t):
        active = missing > 0
        if not active.any():
            break
        if i and not active.all():
            on = active[doc]
            x, doc = x[on], doc[on]
        h = B.mix(x + B.times(i + 1))
        if i < t:
            at = doc * t + ((h >> B.U(32)) * B.U(t) >> B.U(32)).astype(np.int64)
        else:
            at = doc * t + (i - t)
        free = out[at] == _ALL
        at, v = at[free], B.mix(h[free] + B.U(i)) >> B.U(1)  # under all ones
        np.minimum.at(out, at, v)
        filled = np.unique(at)
        missing = missing - np.bincount(filled // t, minlength=n)
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(B.seeded(bands, 9), parts.shape[:2])
    for k in range(rows):
        key = B.mix(key * _GOLD + parts[:, :, k])
    return key


def _reachable(percent: int):
    """Whether the maps leave it possible that two sets are similar enough: exact, it never rules out such a pair.

    A bit that only one map has stands for an element that the other set lacks, so with u bits in
    either map a set of n elements has at most n - (u - bits of the other map) in common. The folded
    maps come first: their words are columns, which compiled code compares without arrays.
    """

    def enough(u, on, xon):
        most = F.least(F.col("n") - u + F.col(xon), F.col("xn") - u + F.col(on))
        return 100 * most >= percent * (F.col("n") + F.col("xn") - most)

    either = lambda x, y: F.bit_count(x.bitwiseOR(y))
    folded = sum((either(F.col(f"f{i}"), F.col(f"xf{i}")) for i in range(1, FOLDED)), either(F.col("f0"), F.col("xf0")))
    full = F.aggregate(F.zip_with("map", "xmap", either), F.lit(0), lambda s, v: s + v)
    return enough(folded, "fon", "xfon") & enough(full, "on", "xon")


def set_maps(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sets, MAP_BITS / 64) words; an element sets the bit that its hash names."""
    on = np.zeros((len(counts), MAP_BITS), np.uint8)
    on[np.repeat(np.arange(len(counts)), counts), (B.mix(x + _GOLD) >> B.U(32)) % B.U(MAP_BITS)] = 1
    return np.packbits(on, axis=1).view(B.U)


def _mapped_bits(sets: DataFrame) -> DataFrame:
    """node, map, on: the map of each set and how many bits it has; f0, f1, ... and fon: the same, folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy().astype(np.int64)
            words = set_maps(lists.values.to_numpy()[ends[0] : ends[-1]].view(B.U), np.diff(ends))
            fold = np.bitwise_or.reduce(words.reshape(len(words), -1, FOLDED), axis=1)
            on, fon = (pa.array(np.bitwise_count(x).sum(axis=1, dtype=np.int64)) for x in (words, fold))
            cols = [batch.column(0), B.lists(words.view(np.int64).ravel(), np.full(len(lists), MAP_BITS // 64)), on, fon, *(pa.array(x) for x in fold.view(np.int64).T.copy())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "map", "on", "fon", *FOLDS])

    return C.mapped(sets.select("node", "items"), run, "node long, map array<long>, on long, fon long, " + ", ".join(f"{f} long" for f in FOLDS))


def _set_hash(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 bits of each set."""
    total = np.concatenate((np.zeros(1, B.U), np.cumsum(B.mix(x ^ _GOLD), dtype=B.U)))
    end = np.cumsum(counts)
    return B.mix(total[end] - total[end - counts] + counts.astype(B.U) * _GOLD)


def _mapped(docs: DataFrame, width: int, with_sets: bool) -> DataFrame:
    """_k, doc_id, n, node (a name of the set) and items: the band keys, or the set, of each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for c in B.chunks(batch.column(2), CHUNK):
                x, counts = shingle_sets(c.data, c.offs, width)
                node = pa.array(_set_hash(x, counts).view(np.int64))
                cols = [batch.column(0).slice(at, len(counts)), batch.column(1).slice(at, len(counts)), pa.array(counts), node]
                if with_sets:
                    cols.append(B.lists(x.view(np.int64), counts))
                else:
                    keys = band_keys(sketches(x, counts, BANDS * ROWS), BANDS, ROWS)
                    cols.append(B.lists(keys.view(np.int64).ravel(), np.full(len(counts), BANDS)))
                yield pa.RecordBatch.from_arrays(cols, names=["_k", "doc_id", "n", "node", "items"])
                at += len(counts)

    return C.mapped(docs.select("_k", "doc_id", "text"), run, "_k long, doc_id long, n long, node long, items array<long>")


def _verified(pairs: DataFrame, n: int, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the `n` pairs (x, y) whose full sets are similar enough.

    A centre x of very many pairs comes in as many copies as its pairs need tasks; others come once.
    """
    if 2 * n <= C.LIGHT_ROWS:
        some = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
        sets = sets.join(F.broadcast(some), "node", "left_semi")
    company = C.light(pairs.groupBy("x").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")), n)
    a = sets.select(F.col("node").alias("x"), F.col("items").alias("xs")).join(company, "x")
    a = a.select("x", "xs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    b = sets.select(F.col("node").alias("y"), F.col("items").alias("ys"))
    salted = pairs.join(company, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("salt"))
    both = salted.join(a, ["x", "salt"]).join(b, "y")
    common = F.size(F.array_intersect("xs", "ys"))
    return both.withColumn("c", common).filter(100 * F.col("c") >= percent * (F.size("xs") + F.size("ys") - F.col("c"))).select("x", "y")


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` (_k, doc_id, text) as _k, doc_id, n, node; and node, root, label of the nodes whose
    component has more rows than one (root: a name of the component, label: its least id)."""
    s = C.written(_mapped(docs, width, False), "sketches")
    nodes = C.written(s.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("label"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("items").alias("items")), "nodes")
    keys = nodes.select("node", "n", F.posexplode("items").alias("band", "key")).withColumn("band", F.col("band").cast("byte"))
    large = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    m = C.written(keys.join(large, "key"), "members")
    n, roots = m.count(), None
    if n:
        company = C.written(m.groupBy("node").agg(F.sum("size").alias("company")), "company", n)
        some = company.count()
        m = C.written(m.join(C.light(company, some), "node"), "members", n)
        reps = nodes.join(C.light(company.select("node"), some), "node", "left_semi").select(F.col("label").alias("doc_id"))
        text = C.with_maybe(docs, "doc_id", reps, "doc_id", "_maybe").filter("_maybe").drop("_maybe")
        text = text.join(C.light(reps.distinct().withColumnRenamed("doc_id", "_rep"), some), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
        sets = _mapped(text, width, True).join(C.light(company.select("node"), some), "node", "left_semi").dropDuplicates(["node"])
        sets = C.written(sets.select("node", "items"), "sets")
        roots = _linked(m, n, sets, nodes.select("node", F.col("items").alias("keys")), percent)
    label = nodes.select("node", "label", "rows")
    if roots is None:
        return s.drop("items"), label.filter("rows > 1").select("node", F.col("node").alias("root"), "label")
    own = label.join(C.light(*roots), "node", "left").filter("root is not null or rows > 1").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("label").alias("label"))
    return s.drop("items"), C.written(own.drop("label").join(least, "root").select("node", "root", "label"), "labels")


def _labelled(s: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that surely are alone, and the others with root and label, null where they are alone as well.

    All copies of a text share a node, so that join is salted; rows that are alone take no part in it.
    """
    split = C.with_maybe(s, "node", label, "node", "_maybe")
    alone = split.filter(~F.col("_maybe") | (F.col("n") == 0)).drop("_maybe")
    some = split.filter(F.col("_maybe") & (F.col("n") > 0)).drop("_maybe").withColumn("_salt", F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int"))
    salted = label.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return alone, some.join(salted, ["node", "_salt"], "left").drop("_salt")


def _compared(now: DataFrame, centre: DataFrame, covered: float) -> DataFrame:
    """The rows of `now` with those of `centre` (x, and the key, size and minor of its bucket) by key.

    Both sides are dealt out by hand, in cells of a share of the members and one of the centres; the
    root keeps both the cells and the copies of a row few. So no join is left to be split where it runs:
    that splits both sides of a large bucket, by bytes, into as many tasks as the product of their
    pieces, and the driver keeps the metrics of every task.
    """
    shares = {"_row": F.ceil(F.sqrt(F.col("size") / CELL)), "_col": F.ceil(F.sqrt(F.least("minor", F.lit(covered)) / CELL))}
    share = lambda node, k: F.pmod(F.xxhash64(node, F.lit(k)), shares[k]).cast("int").alias(k)
    every = lambda k: F.explode(F.sequence(F.lit(0), shares[k].cast("int") - 1)).alias(k)
    cell = ["key", "_row", "_col"]
    a = now.select("*", share("node", "_row"), every("_col")).repartition(*cell)
    b = centre.select("*", share("x", "_col"), every("_row")).drop("size", "minor").repartition(*cell)
    return a.join(b, cell).drop("_row", "_col")


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Texts with equal shingle sets are one node; nodes that share a band form a bucket. Round by round
    each bucket compares a centre (first the node with most company over all its buckets) with its
    members of other components; links confirmed on full sets join components; only what still lies
    in different components is compared again, until every such pair of a bucket has been compared.
    So no pair within a component is ever needed, and none across components is left out.

    Null and empty texts and texts without words: empty sets, linked with nothing, kept. Repeated
    rows have one component and are all kept if their id is the least. Null ids take part but are
    never the least, unless a component has no other. Empty tables give no rows.
    """
    docs = docs.select(C.row_key(docs, "doc_id", "text").alias("_k"), "doc_id", "text")
    alone, some = _labelled(*_grouped(docs, width, percent))
    least = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("label"))
    out = alone.select("doc_id", "n", F.col("doc_id").alias("component_id")).union(some.select("doc_id", "n", least.alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(m: DataFrame, n: int, sets: DataFrame, keys: DataFrame, percent: int) -> tuple[DataFrame, int] | None:
    """node, root of all nodes that have a link, and how many; m: key, node, n, size, company, band, in n rows.

    The first round's centre is the node with most company. Later each node outside a bucket's most
    common component is a centre, CENTRES ** (round - 1) of them at most at a time: any two nodes of
    different components have one of those among them, so a bucket is done when all have been centres
    in one round. Such a pair is made in the first of its common buckets only (`keys`: all bands of a
    node), and only if the maps of its sets allow that they are similar enough.
    """
    tested = roots = maps = open_ = None
    step, n_tested, n_open = 0, 0, 0
    while True:
        step += 1
        now = m.withColumn("root", F.col("node")) if roots is None else m.join(C.light(*roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        if open_ is not None:  # buckets of which not all that the last round asks for has been compared
            now = now.join(C.light(open_.filter("more").select("key"), n_open), "key", "left_semi")
        # of each bucket of several components the most common one, and how many nodes are in others
        count = now.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("size"))
        count = count.select("key", F.col("most.root").alias("major"), (F.col("size") - F.col("most.c")).alias("minor"), "size").filter("minor > 0")
        covered = float(CENTRES ** (step - 1))
        open_ = C.written(count.withColumn("more", F.col("size") > 2 if step == 1 else F.col("minor") > covered), "open", n)
        n_open = open_.count()
        if not n_open:
            return roots
        now = now.join(C.light(open_.select("key", "major", "minor"), n_open), "key")
        if step == 1:
            centre = now.groupBy("key").agg(F.max(F.struct("company", "node", "n", "root")).alias("c")).select("key", F.col("c.node").alias("x"), F.col("c.n").alias("xn"), F.col("c.root").alias("xr"))
            centre = C.light(C.written(centre, "centres", n_open), n_open)
        else:
            if maps is None:
                some = C.written(now.select("node").distinct(), "open-nodes", n)
                some = C.light(some, some.count())
                maps = C.written(_mapped_bits(sets.join(some, "node", "left_semi")).join(keys.join(some, "node", "left_semi"), "node"), "maps")
            at = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("minor")
            now = now.join(maps, "node")
            centre = now.filter((F.col("root") != F.col("major")) & (at < covered))
            centre = centre.select("key", "size", "minor", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("root").alias("xr"), F.col("keys").alias("xkeys"), *[F.col(c).alias(f"x{c}") for c in ("map", "on", "fon", *FOLDS)])
        pairs = (now.join(centre, "key") if step == 1 else _compared(now, centre, covered)).filter("root != xr").filter(100 * F.least("n", "xn") >= percent * F.greatest("n", "xn"))
        if step > 1:
            upto = lambda c: F.slice(c, F.lit(1), F.col("band").cast("int"))
            earlier = F.exists(F.zip_with(upto("keys"), upto("xkeys"), lambda x, y: x == y), lambda e: e)
            pairs = pairs.filter(_reachable(percent)).filter(~earlier)
        pairs = pairs.select(F.least("node", "x").alias("lo"), F.greatest("node", "x").alias("hi"), "x", F.col("node").alias("y")).dropDuplicates(["lo", "hi"])
        if tested is not None:
            pairs = pairs.join(C.light(tested, n_tested), ["lo", "hi"], "left_anti")
        pairs = C.written(pairs, "pairs", n)
        n_pairs = pairs.count()
        if not n_pairs:
            continue
        n_tested += n_pairs
        tested = pairs.select("lo", "hi") if tested is None else tested.union(pairs.select("lo", "hi"))
        found = C.written(_verified(pairs.select("x", "y"), n_pairs, sets, percent), "links", n_pairs * C.FILE_ROWS // TASK_PAIRS)
        if found.limit(1).count():
            roots = merged(*(roots or (None, 0)), found)


def near_deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, of which one row of each component stays: that of the least id
    (nulls last), then of the least key of id and text.

    Rows without words all stay. Of equal rows (id and text) that would stay any one stays. Ids may be
    null or come with several texts: rows are told apart by id and text. Empty tables stay empty.
    """
    k, flag = C.free_name(docs, "_row_key"), C.free_name(docs, "_maybe")
    keyed = docs.withColumn(k, C.row_key(docs, "doc_id", "text"))
    _, some = _labelled(*_grouped(keyed.select(F.col(k).alias("_k"), "doc_id", "text"), width, percent))
    some = C.written(some.filter("root is not null").select("_k", "doc_id", "root"), "grouped")
    first = some.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_k")).alias("f")).select(F.col("f._k").alias("_k"))
    rows = some.groupBy("_k").agg(F.count("*").alias("rows"))
    rows = rows.join(first.withColumn("stays", F.lit(True)), "_k", "left")
    marked = C.written(rows.filter("stays is null or rows > 1").select(F.col("_k").alias(f"{k}_"), F.coalesce("stays", F.lit(False)).alias(f"{k}_stays")), "gone")
    sure = C.with_maybe(keyed, k, marked, f"{k}_", flag)
    rest = sure.filter(F.col(flag)).drop(flag)
    rest = rest.join(marked, rest[k] == marked[f"{k}_"], "left").drop(f"{k}_")
    once = rest.filter(F.col(f"{k}_stays")).dropDuplicates([k])
    out = sure.filter(~F.col(flag)).drop(flag).unionByName(rest.filter(F.col(f"{k}_stays").isNull()).drop(f"{k}_stays")).unionByName(once.drop(f"{k}_stays"))
    return out.drop(k)
