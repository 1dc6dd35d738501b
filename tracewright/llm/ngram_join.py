"""Self-join of texts on the Jaccard similarity of their word n-grams: prefix partitions, a signature tree in each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, mixed, most_frequent, partitions_by_size, shingle_set, staged, trimmed, tune
from .components import components
from .signature_tree import WORDS, Tree, bitmap, folded, leaders, may_link

#: Shingles whose number of documents is kept, to put frequent ones last: it orders the work and bounds nothing else.
FREQUENT = 1 << 19
#: Tasks that gather keys, at least; more as the input grows.
GATHER = 16
#: Members of a partition beyond which a frequent shingle's documents are dealt to several, all pairs of which meet.
CELL = 20_000
#: Pairs of two components that are tried before their components are formed anew.
MOST = 32
#: Members, counted once a partition, up to which partitions of one smallest node are taken together.
UNIT = 500_000
#: Members that are put in one tree; those of larger units are dealt to cells, of which each two meet in a task.
SPLIT = 20_000
FLUSH = 2_000_000
#: Rows of at most 24 bytes that are broadcast, at most; beyond, tables are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _need(n: np.ndarray, num: int, den: int):
    return -(-num * n // den)


def _few(df: DataFrame) -> DataFrame:
    """df as the small side of a join: broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """Per row doc_id, row_hash, n, node (64 bits of the set's digest), digest; and blocks of locally frequent shingles
    with counts. docs: doc_id, text, row_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("digest", pa.binary()), ("base", pa.binary()), ("wide", pa.binary()), ("shingles", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

        def frequent() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            on = c >= 3
            return pa.RecordBatch.from_pydict({"doc_id": [None], "row_hash": [None], "n": [-1], "node": [None], "digest": [None], "base": [None], "wide": [None], "shingles": [h[on].view(np.int64)], "counts": [c[on]]}, schema=schema)

        for b in batches:
            rows: list[tuple] = []
            for doc, text, row_hash in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = shingle_set(text, width)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                wide = bitmap(s)
                base = folded(np.frombuffer(wide, "<u8")).tobytes()
                rows.append((doc, row_hash, len(s), int.from_bytes(digest[:8], "little", signed=True), digest, base, wide if len(wide) > len(base) else None))
                if len(s) and digest not in seen:
                    seen.add(digest)
                    held.append(s)
                    n += len(s)
            if rows:
                empty = pa.nulls(len(rows), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[:7], strict=True)] + [empty, empty], schema=schema)
            if n >= FLUSH:
                yield frequent()
                held, n, seen = [], 0, set()
        if n:
            yield frequent()

    return docs.mapInArrow(trimmed(run), "doc_id long, row_hash long, n long, node long, digest binary, base binary, wide binary, shingles array<long>, counts array<long>")


def _partitions(docs: DataFrame, width: int, num: int, den: int, often: tuple[np.ndarray, np.ndarray], n_parts: int) -> DataFrame:
    """ids array<long>: sets of nodes of which every linking pair shares at least one.

    A set's shingles are put in one order for all, rare ones first. Of two sets that link, one has among its first
    n - ceil(n * num / den) + 1 shingles one that the other has among its own; those are the keys. Keys travel packed.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(often)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        weight = np.frexp(counts)[1]
        keys, nodes, n, seen = [], [], 0, set()

        def flush() -> pa.RecordBatch:
            k, w = np.concatenate(keys), np.concatenate(nodes)
            part = ((k >> np.uint64(24)) % np.uint64(n_parts)).astype(np.int64)
            order = np.lexsort((w, part))
            k, w, part = k[order], w[order], part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            rows = []
            for i, j in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
                own, c = np.unique(w[i:j], return_counts=True)
                rows.append((int(part[i]), own.tobytes(), c.astype("<u4").tobytes(), k[i:j].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "nodes", "counts", "keys"])

        for b in batches:
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or digest in seen:
                    continue
                seen.add(digest)
                node = int.from_bytes(digest[:8], "little", signed=True)
                size = len(s) - int(_need(np.int64(len(s)), num, den)) + 1
                times = np.zeros(len(s), np.int64)
                level = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    on = known[at] == s
                    times[on], level[on] = counts[at[on]], weight[at[on]]
                first = np.lexsort((s, level))[:size]
                key, cells = s[first], times[first] // CELL + 1
                plain = cells == 1
                out = [key[plain]]
                for k, c in zip(key[~plain], cells[~plain], strict=True):
                    own = np.full(c, node % int(c), np.int64)
                    other = np.arange(c)
                    pair = np.minimum(own, other) * c + np.maximum(own, other)
                    out.append(mixed(k + (pair + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                keys.append(np.concatenate(out))
                nodes.append(np.full(len(keys[-1]), node, np.int64))
                n += len(keys[-1])
            if n >= FLUSH:
                yield flush()
                keys, nodes, n, seen = [], [], 0, set()
        if n:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        for b in batches:
            for w, c, k in zip(*(b.column(x).to_pylist() for x in (1, 2, 3)), strict=True):
                keys.append(np.frombuffer(k, "<u8"))
                nodes.append(np.repeat(np.frombuffer(w, "<i8"), np.frombuffer(c, "<u4")))
        if not keys:
            return
        k, w = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((w, k))
        k, w = k[order], w[order]
        on = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])
        k, w = k[on], w[on]
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.append(cuts[1:], len(k))
        found, told = [], set()
        for i, j in zip(cuts[ends - cuts > 1], ends[ends - cuts > 1], strict=True):
            sig = xxhash.xxh3_64_intdigest(w[i:j].tobytes())
            if sig not in told:
                told.add(sig)
                found.append((int(np.uint64(sig).view(np.int64)), w[i:j]))
            if len(found) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["sig", "ids"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["sig", "ids"])

    blobs = docs.mapInArrow(trimmed(send), "part int, nodes binary, counts binary, keys binary").repartition(n_parts, "part")
    return blobs.mapInArrow(trimmed(gather), "sig long, ids array<long>").dropDuplicates(["sig"])


def _clusters(groups: DataFrame) -> DataFrame:
    """unit, node: the partitions that have the same smallest node, as one unit, so that a pair they all hold is tested
    once. Units of too many nodes go back to single partitions."""
    anchored = groups.select("sig", F.array_min("ids").alias("anchor"), F.size("ids").alias("k"), "ids")
    large = staged(anchored.groupBy("anchor").agg(F.sum("k").alias("k")).where(F.col("k") > UNIT).select(F.col("anchor").alias("large")), "large")
    if not large.isEmpty():
        named = anchored.join(_few(large), F.col("anchor") == F.col("large"), "left")
        anchored = named.withColumn("anchor", F.when(F.col("large").isNotNull(), F.col("sig")).otherwise(F.col("anchor")))
    return anchored.select(F.col("anchor").alias("unit"), F.explode("ids").alias("node")).distinct()


def _dealt(members: DataFrame, opening: bool) -> DataFrame:
    """members with cell, and x and y, the two cells that meet. Units of up to SPLIT members are one cell; of larger ones
    a member goes to as many pairs of cells as its unit has cells (opening: to its own alone)."""
    large = staged(members.groupBy("unit").agg(F.count("*").alias("k")).where(F.col("k") > SPLIT).select(F.col("unit").alias("of"), F.ceil(F.col("k") / SPLIT).cast("int").alias("cells")), "cells")
    zero = F.lit(0)
    if large.isEmpty():
        return members.select("*", zero.alias("cell"), zero.alias("x"), zero.alias("y"))
    found = members.join(_few(large), F.col("unit") == F.col("of"), "left").withColumn("cells", F.coalesce("cells", F.lit(1))).drop("of")
    found = found.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    other = F.array(F.col("cell")) if opening else F.sequence(zero, F.col("cells") - 1)
    found = found.withColumn("other", F.explode(other))
    return found.select(*members.columns, "cell", F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"))


def _candidates(units: DataFrame, nodes: DataFrame, comps: DataFrame | None, num: int, den: int, most: int | None) -> DataFrame:
    """a, b: node pairs of a unit that may link. comps None: the few pairs of leaders(); else pairs of different
    components, most of them per pair of components (None: all). A row of a unit and a null says that it has more."""
    members = units
    opening = comps is None
    if comps is not None:
        members = members.join(comps.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        members = staged(members, "labelled")
        split = staged(members.groupBy("unit").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("unit"), "mixed")
        members = members.join(_few(split), "unit", "left_semi")
    else:
        members = members.withColumn("component", F.col("node"))
    members = staged(_dealt(members, opening), "members")
    full = nodes.select("node", "n", "base").join(_few(members), "node")
    packed = full.groupBy("unit", "x", "y").agg(F.collect_list(F.struct("node", "n", "base", "component", "cell")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                m = b.column(3)[k].values
                ids, sizes, comp, cell = (m.field(x).to_numpy(zero_copy_only=False) for x in (0, 1, 3, 4))
                bits = np.frombuffer(b"".join(m.field(2).to_pylist()), "<u8").reshape(-1, WORDS)
                two_cells = b.column(1)[k].as_py() != b.column(2)[k].as_py()
                left: dict[int, int] = {}
                if opening:
                    found = leaders(bits, sizes, num, den)
                    chunks = [tuple(np.array(x, np.int64) for x in zip(*found, strict=True))] if found else []
                else:
                    short = np.unique(comp, return_inverse=True)[1]
                    chunks = Tree(bits, sizes, short).pairs(num, den)
                cut = False
                for i, j in chunks:
                    if two_cells:  # pairs of one cell are found where it meets itself
                        across = cell[i] != cell[j]
                        i, j = i[across], j[across]
                    if not opening and most is not None:
                        pair = np.minimum(short[i], short[j]) * (short.max() + 1) + np.maximum(short[i], short[j])
                        on = []
                        for x, p in enumerate(pair.tolist()):
                            if left.get(p, 0) < most:
                                left[p] = left.get(p, 0) + 1
                                on.append(x)
                        cut |= len(on) < len(i)
                        i, j = i[on], j[on]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])
                if cut:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.nulls(1, pa.int64())], names=["a", "b"])

    return packed.mapInArrow(trimmed(run), "a long, b long").distinct()


def _refined(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that may link by bitmaps as wide as the sets ask for, too."""
    own = pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct()
    wide = nodes.where("wide IS NOT NULL").join(_few(own), F.col("node") == F.col("wanted"), "left_semi").select("node", "n", "wide")
    a, b = (wide.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {x: batch.column(x).to_pylist() for x in ("na", "wa", "nb", "wb")}
            on = [
                k
                for k, (na, wa, nb, wb) in enumerate(zip(c["na"], c["wa"], c["nb"], c["wb"], strict=True))
                if wa is None or wb is None or may_link(np.frombuffer(wa, "<u8"), na, np.frombuffer(wb, "<u8"), nb, num, den)
            ]
            yield batch.select(["a", "b"]).take(pa.array(on, pa.int64()))

    return pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", "na", "wa", "nb", "wb").mapInArrow(trimmed(run), "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs of which num/den of the union are in common, by their whole sets. Sets are made from the texts anew, for
    the documents in a pair only."""
    wanted = staged(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node"), "wanted")
    side = _few(wanted.withColumnRenamed("node", "wanted_node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(node, s.view(np.int64)) for text, node in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if int.from_bytes(xxhash.xxh3_128_digest((s := shingle_set(text, width)).tobytes())[:8], "little", signed=True) == node]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["node", "s"])

    texts = docs.join(side, F.col("doc_id").eqNullSafe(F.col("rep")))
    sets = staged(texts.select("text", "wanted_node").mapInArrow(trimmed(run), "node long, s array<long>").dropDuplicates(["node"]), "sets")
    both = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")).join(_few(pairs), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * (num + den) >= (F.size("sa") + F.size("sb")) * num).select("a", "b")


def row_classes(docs: DataFrame, width: int = 4, threshold: tuple[int, int] = (17, 20), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, row_hash (xxhash64 of its text), n_shingles, component_id (smallest doc_id reachable by links,
    itself included), n_copies (rows of the same set) and component (a number of the class, null without shingles).

    Two rows link when intersection over union of their sets of width-word shingles is threshold or more. Equal sets
    are one node from the start. Partitions by rare shingles hold every linking pair; in each, first a few likely pairs
    are verified and their components formed; then a signature tree yields the pairs of different components that may
    link, a few for each pair of components first, then all: no link between components is lost, and large groups of
    near copies cost no more than their members.

    Texts without words have no shingle and link with nothing. Null texts are empty. Repeated rows are rows of their
    own; null ids are no one's smallest id unless all are null. Empty tables give no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    num, den = threshold
    n_parts = max(GATHER, partitions_by_size(docs))
    source = id_and_text(docs, id_col, text_col)
    profiles = staged(_profiles(source.withColumn("row_hash", F.xxhash64("text")), width), "profiles")
    counted = profiles.where("n = -1").select(F.explode(F.arrays_zip("shingles", "counts")).alias("x")).groupBy(F.col("x.shingles").alias("h")).agg(F.sum("x.counts").alias("c"))
    counted = most_frequent(staged(counted, "frequent"), FREQUENT).toArrow()
    h = counted.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    often = (h[order], counted.column("c").to_numpy()[order])
    rows = profiles.where("n >= 0").select("doc_id", "row_hash", "n", "node", "digest")
    nodes = staged(profiles.where("n > 0").groupBy("node", "digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("base").alias("base"), F.first("wide").alias("wide"), F.count("*").alias("copies")), "nodes")
    groups = staged(_partitions(source, width, num, den, often, n_parts), "groups")

    units = staged(_clusters(groups), "units")

    links, comps, tried = None, None, None
    for most in (None, MOST, None):
        found = staged(_candidates(units, nodes, comps, num, den, most), "pairs")
        more = found.where("b IS NULL").select(F.col("a").alias("unit")).distinct()
        new = found.where("b IS NOT NULL")
        new = staged(new.join(tried, ["a", "b"], "left_anti"), "new-pairs") if tried is not None else new
        tried = new if tried is None else tried.unionByName(new)
        edges = staged(_verified(staged(_refined(new, nodes, num, den), "refined"), source, nodes, width, num, den), "links")
        links = edges if links is None else links.unionByName(edges)
        if comps is None:
            comps = staged(components(links), "components")
        elif not edges.isEmpty():
            comps = staged(components(links), "components")
        if most is not None:  # of all other units every pair of components that may link has been verified
            if more.isEmpty():
                break
            units = staged(units.join(_few(more), "unit", "left_semi"), "units")

    named = nodes.select("node", "digest", "rep", "copies").join(comps, nodes["node"] == comps["id"], "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = named.join(smallest, "component").select(F.col("digest").alias("of"), "component_id", "copies", "component")
    return rows.join(classes, rows["digest"] == classes["of"], "left").select("doc_id", "row_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"), "component")


def similarity_classes(docs: DataFrame, width: int = 4, threshold: tuple[int, int] = (17, 20), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, n_shingles, component_id and n_copies, as row_classes() says."""
    return row_classes(docs, width, threshold, id_col, text_col).select("doc_id", "n_shingles", "component_id", "n_copies")


def first_of_classes(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each class of rows that link, all columns: the row of the smallest id (null ids last), of equal
    ids the one of the smallest hash of its text. Rows, not ids, are chosen: of two texts of one id that don't link both
    stay. Texts without words link with nothing and stay; of rows with the same id and text one stays, whatever their
    other columns. An empty table gives no rows.
    """
    classes = row_classes(docs, width, threshold, id_col, text_col)
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("kept_id"), F.col("row_hash").alias("kept_hash"))
    keyed = classes.select("component", row.alias("row"))
    linked = keyed.where("component IS NOT NULL").groupBy("component").agg(F.min("row").alias("row"))
    kept = staged(linked.select("row.*").unionByName(keyed.where("component IS NULL").select("row.*")).distinct().drop("last"), "kept")
    texts = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_hash"))
    met = texts.join(_few(kept), F.col("_id").eqNullSafe(F.col("kept_id")) & (F.col("_hash") == F.col("kept_hash")), "left_semi")
    # rows that come more than once are few: only they are grouped
    times = classes.groupBy("doc_id", "row_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice_id"), F.col("row_hash").alias("twice_hash"))
    twice = _few(staged(times, "repeated"))
    same = F.col("_id").eqNullSafe(F.col("twice_id")) & (F.col("_hash") == F.col("twice_hash"))
    single = met.join(twice, same, "left_anti").select("_row.*")
    return single.unionByName(met.join(twice, same, "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*"))
