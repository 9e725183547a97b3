"""Exact Jaccard join of shingle sets as a metric-space join.

Jaccard distance is a metric, so distances to a pivot bound distances between documents. Among unrelated texts, though, all
distances are near 1 and no pivot tells them apart. The join therefore works in two steps.

First cells. The shingle universe is cut by hash into more slices than two linked sets can differ in shingles, so linked sets agree
in one slice at least, and a set with shingles in enough slices agrees in one that is not empty. Documents with the same content in a slice are in one cell, a ball of radius 0 around it in the distance of that
slice. A set enters only its rarest cells, as many as linked sets can differ in and one more, so that common shingles do not tie
unrelated texts. Each cell ties its documents to its smallest one, and connected cells make a cluster. Slices depend on the size class,
and each document enters the slices of its own class and the next one, because linked sets are at most one class apart.

Then regions. Within a cluster, pivots are chosen, each document goes to the region of its nearest pivot, and also to each region whose
pivot is at most twice the link distance farther away; by the triangle inequality linked documents share a region. Documents within link
distance of a pivot are linked at once. Regions are divided within a task until a region is small or does not get smaller. The latter is finished star by star: the
documents linked to a pivot can be linked only to those within twice the distance, which are compared with them, and then leave the
region. Clusters over a size limit lose their stars as tables; what does not get smaller is spread as pairs of blocks over tasks.

Equal sets are one class throughout; of pairs in one component no more than one link is kept.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.components import components
from tallyfold.llm.passages import INVERSE, ODD, WordHashes, _mixed, _powers
from tallyfold.llm.pretokens import slices
from tallyfold.llm.words import lower_ascii, split_words
from tallyfold.session import stored

# Shingles of a cluster that one task divides; regions up to SMALL documents are compared directly.
LIMIT = 3_000_000
SMALL = 32
PIVOTS = 8
ROUNDS = 4
# Sets in a cell beyond which it counts as equally common.
COMMON = 1_000
SLACK = 1e-9


def shingle_hashes(words: list[list[str]], k: int, hasher: WordHashes) -> list[np.ndarray]:
    """The distinct shingles of each document, as sorted 64-bit hashes; of fewer than k words the whole sequence."""
    hashes = hasher.of(words)
    n = len(hashes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(ODD, n))])
    back = _powers(INVERSE, n)
    grams = _mixed((sums[k:] - sums[:-k]) * back[: max(n - k + 1, 0)]) if n >= k else np.zeros(0, np.uint64)
    out, begin = [], 0
    for own in words:
        end = begin + len(own)
        if len(own) >= k:
            out.append(np.unique(grams[begin : end - k + 1]))
        elif own:
            whole = (sums[end : end + 1] - sums[begin : begin + 1]) * back[begin : begin + 1]
            out.append(_mixed(whole + np.uint64(len(own))))
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out


class Slices:
    """Size classes and the slice contents of a set."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]

    def _grow(self, size: int) -> None:
        """Bounds of the classes up to the second after that of ``size``."""
        while len(self.bounds) < 4 or self.bounds[-3] <= size:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, -(-b * 100 // self.percent)))

    def of(self, shingles: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(tag, cells) for the set's own class and for the next: spare << 1 | class, and a signature for each slice.

        ``spare`` cells of the class may be left out, if all sets leave out those that are last in one common order.
        """
        size = len(shingles)
        if not size:
            return []
        self._grow(size)
        own = bisect_right(self.bounds, size) - 1
        out = []
        for scheme in (own, own + 1):
            # Linked sets of sizes below the class's end differ in this many shingles at most.
            differ = 2 * (self.bounds[scheme + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            n = differ + differ * 3 // 10 + 2
            sums = np.zeros(n, np.uint64)
            slice_of = (shingles % np.uint64(n)).astype(np.int64)
            np.add.at(sums, slice_of, _mixed(shingles))
            which = np.arange(n, dtype=np.uint64) + np.uint64(scheme << 32)
            cells = _mixed(sums ^ _mixed(which * ODD + np.uint64(1)))
            # With more slices in use than can differ, one of those in use agrees, and empty ones, which unrelated
            # sets share, need no cell.
            used = np.bincount(slice_of, minlength=n) > 0
            spare = max(int(used.sum()) - differ - 1, 0)
            out.append((spare << 1 | scheme - own, (cells[used] if used.sum() > differ else cells).view(np.int64)))
        return out


def _digests(docs: DataFrame, k: int) -> DataFrame:
    """doc, n, digest of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                sets = shingle_hashes([split_words(lower_ascii(t or "")) for t in texts], k, hasher)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    ],
                    ["doc", "n", "digest"],
                )
                at += len(texts)

    return docs.mapInArrow(run, "doc bigint, n bigint, digest binary")


def _prepared(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc, n, digest, signatures of every row; no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cells = WordHashes(), Slices(percent)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                sets = shingle_hashes([split_words(lower_ascii(t or "")) for t in texts], k, hasher)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                found = [cells.of(s) for s in sets]
                # The tag tells the sets of a document with several texts apart by a part of the digest. It is kept once for
                # all cells of a class.
                tags = [tag << 32 | int.from_bytes(d[:4]) for f, d in zip(found, digests, strict=True) for tag, _ in f]
                cells_of = [c for f in found for _, c in f]
                inner = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, cells_of)]), pa.int32()),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *cells_of])),
                )
                ends = np.cumsum([0, *map(len, found)])
                pairs = pa.StructArray.from_arrays([pa.array(tags, pa.int64()), inner], ["tag", "cells"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs),
                    ],
                    ["doc", "n", "digest", "signatures"],
                )
                at += len(texts)

    return docs.mapInArrow(run, "doc bigint, n bigint, digest binary, signatures array<struct<tag: bigint, cells: array<bigint>>>")


def _rarest(classes: DataFrame) -> DataFrame:
    """cell, doc: the cells of each set that others have too, without its ``spare`` most common ones.

    Of the slices two linked sets agree in, take the first in the order of (sets in the cell, cell), which is the same for all sets.
    Before it, each of the two has only slices they differ in, so that neither leaves it out. Counts end at COMMON, so that only so many
    rows are held back.
    """
    rows = classes.select(F.explode("signatures").alias("s"), "doc").select(F.explode("s.cells").alias("cell"), "s.tag", "doc")
    rows = rows.repartition("cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = None, None  # rows of the last cell, and the cell whose first COMMON rows are passed on

        def counted(columns: list[np.ndarray], count: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep = np.flatnonzero(count > 1)
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[keep]) for c in columns), pa.array(count[keep])], ["cell", "tag", "doc", "count"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in ("cell", "tag", "doc")]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            cell = columns[0]
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            lengths = np.diff(starts, append=len(cell))
            counts = np.minimum(lengths, COMMON)
            if full is not None and cell[0] == full:
                counts[0] = COMMON
            end = len(cell)
            if counts[-1] < COMMON:
                end, full = int(starts[-1]), None
            else:
                full = cell[-1]
            held = [c[end:] for c in columns]
            yield from counted([c[:end] for c in columns], np.repeat(counts, lengths)[:end])
        if held is not None and len(held[0]):
            yield from counted(held, np.full(len(held[0]), len(held[0]), np.int64))

    shared = rows.mapInArrow(run, "cell bigint, tag bigint, doc bigint, count bigint")
    own = shared.groupBy("doc", "tag").agg(F.array_sort(F.collect_list(F.struct("count", "cell"))).alias("cells"))
    kept = (F.size("cells") - F.shiftright("tag", 33)).cast("int")
    own = own.withColumn("_kept", kept).where("_kept > 0")
    return own.select(F.explode(F.slice("cells", F.lit(1), F.col("_kept"))).alias("c"), "doc").select("c.cell", "doc")


def _cell_links(classes: DataFrame) -> DataFrame:
    """u, v: each document of a cell with the cell's smallest. Rows come sorted by cell and pass as they come."""
    rows = _rarest(classes).repartition("cell").sortWithinPartitions("cell", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, smallest = None, None
        for batch in batches:
            cells, docs = batch.column("cell").to_numpy(), batch.column("doc").to_numpy()
            if not len(cells):
                continue
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            heads = docs[np.maximum.accumulate(np.where(new, np.arange(len(cells)), 0))]
            if cell is not None and cells[0] == cell:
                heads[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(cells)] = smallest
            cell, smallest = cells[-1], heads[-1]
            other = np.flatnonzero(heads != docs)
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(docs[other]), pa.array(heads[other])], ["u", "v"])

    return rows.mapInArrow(run, "u bigint, v bigint").distinct()


class Region:
    """Documents of a region with their sets, and the links found between them."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.reach = (100 - percent) / 100
        self.parent = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))

    def shared(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Shingles that each member shares with the pivot."""
        own, sizes = self.sets[pivot], self.sizes[members]
        flat = np.concatenate([self.sets[m] for m in members])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)

    def near(self, pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivot, and which members are linked to it, decided in whole numbers."""
        common = self.shared(pivot, members)
        union = self.sizes[members] + self.sizes[pivot] - common
        return 1 - common / union, 100 * common >= self.percent * union

    def compare(self, x: int, members: np.ndarray) -> None:
        """Link x to each member of another component that is near enough and of a fitting size."""
        fits = (100 * self.sizes[members] >= self.percent * self.sizes[x]) & (
            100 * self.sizes[x] >= self.percent * self.sizes[members]
        )
        own = self.root(x)
        members = np.array([m for m in members[fits].tolist() if self.root(m) != own], np.int64)
        if len(members):
            for m in members[self.near(x, members)[1]].tolist():
                self.link(x, m)

    def join(self, members: np.ndarray) -> None:
        """Link everything in reach among the members, through regions of pivots."""
        work = [members]
        while work:
            members = work.pop()
            if len(members) <= SMALL:
                for i in range(len(members) - 1):
                    self.compare(int(members[i]), members[i + 1 :])
                continue
            pivots = members[:: -(-len(members) // PIVOTS)]
            distance = np.empty((len(pivots), len(members)))
            for k, p in enumerate(pivots.tolist()):
                distance[k], linked = self.near(p, members)
                for m in members[linked].tolist():
                    self.link(p, m)
            home = distance.min(axis=0)
            regions = [members[row <= home + 2 * self.reach + SLACK] for row in distance]
            regions = [r for r in regions if len({self.root(m) for m in r.tolist()}) > 1]
            if sum(map(len, regions)) <= 2 * len(members) and all(2 * len(r) <= len(members) for r in regions):
                work += regions
            else:
                self.by_stars(members)

    def by_stars(self, members: np.ndarray) -> None:
        """One pivot after another; the documents linked to it leave after they are compared with those in reach."""
        while len(members) > 1:
            pivot = int(members[0])
            distance, linked = self.near(pivot, members)
            star = members[linked]
            for m in star.tolist():
                self.link(pivot, m)
            rim = members[~linked & (distance <= 2 * self.reach + SLACK)]
            few, many = (star, rim) if len(star) <= len(rim) else (rim, star)
            for x in few.tolist():
                self.compare(x, many)
            members = members[~linked]


def _links_of(region: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    own = Region([s for _, s in region], percent)
    own.join(np.arange(len(region)))
    return [(region[a][0], region[b][0]) for a, b in own.links]


def _divided(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """One round of stars over tables: (links to pivots, members by new region).

    A document belongs to the first pivot it is linked to and leaves the region with it. What it may still be linked to is within
    twice the link distance of that pivot, its rim; where there is a rim, the part of the star that can reach it forms a region with it.
    """
    reach = (100 - percent) / 100
    order = Window.partitionBy("region").orderBy(F.xxhash64("doc"), "doc")
    chosen = members.select("region", "doc", "shingles").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= PIVOTS)
    pivots = chosen.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("doc", "shingles"))).alias("pivots"))

    def distances(own: np.ndarray, others: list[np.ndarray]) -> list[tuple[float, bool]]:
        out = []
        for other in others:
            common = len(np.intersect1d(own, other, assume_unique=True))
            union = len(own) + len(other) - common
            out.append((1 - common / union, 100 * common >= percent * union))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sets, active = None, [], []
        for batch in batches:
            rows = {"zone": [], "region": [], "doc": [], "shingles": [], "pivot": [], "distance": [], "linked": []}
            for region, doc, data, pivots_of in zip(*(batch.column(i) for i in range(4)), strict=True):
                region, doc, data = region.as_py(), doc.as_py(), data.as_py()
                if region != known:
                    docs, sets = zip(*((p["doc"], np.frombuffer(p["shingles"], "<u8")) for p in pivots_of.as_py()), strict=True)
                    known, active = region, []
                    for k, own in enumerate(sets):
                        # A pivot linked to one before it has left with that one.
                        if not any(linked for _, linked in distances(own, [sets[a] for a in active])):
                            active.append(k)
                found = distances(np.frombuffer(data, "<u8"), [sets[a] for a in active])
                left = False
                for a, (distance, linked) in zip(active, found, strict=True):
                    if linked or distance <= 2 * reach + SLACK:
                        zone = xxhash.xxh3_64_intdigest(f"{region} {a}") >> 1
                        for key, value in zip(rows, (zone, region, doc, data, docs[a], distance, linked), strict=True):
                            rows[key].append(value)
                    if linked:
                        left = True
                        break
                if not left:
                    zone = xxhash.xxh3_64_intdigest(f"{region} rest") >> 1
                    for key, value in zip(rows, (zone, region, doc, data, None, None, False), strict=True):
                        rows[key].append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], list(rows))

    joined = members.select("region", "doc", "shingles").join(pivots, "region")
    placed = joined.mapInArrow(
        run, "zone bigint, region bigint, doc bigint, shingles binary, pivot bigint, distance double, linked boolean"
    )
    placed = stored(placed, "regions")
    links = placed.where("linked").select(F.col("doc").alias("u"), F.col("pivot").alias("v"))
    rims = placed.where("not linked and pivot is not null").groupBy("zone").agg(F.min("distance").alias("_rim"))
    inside = F.col("pivot").isNull() | (F.col("_rim").isNotNull() & (~F.col("linked") | (F.col("distance") >= F.col("_rim") - reach - SLACK)))
    kept = placed.join(rims, "zone", "left").where(inside)
    return links, kept.select(F.col("zone").alias("region"), "doc", "shingles")


def _in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Regions (region, s: shingles) that do not get smaller, as one region of about LIMIT for each two blocks of documents."""
    blocks = F.ceil(F.col("s") * 2 / LIMIT).cast("long")
    rows = members.join(sizes.select("region", blocks.alias("_n")), "region")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("doc"), F.col("_n")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    name = F.xxhash64("region", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.select(name.alias("region"), "doc", "shingles")


def _region_links(members: DataFrame, percent: int) -> DataFrame:
    """u, v: links within regions (region, doc, shingles); a region is one task's work at a time."""
    size = F.octet_length("shingles") / 8
    links, now = None, stored(members, "regions")

    def larger(now: DataFrame) -> DataFrame:
        sizes = now.groupBy("region").agg(F.sum(size).alias("s"), F.count("*").alias("c"))
        return stored(sizes.where((F.col("s") > LIMIT) & (F.col("c") > 1)).select("region", "s"), "large-regions")

    large, before = larger(now), None
    for _ in range(ROUNDS):
        total = large.agg(F.sum("s")).first()[0]
        if total is None or (before is not None and 2 * total > before):
            break
        before = total
        found, divided = _divided(now.join(large.select("region"), "region"), percent)
        links = found if links is None else links.unionByName(found)
        now = stored(now.join(large, "region", "left_anti").unionByName(divided), "regions")
        large = larger(now)
    if not large.isEmpty():
        now = now.join(large, "region", "left_anti").unionByName(_in_blocks(now, large))

    ordered = now.repartition("region").sortWithinPartitions("region", F.octet_length("shingles"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def finished(held: list) -> Iterator[pa.RecordBatch]:
            found = _links_of(held, percent) if len(held) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            regions, docs = batch.column("region").to_pylist(), batch.column("doc").to_pylist()
            for region, doc, data in zip(regions, docs, batch.column("shingles"), strict=True):
                if region != current:
                    yield from finished(held)
                    current, held = region, []
                held.append((doc, np.frombuffer(data.as_py(), "<u8")))
        yield from finished(held)

    inside = ordered.select("region", "doc", "shingles").mapInArrow(run, "u bigint, v bigint")
    return inside if links is None else links.unionByName(inside)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    A document's set holds its distinct shingles of ``k`` words (A-Z in lower case); of fewer words, the whole sequence. Two
    documents are linked when the intersection is at least ``percent`` hundredths of the union. component_id is the smallest
    doc_id that links reach, the own one included. Null and empty texts, and texts of white space, have empty sets and no links. doc_id is
    an integer; rows with one id are one node, whose texts' links all count. Rows without an id have no links and no component.
    No rows give no rows, and other columns are not read.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    # Narrow rows are read several times and stored; signatures, the bulk of the work, are made where they are needed and
    # go through one exchange only.
    sets = stored(_digests(own, k), "shingle-sets")
    linked = (F.col("n") > 0) & F.col("doc").isNotNull()
    linkable = sets.where(linked)
    # Equal sets are one class with its smallest document for all; a document with several texts is in several classes.
    classes = linkable.groupBy("digest").agg(F.min("doc").alias("doc"))
    signed = _prepared(own, k, percent).where(linked).groupBy("digest")
    signed = signed.agg(F.min("doc").alias("doc"), F.first("signatures").alias("signatures"))
    copies = linkable.join(classes.select("digest", F.col("doc").alias("v")), "digest").where("doc <> v")
    equal = copies.select(F.col("doc").alias("u"), "v")
    cells = _cell_links(signed.select("doc", "signatures"))
    clusters = stored(components(cells, "u", "v"), "clusters")
    chosen = classes.select(F.col("digest").alias("_digest"), "doc").join(clusters, F.col("doc") == F.col("node"))
    chosen = chosen.select("doc", "_digest", F.col("component").alias("region"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHashes()
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                found = shingle_hashes([split_words(lower_ascii(t or "")) for t in texts], k, hasher)
                columns = [batch.column(c).slice(at, len(texts)) for c in ("region", "doc", "_digest")]
                data = [s.tobytes() for s in found]
                # A document with several texts takes part with the one that stands for its class.
                same = [xxhash.xxh3_128_digest(d) == c.as_py() for d, c in zip(data, columns[2], strict=True)]
                rows = pa.array(np.flatnonzero(same))
                yield pa.RecordBatch.from_arrays(
                    [columns[0].take(rows), columns[1].take(rows), pa.array(data, pa.binary()).take(rows)],
                    ["region", "doc", "shingles"],
                )
                at += len(texts)

    members = own.join(chosen, "doc").select("region", "doc", "_digest", "text")
    members = members.mapInArrow(run, "region bigint, doc bigint, shingles binary").distinct()
    links = _region_links(members, percent).unionByName(equal)
    groups = components(links, "u", "v")
    out = sets.select("doc", "n").join(groups, F.col("doc") == F.col("node"), "left")
    return out.select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` without the near duplicates of a document with a smaller id; rows without an id stay."""
    later = near_duplicates(docs, doc_id, **options).where(F.col("component_id") < F.col(doc_id))
    later = later.select(F.col(doc_id).alias("_later")).distinct()
    return docs.join(later, docs[doc_id] == later["_later"], "left_anti")
