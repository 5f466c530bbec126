"""N-gram Jaccard join over count vectors in R-trees, and its components.

Every text becomes its set of distinct word n-grams (64-bit hashes). Tokens, here the
n-grams, are hashed into 64 groups; a text's counts by group are a point, and the sum of
coordinate minima of two points bounds their overlap, as the sum of minima with a box's
upper corner bounds the overlap with all points in it.

1. Texts with equal sets are one class, named by the number of its first row.
2. Of two sets that link, ordered by hash, both begin with the same n-grams of those they share: a
   set of n with links of at least t common n-grams has the first m common ones among its first
   n - t + m. These n-grams are the keys that a set is filed under. m is s + 1, and of its keys a
   set drops the s most frequent, by an order that all sets share: the rarest key of those that
   two linked sets have in common is dropped by neither. So n-grams of passages that many texts
   hold, and n-grams met by chance, bring no sets together unless a text has more than s of
   them as keys. s grows with n; m is chosen for the largest set that one of n may link with.
   Rows are dealt by range of (key, row), so a frequent key is split between tasks.
3. Sets with a shared key are gathered around the leader with which they share most keys,
   in groups of bounded size. Each group is indexed by an R-tree of its points; pairs that
   survive the bound are verified with the whole sets, those already connected skipped.
4. What remains are keys whose sets lie in different components, one for all keys with the
   same sets: their points meet in tiles of bounded size, again by R-tree, and survivors of
   its bound are held against finer points, with about a group for each n-gram. A tile hands
   on clusters, rows that survivors in other components connect, never pairs. Equal clusters
   of several tiles are one. Each cluster's whole sets meet, and its pairs are verified; what
   is already connected is skipped, so n rows give at most n - 1 links. So no link between
   different texts is lost.

Cases: texts without words are linked with nothing and have 0 n-grams; texts with fewer
words than n have one n-gram, the whole sequence; null text is empty; rows with a null
doc_id are returned, linked with nothing, their component null; rows that repeat a doc_id
and a text are in one class; rows that share a doc_id but no text are linked each by its own
text; there is a row for each row; a table without rows gives none; texts are read whole; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, docs_of, map_arrow, text_bytes, windows, word_hashes
from cinderlog.llm.components import components

GROUPS = 64
LEAF = 32
#: Share of its n-grams that are frequent keys a set drops; it is filed under as many more.
SPARE_SHARE = 0.1
#: Keys with more rows in a task count as equally frequent.
FREQUENT = 4096
#: N-grams and sets in a group of step 3, about.
GROUP_GRAMS, GROUP_SETS = 1_000_000, 512
#: Load of a side of a tile of step 4, about; a set of n n-grams is a load of SET_LOAD + n.
TILE_LOAD, SET_LOAD = 1 << 20, 1024


def gram_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; A-Z count as a-z."""
    for words in word_hashes(texts, True):
        yield np.unique(windows(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def points(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """Counts by group: the top bits of an n-gram's hash; groups is a power of two."""
    edges = np.arange(1, groups, dtype=np.uint64) << np.uint64(65 - groups.bit_length())
    return np.stack([np.diff(np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])) for x in sets]).astype(np.int32)


class Threshold:
    """Links by den * intersection >= num * union, in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        if not 0 < num <= den:
            raise ValueError("the similarity must be over 0 and at most 1")
        self.num, self.den = num, den

    def overlap(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def differ(self, a: int, b: int) -> int:
        return a + b - 2 * self.overlap(a, b)

    def dropped(self, n: int) -> int:
        """How many of its most frequent keys a set of n drops; fewer than any link's intersection."""
        return min(int(n * SPARE_SHARE), self._least(n) - 1)

    def keys(self, n: int) -> int:
        """How many keys a set of n has: any set that it links with has one more of them than either drops."""
        return min(n, n - self._least(n) + 1 + self.dropped(n * self.den // self.num))

    def _least(self, n: int) -> int:
        """The least intersection of a set of n with a set that it links with."""
        return -(-self.num * n // self.den)


def keys_of(grams: np.ndarray, threshold: Threshold) -> np.ndarray:
    """The keys a set is filed under: its first n-grams by hash; `grams` are sorted."""
    return grams[: threshold.keys(len(grams))]


class RTree:
    """Points packed into boxes of LEAF, by halving the widest coordinate."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.counts, self.sizes = counts, sizes
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(counts))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                self.leaves.append(at)
                continue
            values = np.concatenate([counts[at], sizes[at, None]], 1)
            order = at[np.argsort(values[:, np.argmax(values.max(0) - values.min(0))], kind="stable")]
            todo += [order[: len(at) // 2], order[len(at) // 2 :]]
        self.high = np.stack([counts[x].max(0) for x in self.leaves])
        self.least = np.array([sizes[x].min() for x in self.leaves])
        self.most = np.array([sizes[x].max() for x in self.leaves])

    def search(self, count: np.ndarray, size: int, threshold: Threshold, label: np.ndarray, own: int, box_label: np.ndarray) -> np.ndarray:
        """Points that may link with one of this size, in components other than `own`."""
        t = threshold
        good = (t.den * self.most >= t.num * size) & (t.den * size >= t.num * self.least) & (box_label != own)
        boxes = np.flatnonzero(good)
        if len(boxes):
            bound = np.minimum(self.high[boxes], count).sum(1)
            boxes = boxes[bound >= t.overlap(size, np.maximum(self.least[boxes], -(-t.num * size // t.den)))]
        if not len(boxes):
            return boxes
        at = np.concatenate([self.leaves[i] for i in boxes])
        at = at[label[at] != own]
        bound = np.minimum(self.counts[at], count).sum(1)
        return at[bound >= t.overlap(size, self.sizes[at])]


def _box_labels(tree: RTree, label: np.ndarray) -> np.ndarray:
    """The component of boxes that lie in one, else -1."""
    return np.array([label[x[0]] if (label[x] == label[x[0]]).all() else -1 for x in tree.leaves])


def links_in(sets: list[np.ndarray], threshold: Threshold, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets that links among these connect; at most one less than there are sets.

    label: what is connected already, as numbers of its components.
    """
    label = np.arange(len(sets)) if label is None else label.copy()
    sizes, counts = np.array([len(x) for x in sets]), points(sets)
    tree = RTree(counts, sizes)
    boxes = _box_labels(tree, label)
    links = []
    for i in range(len(sets)):
        found = tree.search(counts[i], sizes[i], threshold, label, label[i], boxes)
        found = found[found < i]
        before = len(links)
        for j in found[np.argsort(np.minimum(counts[found], counts[i]).sum(1))[::-1]]:
            if label[j] != label[i] and _same(sets[i], sets[j], threshold):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
                links.append((i, int(j)))
        if len(links) > before:
            boxes = _box_labels(tree, label)
    return links


def fine_groups(n: int) -> int:
    """Groups of the finer point of a set of n: a power of two, about one for each n-gram."""
    return max(GROUPS, 1 << max(0, n.bit_length() - 1))


def pack_point(counts: np.ndarray) -> bytes:
    """A point's bytes: one for each group, or four where a count is over 255."""
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpack_points(data: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Points of sets of these sizes, all with as many groups as the one with the fewest."""
    groups = min(fine_groups(int(n)) for n in sizes)
    out = np.empty((len(data), groups), np.int32)
    for i, (x, n) in enumerate(zip(data, sizes.tolist(), strict=True)):
        own = fine_groups(n)
        out[i] = np.frombuffer(x, np.uint8 if len(x) == own else "<u4").reshape(groups, -1).sum(1, dtype=np.int32)
    return out


def clusters(counts: np.ndarray, sizes: np.ndarray, label: np.ndarray, threshold: Threshold) -> np.ndarray:
    """For each row the first of the rows that it is connected with by pairs, of different components, that points don't rule out as links."""
    coarse = counts.reshape(len(counts), GROUPS, -1).sum(2, dtype=np.int32)
    tree = RTree(coarse, sizes)
    boxes = _box_labels(tree, label)
    out = np.arange(len(counts))
    for i in range(len(counts)):
        found = tree.search(coarse[i], int(sizes[i]), threshold, label, label[i], boxes)
        found = found[found < i]
        if len(found):
            good = found[np.minimum(counts[found], counts[i]).sum(1) >= threshold.overlap(int(sizes[i]), sizes[found])]
            joined = np.unique(out[good])
            if len(joined):
                out[i] = joined[0]
                for other in joined[1:]:
                    out[out == other] = joined[0]
    return out


def _same(a: np.ndarray, b: np.ndarray, threshold: Threshold) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= threshold.overlap(len(a), len(b))


def _grams(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8").astype(np.uint64) for x in column.to_pylist()]


def _streams(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal values in `names`, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(x).to_pylist() for x in names), strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def digested(docs: DataFrame, size: int, threshold: Threshold) -> DataFrame:
    """doc_id, mark (tells the texts of one doc_id apart), n (n-grams), digest (of the set) and keys (eight bytes each) of every text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for at in range(0, len(texts), 256):
                sets = [x.astype("<u8") for x in gram_sets(texts[at : at + 256], size)]
                yield {
                    "doc_id": batch.column("doc_id").slice(at, 256),
                    "mark": batch.column("mark").slice(at, 256),
                    "n": [len(x) for x in sets],
                    "digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets],
                    "keys": [keys_of(x, threshold).tobytes() for x in sets],
                }

    return map_arrow(docs.withColumn("mark", F.xxhash64("text")), digest, "doc_id long, mark long, n long, digest binary, keys binary")


def filed(rows: DataFrame) -> DataFrame:
    """(key, id) of every text with words; id is its row."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, keys = batch.column("row").to_numpy(), batch.column("keys").to_pylist()
            for at in range(0, len(keys), 256):
                some = keys[at : at + 256]
                yield {"key": np.frombuffer(b"".join(some), "<i8"), "id": np.repeat(ids[at : at + 256], [len(x) // 8 for x in some])}

    return map_arrow(rows.where("n > 0 AND doc_id IS NOT NULL").select("row", "keys"), file, "key long, id long")


def shared(rows: DataFrame) -> DataFrame:
    """(key, id, leader, n) of keys that several rows (key, id) may share.

    leader: the key's smallest id in its task. n: the key's rows, FREQUENT + 1 where there
    are more, or where the key is a task's first or last, so that it may go on in another.
    All rows of a key have the same n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        first: int | None = None
        hot: tuple[int, int] | None = None  # the key whose rows are handed on as they come, and its leader
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            first = int(key[0]) if first is None else first
            if hot and key[0] == hot[0]:
                n = int(np.searchsorted(key, hot[0], "right"))
                yield {"key": key[:n], "id": ids[:n], "leader": np.full(n, hot[1]), "n": np.full(n, FREQUENT + 1)}
                key, ids = key[n:], ids[n:]
                if not len(key):
                    continue
            hot = None
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(start, len(key)))
            if count[-1] > FREQUENT:
                hot = int(key[-1]), int(ids[start[-1]])
            end = len(key) if hot else int(start[-1])
            whole = len(count) if hot else len(count) - 1
            n = np.where((count[:whole] > FREQUENT) | (key[start[:whole]] == first), FREQUENT + 1, count[:whole])
            n, leader = np.repeat(n, count[:whole]), np.repeat(ids[start[:whole]], count[:whole])
            good = n > 1
            yield {"key": key[:end][good], "id": ids[:end][good], "leader": leader[good], "n": n[good]}
            key, ids = key[end:], ids[end:]
        if len(key):
            yield {"key": key, "id": ids, "leader": np.full(len(key), ids[0]), "n": np.full(len(key), FREQUENT + 1)}

    return map_arrow(rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id"), run, "key long, id long, leader long, n int")


def link_components(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links."""
    return _linked(documents, size, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _linked(documents: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, mark, n, component (a number of the component's, null for a row that is linked with nothing by its kind), component_id of every row.

    Equal sets are a class, named by the first of its rows (`rep`), so that rows that share a doc_id but no text stay apart.
    """
    threshold, docs = Threshold(num, den), docs_of(documents)

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"rep": batch.column("rep"), "spare": [threshold.dropped(x) for x in batch.column("n").to_pylist()]}

    rows = cut(digested(docs, size, threshold).withColumn("row", F.monotonically_increasing_id()))
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest")
    classes = cut(classes.agg(F.min("row").alias("rep"), F.min("doc_id").alias("first"), F.min("n").alias("n")))
    rank = Window.partitionBy("rep").orderBy(F.desc("often"), "key")
    keys = shared(filed(rows)).select("key", F.col("id").alias("rep"), F.col("n").alias("often"))
    # of a class, the keys of its first row
    spare = map_arrow(classes.select("rep", "n"), dropped, "rep long, spare long")
    keys = keys.withColumn("rank", F.row_number().over(rank)).join(spare, "rep").where("rank > spare").select("key", "rep")
    met = cut(shared(cut(keys).select("key", F.col("rep").alias("id"))).select("key", F.col("id").alias("rep"), "leader"))

    # step 3: groups around leaders
    led = met.groupBy("rep", "leader").agg(F.count("*").alias("k"))
    led = led.groupBy("rep").agg(F.max_by("leader", F.struct("k", -F.col("leader"))).alias("leader"))
    active = cut(led.join(classes, "rep"))
    # a class' set comes from its first row's text; rows that repeat doc_id and text are left out
    named = active.select("rep").join(rows.select(F.col("row").alias("rep"), "doc_id", "mark"), "rep")
    some = docs.withColumn("mark", F.xxhash64("text")).join(named, ["doc_id", "mark"]).dropDuplicates(["rep"])
    sets = cut(map_arrow(some.select("rep", "text"), _sets(size), "rep long, grams binary"))
    load = active.groupBy("leader").agg(F.ceil(F.greatest(F.sum("n") / GROUP_GRAMS, F.count("*") / GROUP_SETS)).cast("int").alias("parts"))
    members = active.join(load, "leader").select("rep", "leader", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"))
    heads = load.select(F.col("leader").alias("rep"), "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    placed = members.where("rep != leader").unionByName(heads).join(sets, "rep")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in _streams(batches, ["leader", "part"]):
            if table.num_rows > 1:
                ids = np.array(table.column("rep").to_pylist(), np.int64)
                found = np.array(links_in(_grams(table.column("grams")), threshold), np.int64).reshape(-1, 2)
                yield {"u": ids[found[:, 0]], "v": ids[found[:, 1]]}

    links = map_arrow(placed.repartition("leader", "part").sortWithinPartitions("leader", "part", "rep"), groups, "u long, v long")
    first = components(links)

    # step 4: keys whose sets lie in different components
    member = cut(active.select("rep", "n").join(first.select(F.col("id").alias("rep"), "component"), "rep", "left").select("rep", "n", F.coalesce("component", "rep").alias("component")))
    known = met.select("key", "rep").join(member, "rep").withColumn("load", SET_LOAD + F.col("n"))
    # two hashes and a count tell the sets of a key
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
    by_component = known.groupBy("key", "component").agg(F.sum("load").alias("k"), F.count("*").alias("n"), *marks)
    open_keys = by_component.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("k").alias("rows"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("main"),
        F.sum("n").alias("n"), *(F.bit_xor(f"mark{i}").alias(f"mark{i}") for i in (0, 1)),
    ).where("parts > 1")
    open_keys = cut(open_keys.groupBy("n", "mark0", "mark1").agg(F.min(F.struct("key", "rows", "most", "main")).alias("x")).select("x.*"))
    tiles = open_keys.select("key", "main", F.ceil(F.col("most") / TILE_LOAD).cast("int").alias("a"), F.greatest(F.lit(1), F.ceil((F.col("rows") - F.col("most")) / TILE_LOAD)).cast("int").alias("b"))
    open_rows = known.join(tiles, "key")
    hashed = F.xxhash64("rep")
    of_main = open_rows.where("component = main").select("key", "rep", "component", F.pmod(hashed, F.col("a")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"))
    of_rest = open_rows.where("component != main").withColumn("own", F.pmod(hashed, F.col("b")).cast("int"))
    with_main = of_rest.select("key", "rep", "component", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), F.col("own").alias("j"))
    # rest against rest: tile (i, j) with negative i, once for each two of its parts
    others = of_rest.where("b > 1").select("key", "rep", "component", "own", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("k")).where("k != own")
    with_rest = others.select("key", "rep", "component", (-1 - F.least("own", "k")).alias("i"), F.greatest("own", "k").alias("j"))
    meet = of_main.unionByName(with_main).unionByName(with_rest)
    vectors = map_arrow(sets, _vectors, "rep long, n long, point binary")
    meet = meet.join(vectors, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The tile's clusters of rows that may link with another component's."""
        for table in _streams(batches, ["key", "i", "j"]):
            sizes, reps, own = (table.column(x).to_numpy() for x in ("n", "rep", "component"))
            if len(reps) < 2:
                continue
            first = clusters(unpack_points(table.column("point").to_pylist(), sizes), sizes, own, threshold)
            order = np.argsort(first, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
                if len(at) > 1:
                    name = int.from_bytes(hashlib.blake2b(np.sort(reps[at]).tobytes(), digest_size=8).digest(), "little", signed=True)
                    yield {"cluster": np.full(len(at), name), "rep": reps[at], "component": own[at]}

    left = cut(map_arrow(meet, near, "cluster long, rep long, component long").distinct())
    whole = left.join(sets, "rep").repartition("cluster").sortWithinPartitions("cluster", "rep")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in _streams(batches, ["cluster"]):
            own = table.column("component").to_numpy()
            found = np.array(links_in(_grams(table.column("grams")), threshold, np.unique(own, return_inverse=True)[1]), np.int64).reshape(-1, 2)
            yield {"u": own[found[:, 0]], "v": own[found[:, 1]]}

    more = components(map_arrow(whole, verify, "u long, v long"))

    joined = member.select("rep", "component").join(more.select(F.col("id").alias("component"), F.col("component").alias("merged")), "component", "left")
    joined = joined.select("rep", F.coalesce("merged", "component").alias("component"))
    final = cut(classes.join(joined, "rep", "left").select("digest", "first", F.coalesce("component", "rep").alias("component")))
    lowest = final.groupBy("component").agg(F.min("first").alias("component_id"))
    found = rows.join(final.join(lowest, "component").select("digest", "component", "component_id"), "digest", "left")
    # null ids and texts without words are linked with nothing
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return found.select("doc_id", "mark", "n", F.when(~alone, F.col("component")).alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _sets(size: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"rep": batch.column("rep"), "grams": [x.astype("<u8").tobytes() for x in gram_sets(text_bytes(batch.column("text")), size)]}

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each set's size and its finer point."""
    for batch in batches:
        sets = _grams(batch.column("grams"))
        yield {"rep": batch.column("rep"), "n": [len(x) for x in sets], "point": [pack_point(points([x], fine_groups(len(x)))[0]) for x in sets]}


def keep_one(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component stays, one of its smallest doc_id, with all its columns.

    Of rows that repeat a doc_id and a text one stays, and of a component's texts that share its smallest doc_id, too;
    rows without a doc_id, and without words, aren't linked, so they all stay but for such repeats.
    """
    found = _linked(documents, size, num, den).where("doc_id IS NOT NULL AND doc_id = component_id")
    found = found.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("times"))
    linked = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "mark", "times")).alias("x")).select("x.*")
    stays = linked.unionByName(found.where("component IS NULL").drop("component"))
    stays = cut(stays.groupBy("doc_id", "mark").agg(F.sum("times").alias("times")))
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark"))
    once = rows.join(stays.where("times = 1"), ["doc_id", "mark"], "left_semi")
    again = rows.join(stays.where("times > 1"), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    return rows.where("doc_id IS NULL").unionByName(once).unionByName(again).select("row.*")
