"""Merkle dataset manifest: a tree of digests for each language, a tree of their roots, and a proof for each row.

A leaf is the SHA-256 of a row's fields; of each `fan` consecutive nodes of a level (fewer at
its end) the hexadecimal digests, concatenated, are hashed into their parent, until one node is left.

Trees are built by events. A node that arrives is put, under its place, into its parent's partial
node; how many children the parent must have follows from the size of the tree, and when
the last one arrives the parent is hashed, written with its children, and arrives at
its own parent. A task does so for the rows it reads; nodes whose siblings lie in
other tasks are the frontier, which combineByKey brings together by the subtree of `fan ** DEPTH`
places they lie in, then by subtrees of such subtrees, until only roots are left. Rows lie in
order, so a task leaves few open nodes.

Proofs go the other way: a written parent links to its children, so from the root down,
DEPTH levels at a time, every node gets its siblings and those of its ancestors; the rows come last,
each subtree of `fan ** DEPTH` of them with its own path. Only digests are shuffled, never texts.

Cases: a null field counts as `-`; null text differs from empty text; null languages are one tree, before
the others; within a language rows without a doc_id come first, and rows that repeat a doc_id go by their leaf;
rows that repeat all fields are leaves of their own; a language of one row has its leaf for a root, and a table of
one language has that language's root; an empty table gives an empty result; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cinderlog.llm._text import cut, map_arrow, workers_find_package

FAN = 2
#: Levels of a tree that are built and proved together: 4,096 rows of a subtree at a fan of 2.
DEPTH = 12
#: Partial parents that a task holds before it hands them on.
OPEN = 100_000
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(field: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    """SHA-256, in bytes, of the fields one after the other."""
    return F.unhex(F.sha2(F.concat(*(encoded(fields[x]) for x in _FIELDS)), 256))


def parent_of(children: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(x.hex().encode() for x in children)).digest()


class Partial:
    """Partial parents of one tree or subtree: create, merge_value and merge_combiners of a combineByKey.

    A parent is (tree, level, index); `closed` lists the parents that met their size, `tops` the nodes without a parent here.
    """

    def __init__(self, fan: int, top: int) -> None:
        self.fan, self.top = fan, top
        self.open: dict[tuple[int, int, int], tuple[int, dict[int, bytes]]] = {}
        self.closed: list[tuple[int, int, int, bytes]] = []
        self.tops: list[tuple[int, int, int, int, bytes]] = []

    def arrive(self, tree: int, level: int, index: int, n: int, digest: bytes) -> None:
        """A node of a level of n nodes arrives; so do all ancestors that this completes."""
        while n > 1 and level < self.top:
            place = (tree, level + 1, index // self.fan)
            _, children = self.open.setdefault(place, (n, {}))
            children[index % self.fan] = digest
            if len(children) < min(self.fan, n - place[2] * self.fan):
                return
            del self.open[place]
            below = [children[i] for i in range(len(children))]
            self.closed.append((*place, b"".join(below)))
            tree, level, index, n, digest = *place, -(-n // self.fan), parent_of(below)
        self.tops.append((tree, level, index, n, digest))

    def add(self, node: tuple[int, int, int, int, bytes]) -> Partial:
        self.arrive(*node)
        return self

    def merge(self, other: Partial) -> Partial:
        self.closed += other.closed
        self.tops += other.tops
        for node in other.waiting():
            self.arrive(*node)
        return self

    def waiting(self) -> Iterator[tuple[int, int, int, int, bytes]]:
        """The nodes that wait in partial parents."""
        for (tree, level, index), (n, children) in self.open.items():
            for i, digest in children.items():
                yield tree, level - 1, index * self.fan + i, n, digest


_NODES = "kind int, tree long, level int, place long, n long, digest binary"
_PARENT, _OPEN = 0, 1


def _written(got: Partial) -> list[tuple]:
    """Rows of _NODES: parents with their children's digests, and nodes that wait or have no parent here."""
    return [(_PARENT, t, level, i, 0, x) for t, level, i, x in got.closed] + [(_OPEN, *x) for x in (*got.tops, *got.waiting())]


def numbered(leaves: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """leaves with `tree` (a number of the values in `tree`), `place` (0, 1, ... in their order) and `n` (leaves of the tree).

    Rows are dealt by ranges of (tree, order) and counted where they lie; offsets come from a table of a row for each task and tree.
    """
    keys = [F.col(x).asc_nulls_first() for x in (*tree, *order)]
    sorted_ = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = StructType([*leaves.schema.fields, StructField("part", IntegerType()), StructField("pos", LongType()), StructField("stretch", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, pos, group = TaskContext.get().partitionId(), None, 0, -1
        for batch in batches:
            values, at, own = list(zip(*(batch.column(x).to_pylist() for x in tree), strict=True)), [], []
            for value in values:
                if value != last or group < 0:
                    last, pos, group = value, 0, group + 1
                at.append(pos)
                own.append(part << 32 | group)
                pos += 1
            more = [pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    workers_find_package(leaves.sparkSession)
    local = cut(sorted_.mapInArrow(run, schema))
    stretches = local.groupBy("stretch", "part", *tree).agg(F.count("*").alias("rows"))
    whole = Window.partitionBy(*tree)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = cut(stretches.select("stretch", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("n"), F.min("stretch").over(whole).alias("tree")))
    return cut(local.join(stretches, "stretch").select(*leaves.columns, "tree", (F.col("offset") + F.col("pos")).alias("place"), "n"))


def build(leaves: DataFrame, fan: int = FAN, depth: int = DEPTH) -> tuple[DataFrame, DataFrame, int]:
    """(parents, roots, rounds) of the trees of leaves (tree, place, n, digest).

    parents: tree, level, place and digest, the children's digests one after the other.
    roots: tree, level, digest. rounds: how many times depth levels the highest tree has at most.
    """
    def arrive(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        got = Partial(fan, depth)

        def out() -> dict:
            columns = list(zip(*_written(got), strict=True)) or [[]] * 6
            return dict(zip(("kind", "tree", "level", "place", "n", "digest"), map(list, columns), strict=True))

        for batch in batches:
            for tree, place, n, digest in zip(*(batch.column(x).to_pylist() for x in ("tree", "place", "n", "digest")), strict=True):
                got.arrive(tree, 0, place, n, digest)
            if len(got.open) + len(got.closed) > OPEN:
                yield out()
                got = Partial(fan, depth)
        yield out()

    block = fan**depth
    nodes = cut(map_arrow(leaves.select("tree", "place", "n", "digest"), arrive, _NODES))
    parents, roots, rounds = nodes.where(F.col("kind") == _PARENT), None, 1
    while True:
        bottom, top = (rounds - 1) * depth, rounds * depth
        waits = nodes.where(F.col("kind") == _OPEN)
        done = waits.where("n = 1").select("tree", "level", "digest")
        roots = done if roots is None else roots.unionByName(done)
        waits = waits.where("n > 1")
        if waits.isEmpty():
            break
        met = cut(_combined(waits, fan, bottom, top, block)) if waits.where(F.col("level") < top).head(1) else waits
        parents = parents.unionByName(met.where(F.col("kind") == _PARENT))
        # nodes at the top of their subtrees go on, under subtrees of subtrees
        nodes, rounds = met.where(F.col("kind") == _OPEN), rounds + 1
    return parents.select("tree", "level", "place", "digest"), cut(roots), rounds


def _combined(waits: DataFrame, fan: int, bottom: int, top: int, block: int) -> DataFrame:
    """Nodes brought together by the subtree whose root is at level `top`."""

    def create(node: tuple) -> Partial:
        return Partial(fan, top).add(node)

    def key(r) -> tuple:  # noqa: ANN001
        return (r.tree, r.place * fan ** (r.level - bottom) // block), (r.tree, r.level, r.place, r.n, bytes(r.digest))

    workers_find_package(waits.sparkSession)
    met = waits.select("tree", "level", "place", "n", "digest").rdd.map(key).combineByKey(create, Partial.add, Partial.merge)
    return waits.sparkSession.createDataFrame(met.flatMap(lambda x: _written(x[1])), _NODES)


def step(own: int, children: bytes) -> bytes:
    """A level of a path: which child its node is, and its siblings' digests."""
    return bytes([own]) + children[: own * 32] + children[own * 32 + 32 :]


def fold(digest: bytes, path: list[bytes]) -> bytes:
    """The root that a digest and its path give."""
    for x in path:
        at = 1 + x[0] * 32
        siblings = x[1:at], x[at:]
        digest = hashlib.sha256((siblings[0].hex() + digest.hex() + siblings[1].hex()).encode()).digest()
    return digest


def proof_digest(path: list[bytes]) -> str:
    """SHA-256 of the siblings of all levels, from the leaf up, left to right."""
    return hashlib.sha256("".join(x[1:].hex() for x in path).encode()).hexdigest()


class _Subtrees:
    """Streams of rows sorted by (tree, block, kind): a path from the block's top to the root, the block's parents, then its targets."""

    def __init__(self, fan: int, bottom: int) -> None:
        self.fan, self.bottom = fan, bottom
        self.now: tuple[int, int] | None = None

    def see(self, tree: int, block: int, kind: int, level: int, place: int, digest: bytes, path: list[bytes]) -> None:
        if (tree, block) != self.now:
            self.now, self.parents, self.path, self.mark = (tree, block), {}, [], b""
        if kind == 0:
            self.path, self.mark = path, digest
        elif kind == 1:
            self.parents[level, place] = digest

    def path_of(self, place: int) -> list[bytes]:
        """The path of a node of the bottom level."""
        out, level = [], self.bottom
        while (children := self.parents.get((level + 1, place // self.fan))) is not None:
            out.append(step(place % self.fan, children))
            level, place = level + 1, place // self.fan
        return out + self.path


def _parents_between(parents: DataFrame, fan: int, bottom: int, top: int, depth: int) -> DataFrame:
    """The parents of levels bottom + 1 to top, under the subtree they lie in."""
    block = F.lit(None).cast("long")
    for level in range(bottom + 1, top + 1):
        block = F.when(F.col("level") == level, F.expr(f"place div {fan ** (depth - (level - bottom))}L")).otherwise(block)
    own = parents.where((F.col("level") > bottom) & (F.col("level") <= top))
    return own.select("tree", block.alias("block"), F.lit(1).alias("kind"), "level", "place", "digest", F.lit(None).cast("array<binary>").alias("path"))


def block_paths(parents: DataFrame, tops: DataFrame, rounds: int, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """tree, block, path, mark of every subtree of depth levels above the leaves.

    tops: tree, path (what leads on from the tree's root) and mark (handed down as it is).
    """
    paths = tops.select("tree", F.lit(0).cast("long").alias("block"), "path", "mark")
    for r in range(rounds, 1, -1):
        bottom, top = (r - 1) * depth, r * depth

        def down(batches: Iterator[pa.RecordBatch], bottom: int = bottom) -> Iterator[dict]:
            own = _Subtrees(fan, bottom)
            for batch in batches:
                found: list[tuple] = []
                for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    own.see(*row)
                    if row[2] == 2:
                        found.append((row[0], row[4], own.path_of(row[4]), own.mark))
                yield dict(zip(("tree", "block", "path", "mark"), map(list, zip(*found, strict=True)), strict=True)) if found else {"tree": [], "block": [], "path": [], "mark": []}

        inner = _parents_between(parents, fan, bottom, top, depth)
        # the children of parents right above the bottom level are the subtrees of the round below; a tree without such parents is one
        low = inner.where(F.col("level") == bottom + 1)
        places = F.explode(F.expr(f"sequence(place * {fan}, place * {fan} + octet_length(digest) div 32 - 1)")).alias("place")
        children = low.select("tree", "block", F.lit(2).alias("kind"), F.lit(bottom).alias("level"), places)
        children = children.select("*", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("array<binary>").alias("path"))
        high = low.select("tree").distinct()
        heads = _heads(paths.join(high, "tree", "left_semi"), top)
        dealt = heads.unionByName(inner).unionByName(children).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind")
        found = map_arrow(dealt, down, "tree long, block long, path array<binary>, mark binary")
        paths = cut(found.unionByName(paths.join(high, "tree", "left_anti").select("tree", "block", "path", "mark")))
    return paths


def _heads(paths: DataFrame, level: int) -> DataFrame:
    return paths.select("tree", "block", F.lit(0).alias("kind"), F.lit(level).alias("level"), F.col("block").alias("place"), F.col("mark").alias("digest"), "path")


def proved(leaves: DataFrame, parents: DataFrame, paths: DataFrame, out: Callable[[dict, list, list], dict], schema: str, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """What `out` makes of the leaves' columns, their paths and their trees' marks, for leaves (tree, place, digest and others)."""
    others = [x for x in leaves.columns if x not in ("tree", "place", "n", "digest")]
    empty = [F.lit(None).cast(leaves.schema[x].dataType).alias(x) for x in others]
    low = leaves.select("tree", F.expr(f"place div {fan**depth}L").alias("block"), F.lit(2).alias("kind"), F.lit(0).alias("level"), "place", "digest", F.lit(None).cast("array<binary>").alias("path"), *others)
    above = _heads(paths, depth).unionByName(_parents_between(parents, fan, 0, depth, depth)).select("*", *empty)
    dealt = above.unionByName(low).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = _Subtrees(fan, 0)
        for batch in batches:
            found, marks, at = [], [], []
            for i, row in enumerate(zip(*(batch.column(x).to_pylist() for x in ("tree", "block", "kind", "level", "place", "digest", "path")), strict=True)):
                own.see(*row)
                if row[2] == 2:
                    found.append(own.path_of(row[4]))
                    marks.append(own.mark)
                    at.append(i)
            picked = batch.take(pa.array(at, pa.int64()))
            yield out({x: picked.column(x).to_pylist() for x in ("digest", *others)}, found, marks)

    return map_arrow(dealt, run, schema)


def tampered_leaf(fields: dict[str, Column]) -> Column:
    """The leaf after 1 was added to n_chars where 7 divides the crc32 of doc_id; null where nothing changes."""
    changed = fields | {"n_chars": fields["n_chars"].cast("decimal(20,0)") + 1}
    return F.when((F.crc32(fields["doc_id"].cast("string")) % 7 == 0) & fields["n_chars"].isNotNull(), leaf_of(changed))


def manifest(documents: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; digests as lower-case hexadecimal."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *_FIELDS[1:])
    fields = {x: F.col(x) for x in _FIELDS}
    leaves = cut(rows.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf_of(fields).alias("digest"), tampered_leaf(fields).alias("changed")))
    leaves = numbered(leaves, ["lang"], ["doc_id", "digest"])
    parents, roots, rounds = build(leaves, fan, depth)

    # the tree of the languages' roots
    langs = leaves.where("place = 0").select("tree", "lang").join(roots.select("tree", "digest"), "tree")
    over = numbered(cut(langs.select(F.lit(0).alias("all"), "lang", F.col("tree").alias("of"), "digest")), ["all"], ["lang"])
    over_parents, over_roots, over_rounds = build(over, fan, depth)
    over_tops = over_roots.select("tree", F.array().cast("array<binary>").alias("path"), F.col("digest").alias("mark"))
    over_paths = block_paths(over_parents, over_tops, over_rounds, fan, depth)

    def of_langs(x: dict, paths: list, marks: list) -> dict:
        return {"tree": x["of"], "path": paths, "mark": [subroot + root for subroot, root in zip(x["digest"], marks, strict=True)]}

    tops = cut(proved(over.select("tree", "place", "digest", "of"), over_parents, over_paths, of_langs, "tree long, path array<binary>, mark binary", fan, depth))

    def of_rows(x: dict, paths: list, marks: list) -> dict:
        folded = [fold(a if b is None else b, path) for a, b, path in zip(x["digest"], x["changed"], paths, strict=True)]
        return {
            "doc_id": x["doc_id"], "leaf": [a.hex() for a in x["digest"]], "subroot": [m[:32].hex() for m in marks], "root": [m[32:].hex() for m in marks],
            "proof_sha256": [proof_digest(p) for p in paths], "folded_root": [a.hex() for a in folded], "verified": [a == m[32:] for a, m in zip(folded, marks, strict=True)],
        }

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proved(leaves.select("tree", "place", "digest", "doc_id", "changed"), parents, block_paths(parents, tops, rounds, fan, depth), of_rows, schema, fan, depth)


def duck_sql() -> str:
    """DuckDB SQL of manifest() at a fan of 2: levels, then paths, by recursion."""

    def field(name: str, value: str | None = None) -> str:
        x = value or name
        return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(field(x, n_chars if x == "n_chars" else None) for x in _FIELDS) + ")"

    step_ = "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = f"xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)), lambda c, b: list_reduce(range(8), {step_}, xor(c, b)), 4294967295), 4294967295)"

    def levels(of: str, by: str) -> str:
        return f"""SELECT 0 AS level, {by}, idx, h, n FROM {of} UNION ALL
            SELECT level + 1, {by}, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM {of}_nodes WHERE n > 1 GROUP BY level, {by}, idx // 2"""

    def climb(of: str, keep: str, start: str) -> str:
        return f"""SELECT {keep}, 0 AS level, idx, n, {start} FROM {of} UNION ALL
            SELECT {", ".join("c." + x for x in keep.split(", "))}, c.level + 1, c.idx // 2, (c.n + 1) // 2, c.path || coalesce(s.h, ''),
                   c.sides || CASE WHEN s.h IS NULL THEN [NULL] WHEN c.idx % 2 = 0 THEN ['R' || s.h] ELSE ['L' || s.h] END
            FROM {of}_climb c LEFT JOIN {of}_nodes s ON s.tree = c.tree AND s.level = c.level AND s.idx = xor(c.idx, 1) WHERE c.n > 1"""

    fold_ = "lambda h, s: CASE WHEN s IS NULL THEN sha256(h) WHEN s[1] = 'R' THEN sha256(h || s[2:]) ELSE sha256(s[2:] || h) END"
    return f"""WITH RECURSIVE
        one AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, {leaf("n_chars")} AS h, coalesce('l' || lang, '') AS tree FROM documents),
        leaf AS (SELECT row_number() OVER () AS id, doc_id, tree, h, count(*) OVER (PARTITION BY tree) AS n,
                        row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
                        CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("CAST(n_chars AS HUGEINT) + 1")} ELSE h END AS changed FROM one),
        leaf_nodes AS ({levels("leaf", "tree")}),
        leaf_climb AS ({climb("leaf", "id, tree", "'' AS path, CAST([] AS VARCHAR[]) AS sides")}),
        lang AS (SELECT 'all' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM leaf_nodes WHERE n = 1),
        lang_nodes AS ({levels("lang", "tree")}),
        lang_climb AS ({climb("lang", "name, tree", "'' AS path, CAST([] AS VARCHAR[]) AS sides")}),
        done AS (
            SELECT doc_id, leaf.h AS leaf, lang.h AS subroot, root.h AS root, sha256(a.path || b.path) AS proof_sha256,
                   list_reduce(a.sides || b.sides, {fold_}, changed) AS folded_root
            FROM leaf JOIN leaf_climb a ON a.id = leaf.id AND a.n = 1 JOIN lang ON lang.name = leaf.tree
            JOIN lang_climb b ON b.name = leaf.tree AND b.n = 1 JOIN lang_nodes root ON root.n = 1)
        SELECT *, folded_root = root AS verified FROM done"""
