"""Prefix trie of conversations: a global range sort of turn arrays, adjacent common prefixes, one sweep with a stack."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, written

#: Digits of a turn's digest in a key.
DIGITS = 32
#: A conversation takes up to SHARED_TURNS - 1 turns of the first one of its hundred.
SHARED_TURNS, FAMILY = 6, 100

_NOBODY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, at_part int, at_side string, at_depth long"
_SWEPT = f"{_NODE}, part int, edge string, first_ids binary, last_ids binary"
_STITCHED = f"{_NODE}, kind string, run string"


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turns): each conversation's turns (digest, n) in order of turn, null first, then of digest."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn"), F.lit(0)).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("n"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), place.alias("turn"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["n"].alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, key, sizes): the digests of a rebuilt conversation's turns in one string, and their code points."""
    turns = written(turn_arrays(conversations), "turns")
    heads = turns.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_TURNS - 1).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS).cast("int")
    both = turns.withColumn("shared", shared).join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("base"), "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, F.lit(0))).otherwise(F.slice("head", F.lit(1), F.col("shared")))
    own = F.slice("turns", F.col("shared") + 1, F.size("turns"))
    return both.select("conv_id", F.concat(head, own).alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("key"), F.transform("turns", lambda t: t["n"]).alias("sizes"))


def common_turns(a: str, b: str) -> int:
    """How many turns two keys begin with alike."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // DIGITS
    low, high = 0, most // DIGITS  # alike up to low, not up to high
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * DIGITS : mid * DIGITS] == b[low * DIGITS : mid * DIGITS] else (low, mid)
    return low


class _Node:
    """A node on the stack: its members so far, and what its closed children add up to."""

    __slots__ = ("children", "chars", "ends", "first", "leaves", "least", "n", "pending", "places", "runs", "saved")

    def __init__(self, chars: int, first: bool = False) -> None:
        self.chars, self.first = chars, first
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = None
        self.pending: list[tuple] = []  # closed children, which wait for this node's smallest member
        self.places: list[tuple[int, str]] = []
        self.runs: list[tuple[int, str, str]] = []

    def add(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def state(self) -> list:
        return [self.n, self.least, self.children, self.leaves, self.saved, self.chars]

    def settle(self, parent: _Node | None) -> None:
        """Nothing more will come: count the node itself, and count it in its parent."""
        self.saved += (self.n - 1) * self.chars
        self.leaves = self.leaves or 1
        if parent is not None:
            parent.children += 1
            parent.leaves += self.leaves
            parent.saved += self.saved


class _Sweep:
    """One range of sorted conversations. Nodes on the path of its first or its last conversation can reach into other
    ranges: they are told as the range's edge; all others are closed here."""

    def __init__(self, part: int) -> None:
        self.part = part
        self.stack: list[_Node] = []
        self.out: list[tuple] = []
        self.key: str | None = None
        self.first_key, self.first_ids = "", b""
        self.first_path: dict[int, list] = {}
        self.floor = 0
        self.run: list[str] = []

    def _row(self, node: _Node, depth: int, parent: int | None, place: tuple = (None, None, None)) -> tuple:
        return (node.least, depth, parent, node.n, node.children, node.leaves, node.saved, node.ends.hexdigest() if node.ends else _NOBODY, *place)

    def _close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        parent = self.stack[-1]
        parent.add(node.n, node.least)
        if node.first:
            self.first_path[depth] = node.state()
            return
        node.settle(parent)
        self.out += [(*row[:2], node.least, *row[3:]) for row in node.pending]
        if parent.first:
            self.out.append(self._row(node, depth, None, (self.part, "F", depth - 1)))
        else:
            parent.pending.append(self._row(node, depth, None))

    def take(self, conv: int, key: str, sizes: list[int]) -> None:
        depth = len(sizes)
        if self.key is None:
            self.first_key, self.floor = key, depth
            self.stack = [_Node(n, True) for n in [0, *sizes]]
        elif key != self.key:
            if self.key == self.first_key:
                self.first_ids = ",".join(self.run).encode()
            alike = common_turns(self.key, key)
            self.floor = min(self.floor, alike)
            while len(self.stack) - 1 > alike:
                self._close()
            self.stack += [_Node(n) for n in sizes[alike:]]
        if key != self.key:
            self.run, self.key = [], key
        top = self.stack[-1]
        top.add(1, conv)
        text = str(conv)
        if top.ends is None:
            top.ends = hashlib.sha256(text.encode())
        else:
            top.ends.update(f",{text}".encode())
        self.run.append(text)

    def edge(self) -> tuple[str, bytes, bytes]:
        last_ids = b""
        if self.key == self.first_key:
            self.first_ids = ",".join(self.run).encode()
        else:
            last_ids = ",".join(self.run).encode()
        last_path: dict[int, list] = {}
        last_ends = {k: node.ends.hexdigest() for k, node in enumerate(self.stack) if k > self.floor and node.ends}
        while self.stack:
            node, depth = self.stack.pop(), len(self.stack)
            if self.stack:
                self.stack[-1].add(node.n, node.least)
            (self.first_path if depth <= self.floor else last_path)[depth] = node.state()
            self.out += [(*row[:8], self.part, "L", depth) for row in node.pending]
        tell = {"first": self.first_key, "last": self.key, "floor": self.floor, "first_path": self.first_path, "last_path": last_path, "ends": last_ends}
        return json.dumps(tell | {"first_sha": hashlib.sha256(self.first_ids).hexdigest()}), self.first_ids, last_ids


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_SWEPT)
    sweep = _Sweep(TaskContext.get().partitionId())
    for batch in batches:
        for conv, key, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "sizes")), strict=True):
            sweep.take(conv, key, sizes)
        if len(sweep.out) > 20_000:
            yield _table([(*row, None, None, None, None) for row in sweep.out], schema)
            sweep.out = []
    if sweep.key is not None:
        edge = sweep.edge()
        yield _table([(*row, None, None, None, None) for row in sweep.out], schema)
        yield _table([(*[None] * 11, sweep.part, *edge)], schema)


class _Stitch:
    """The stacks that ranges left open, taken up one range after the other."""

    def __init__(self) -> None:
        self.stack: list[_Node] = []
        self.out: list[tuple] = []
        self.key: str | None = None

    def _close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        parent = self.stack[-1] if self.stack else None
        if parent is not None:
            parent.add(0, node.least)
        node.settle(parent)
        run, ends = None, node.ends or _NOBODY
        if len(node.runs) == 1:
            ends = node.runs[0][2]
        elif node.runs:
            ends, run = None, "{}{}".format(*node.runs[0][:2])
            self.out += [(*[None] * 8, part, side, None, "run", run) for part, side, _ in node.runs]
        place = (*parent.places[-1], depth - 1) if parent is not None else (None, None, None)
        self.out.append((node.least, depth, None, node.n, node.children, node.leaves, node.saved, ends, *place, "node", run))
        self.out += [(node.least, *[None] * 7, part, side, depth, "place", None) for part, side in node.places]

    def _path(self, path: dict, depth: int, part: int, side: str) -> _Node:
        n, least, children, leaves, saved, chars = path[str(depth)]
        if depth == len(self.stack):
            self.stack.append(_Node(chars))
        node = self.stack[depth]
        node.add(n, least)
        node.children, node.leaves, node.saved = node.children + children, node.leaves + leaves, node.saved + saved
        node.places.append((part, side))
        return node

    def take(self, part: int, edge: dict) -> None:
        alike = -1 if self.key is None else common_turns(self.key, edge["first"])
        while len(self.stack) - 1 > alike:
            self._close()
        deep, last = len(edge["first"]) // DIGITS, len(edge["last"]) // DIGITS
        for depth in range(deep + 1):
            node = self._path(edge["first_path"], depth, part, "F")
        node.runs.append((part, "F", edge["first_sha"]))
        while len(self.stack) - 1 > edge["floor"]:
            self._close()
        for depth in range(edge["floor"] + 1, last + 1):
            node = self._path(edge["last_path"], depth, part, "L")
            if depth < last:
                node.ends = edge["ends"].get(str(depth))
            else:
                node.runs.append((part, "L", edge["ends"][str(depth)]))
        self.key = edge["last"]

    def finish(self) -> None:
        while self.stack:
            self._close()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, stitch = _arrow(_STITCHED), _Stitch()
    for batch in batches:
        for part, edge in zip(*(batch.column(c).to_pylist() for c in ("part", "edge")), strict=True):
            stitch.take(part, json.loads(edge))
        yield _table(stitch.out, schema)
        stitch.out = []
    stitch.finish()
    yield _table(stitch.out, schema)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each run's ids, a range's share after the other: nothing is held but the hash."""
    now, sha = None, None
    schema = _arrow("run string, sha string")
    for batch in batches:
        out = []
        for run, ids in zip(*(batch.column(c).to_pylist() for c in ("run", "ids")), strict=True):
            if run != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = run, hashlib.sha256(ids)
            else:
                sha.update(b",")
                sha.update(ids)
        yield _table(out, schema)
    if now is not None:
        yield _table([(now, sha.hexdigest())], schema)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations, the textless root included.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, as trie nodes.
    Conversations are sorted by their turns' digests and id over all ranges, so a trie node is an interval of them and
    copies of one conversation can fill many ranges. A task sweeps its range with a stack of the open nodes; what begins
    before or ends after the range is given on as two paths, which one pass over the ranges' edges (a row a range)
    stitches. Ids of a conversation that fills several ranges are hashed in order from each range's share.

    Defined results: null roles and texts are empty; rows with a null conv_id are left out; turns of one number are in
    order of their digests, repeated rows count each; other columns, whatever their names, are ignored; an empty table
    gives no rows. Texts count whole: two turns are alike if role and text have the same MD5. A conversation's turns, 50
    bytes each, are one row."""
    spark = conversations.sparkSession
    sorted_from = written(rebuilt(conversations), "rebuilt")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sorted_from.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = written(ranged.mapInArrow(_sweep, _SWEPT), "swept")
    edges = swept.filter("edge is not null").select("part", "edge").repartition(1).sortWithinPartitions("part")
    stitched = written(edges.mapInArrow(_stitch, _STITCHED), "stitched")
    discard(sorted_from)
    names = [c.split()[0] for c in _NODE.split(", ")]
    runs = stitched.filter("kind = 'run'").select(F.col("at_part").alias("part"), F.col("at_side").alias("side"), "run")
    ids = swept.filter("edge is not null").select("part", F.explode(F.map_from_arrays(F.array(F.lit("F"), F.lit("L")), F.array("first_ids", "last_ids"))).alias("side", "ids"))
    shares = ids.join(runs, ["part", "side"]).repartition("run").sortWithinPartitions("run", "part", "side").select("run", "ids")
    hashes = shares.mapInArrow(_hash_runs, "run string, sha string")
    met = stitched.filter("kind = 'node'").join(hashes, "run", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "sha")).select(*names)
    inner = swept.filter("edge is null").select(*names)
    places = stitched.filter("kind = 'place'").select("at_part", "at_side", "at_depth", F.col("conv_id").alias("parent"))
    waiting = inner.filter("at_part is not null").union(met.filter("at_part is not null"))
    found = waiting.join(places, ["at_part", "at_side", "at_depth"]).withColumn("parent_conv_id", F.col("parent"))
    result = names[:8]
    return inner.filter("at_part is null").select(*result).union(met.filter("at_part is null").select(*result)).union(found.select(*result))
