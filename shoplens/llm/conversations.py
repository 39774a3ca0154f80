"""Conversation structure repair over a suffix-shared automaton of role and fault signatures.

A conversation becomes a signature, one symbol a turn: the role's initial, upper case if
the turn is truncated, or ``x`` if it must go. What the rest of a conversation costs
depends on its remaining symbols and the state of the grammar ``(s?(ua)+)?`` only. The
distinct signatures of all conversations are therefore sorted by their ends: a path of
nodes, one a suffix, is kept, and each signature adds nodes just where it leaves the path
of the one before. A node holds, for each grammar state, the cheapest cost to go and the
first edit of the best audit suffix. Edits that may come first differ in their letter, so
the least letter of the cheapest ones gives the ASCII-least audit.

Conversations of any length: turns are dealt by ranges of (conversation, turn), and a
signature is cut into segments of 512 symbols. Segments of longer conversations pass their
cost-to-go vector backwards through 4 x 4 matrices of (min, +). The texts are read once
more, in order, beside the edits of their segments; only the SHA-256 of one conversation
is bound to be computed in sequence, which is done as a stream.

Defined results: null roles and texts count as one space, null turns come first, turns of
one number are ordered by role and digest of role and text; a null conversation id is a
conversation of its own; conversations without turns cost nothing and give no turns;
equal rows are turns each (all but the first are duplicates); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shoplens.llm.store import written

SEGMENT = 512
SPACES = " \t\n\x0b\x0c\r"
_LONG = (1 << 63) - 1
_BEYOND = 1 << 40  # cost of what cannot be

# Grammar states: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
_NEXT = (2, 2, 3, 2)  # state after a turn that may be inserted or given a new role: user, but assistant after user
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = frozenset({"su", "ua", "au"})
_INSERT, _DELETE, _REROLE, _TRUNCATED = 5, 2, 1, 5

Costs = tuple[int, int, int, int]
Edits = tuple[tuple[str, int], ...]  # for each state the first edit and the state after it
_FINAL: tuple[Costs, Edits] = ((0, 10, 5, 0), (("", 0), ("I", 2), ("I", 3), ("", 3)))


def _relaxed(costs: Costs) -> tuple[int, Costs]:
    least = min(costs)
    return least, tuple(min(c - least, _BEYOND) for c in costs)


@lru_cache(1 << 14)
def _edge(symbol: str, after: Costs) -> tuple[Costs, Edits]:
    """Costs to go and first edits before ``symbol``, from the costs to go after it."""
    options: list[dict[str, tuple[int, int]]] = []
    for state in range(4):
        choice = {"D": (_DELETE + after[state], state)}
        if symbol != "x":
            extra = _TRUNCATED if symbol.isupper() else 0
            kept = _KEEP.get((state, symbol.lower()))
            if kept is not None:
                choice["K"] = (extra + after[kept], kept)
            choice["R"] = (extra + _REROLE + after[_NEXT[state]], _NEXT[state])
        options.append(choice)
    costs = [min(c for c, _ in choice.values()) for choice in options]
    for _ in range(3):
        costs = [min(c, _INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    for state, choice in enumerate(options):
        choice["I"] = (_INSERT + costs[_NEXT[state]], _NEXT[state])
    edits = tuple(min((letter, to) for letter, (c, to) in choice.items() if c == costs[s]) for s, choice in enumerate(options))
    return tuple(costs), edits


class SuffixPath:
    """The automaton's nodes along one signature's suffixes; the next signature in order of its end reuses the shared ones."""

    def __init__(self, base: tuple[Costs, Edits]):
        self.nodes, self.symbols, self.made = [base], "", 0

    def follow(self, reversed_signature: str) -> None:
        shared = 0
        for a, b in zip(self.symbols, reversed_signature):
            if a != b:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for symbol in reversed_signature[shared:]:
            least, after = _relaxed(self.nodes[-1][0])
            costs, edits = _edge(symbol, after)
            self.nodes.append((tuple(c + least for c in costs), edits))
        self.made += len(reversed_signature) - shared
        self.symbols = reversed_signature

    def costs(self) -> Costs:
        return self.nodes[-1][0]

    def audit(self, state: int) -> tuple[str, int, int]:
        """Best edits from ``state`` to the end of the signature, their cost, and the state reached."""
        letters, at, first = [], len(self.nodes) - 1, self.nodes[-1][0][state]
        while True:
            letter, to = self.nodes[at][1][state]
            if not letter:
                return "".join(letters), first - self.nodes[at][0][state], state
            letters.append(letter)
            state, at = to, at - (letter != "I")


def _base(name: str) -> tuple[Costs, Edits]:
    """What follows a signature: nothing more (empty name), or a segment of the named costs to go."""
    if not name:
        return _FINAL
    return tuple(int(x) for x in name.split(",")), tuple(("", s) for s in range(4))


_MATRICES = "signature string, matrix array<bigint>"
_AUDITS = "signature string, rest string, audits array<string>, costs array<bigint>, ends array<int>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def _matrices(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    units = [tuple(0 if s == end else _BEYOND for s in range(4)) for end in range(4)]
    paths = [SuffixPath((unit, tuple(("", s) for s in range(4)))) for unit in units]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for signature in batch.column(0).to_pylist():
                for path in paths:
                    path.follow(signature)
                yield signature, [min(path.costs()[s], _BEYOND) for s in range(4) for path in paths]

    yield from _in_batches(rows(), schema)


def _audits(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        path, name = SuffixPath(_FINAL), ""
        for batch in batches:
            for rest, signature in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rest != name:
                    path, name = SuffixPath(_base(rest)), rest
                path.follow(signature)
                # A conversation's first segment, which most are, begins in state 0.
                found = [path.audit(s) if s == 0 or path.costs()[s] < _BEYOND else ("", 0, s) for s in range(4)]
                yield signature, rest, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

    yield from _in_batches(rows(), schema, 500)


def _rests(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go after every segment; a conversation's segments arrive last one first."""
    def rows() -> Iterator[tuple]:
        conversation, after = object(), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["conversation"] != conversation:
                    conversation, after = row["conversation"], None
                yield row["part"], row["number"], "" if after is None else ",".join(map(str, after))
                matrix, end = row["matrix"], _FINAL[0] if after is None else after
                after = _relaxed(tuple(min(matrix[4 * s + e] + end[e] for e in range(4)) for s in range(4)))[1]

    yield from _in_batches(rows(), schema)


def _segments(segment: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures, reversed, and counts of segments; turns arrive in order, equal ones as one row with their number."""
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        number, conversation, begun, open_, held = 0, object(), 0, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["conversation"] != conversation or not begun:
                    if open_ is not None:
                        # The first conversation here may have begun in the part before.
                        yield _closed(open_, part, number, begun > 1 and held == 0)
                        number += 1
                    conversation, begun, held, open_ = row["conversation"], begun + 1, 0, None
                left, fault = row["copies"], row["fault"]
                while left:
                    if open_ is not None and len(open_["symbols"]) >= segment:
                        yield _closed(open_, part, number, False)
                        number, held, open_ = number + 1, held + 1, None
                    if open_ is None:
                        open_ = {**row, "symbols": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": row["initial"],
                                 "last": None, "low": None, "high": None, "turns": 0}
                    first = left == row["copies"]
                    take = 1 if first else min(left, segment - len(open_["symbols"]))
                    fault = row["fault"] if first or row["fault"] == "blank" else "duplicate"
                    if fault:
                        open_[fault] += take
                    open_["symbols"] += [row["symbol"] if first else "x"] * take
                    if open_["last"] is not None:
                        open_["illegal"] += open_["last"] + row["initial"] not in _LEGAL
                    open_["illegal"] += take - 1  # no role may follow itself
                    open_["last"] = row["initial"]
                    if row["turn"] is not None and row["turn"] != open_["high"]:
                        open_["low"] = row["turn"] if open_["low"] is None else open_["low"]
                        open_["high"], open_["turns"] = row["turn"], open_["turns"] + 1
                    left -= take
        if open_ is not None:
            yield _closed(open_, part, number, False)

    yield from _in_batches(rows(), schema)


def _closed(s: dict, part: int, number: int, alone: bool) -> tuple:
    return (s["conversation"], s["turn"], s["role"], s["digest"], part, number, alone, "".join(reversed(s["symbols"])), s["blank"],
            s["duplicate"], s["truncated"], s["illegal"], s["first"], s["last"], s["low"], s["high"], s["turns"])


class _Repair:
    """One conversation as its segments' edits and its turns arrive in order."""

    def __init__(self, conversation):
        self.conversation, self.edits, self.ahead, self.state = conversation, deque(), 0, 0
        self.audit, self.cost, self.counts = [], 0, dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.last = None
        self.turns = 0

    def add(self, segment: dict) -> None:
        audit = segment["audits"][self.ahead]
        self.cost += segment["costs"][self.ahead]
        self.ahead = segment["ends"][self.ahead]
        self.audit.append(audit)
        self.edits.extend([letter, len(list(run))] for letter, run in groupby(audit))
        for name in self.counts:
            self.counts[name] += segment[name]
        if self.last is not None:
            self.counts["illegal"] += self.last + segment["first"] not in _LEGAL
        self.last = segment["last"]
        if segment["low"] is not None:
            self.turns += segment["turns"] - (segment["low"] == self.high)
            self.low = segment["low"] if self.low is None else self.low
            self.high = segment["high"]

    def _next(self) -> str:
        run = self.edits[0]
        run[1] -= 1
        if not run[1]:
            self.edits.popleft()
        return run[0]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.edits and self.edits[0][0] == "I":
            self.state = _NEXT[self.state]
            yield self._next(), _ROLE[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edit, role and text of the turns that a turn becomes, those inserted before it included."""
        yield from self.inserted()
        letter = self._next()
        if letter == "K":
            self.state = _KEEP[self.state, role[0]]
            yield letter, role, text
        elif letter == "R":
            self.state = _NEXT[self.state]
            yield letter, _ROLE[self.state], text

    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, _LONG)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Repair, str, str, str] | tuple[_Repair, None, None, None]]:
    """Repaired turns of every conversation, then one item without a turn."""
    repair = None
    for batch in batches:
        for row in batch.to_pylist():
            if repair is None or row["conversation"] != repair.conversation:
                if repair is not None:
                    yield from ((repair, *x) for x in repair.inserted())
                    yield repair, None, None, None
                repair = _Repair(row["conversation"])
            if row["kind"] == 1:
                repair.add(row["segment"])
            elif row["kind"] == 2:
                yield from ((repair, *x) for x in repair.turn(row["role"], row["text"]))
    if repair is not None:
        yield from ((repair, *x) for x in repair.inserted())
        yield repair, None, None, None


def _repaired(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        place = 0
        for repair, edit, role, text in _conversations(batches):
            if edit is None:
                place = 0
            else:
                yield repair.conversation, place, role, text, edit
                place += 1

    yield from _in_batches(rows(), schema, 1000)


def _summaries(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        digest, joined = hashlib.sha256(), False
        for repair, edit, role, text in _conversations(batches):
            if edit is None:
                yield repair.conversation, repair.gaps(), *repair.counts.values(), repair.cost, "".join(repair.audit), digest.hexdigest()
                digest, joined = hashlib.sha256(), False
            else:
                digest.update(f"{chr(10) if joined else ''}{role}:{text}".encode())
                joined = True

    yield from _in_batches(rows(), schema, 1000)


def damaged(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with one fault in four of 20: columns conversation, turn, role, text, dropped (such a turn is no longer there)."""
    key = F.concat(F.coalesce(F.col(id).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    fault, own = F.crc32(key) % 20, F.coalesce(F.col(text), F.lit(" "))
    changed = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(own, ".!?", "")).otherwise(own)
    rows = turns.select(
        F.col(id).alias("conversation"), F.col(turn).cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        changed.alias("text"), (fault == 0).alias("dropped"), F.when(fault == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def _as_turns(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(
        F.col(id).alias("conversation"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))


def _planned(rows: DataFrame, kind: str, segment: int) -> DataFrame:
    """The segments of all conversations with their signatures and best edits for each state they may begin in."""
    text, initial = F.col("text"), F.substring("role", 1, 1)
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    light = rows.filter("NOT dropped").select(
        "conversation", "turn", "role", _digest().alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    light = light.groupBy("conversation", "turn", "role", "digest", "blank", "open").agg(F.count("*").alias("copies"))
    firsts = light.groupBy(F.col("conversation").alias("_c"), F.col("digest").alias("_d")).agg(
        F.min("turn").alias("_first"), F.bool_or(F.col("turn").isNull()).alias("_null"))
    joined = light.join(firsts, F.col("conversation").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")))
    later = F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_first"))
    fault = F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("open"), "truncated")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(fault.isin("blank", "duplicate"), "x").when(F.col("open"), F.upper(known)).otherwise(known)
    order = ["conversation", F.col("turn").asc_nulls_first(), "role", "digest"]
    turns = joined.select("conversation", "turn", "role", "digest", "copies", fault.alias("fault"), symbol.alias("symbol"), initial.alias("initial"))
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    segments = written(_mapped(turns, partial(_segments, segment), (
        f"conversation {kind}, turn long, role string, digest binary, part int, number int, alone boolean, signature string, blank long, "
        "duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long")), "segments")

    several = segments.filter("NOT alone")
    matrices = _mapped(_by_end(several.select("signature").distinct(), "signature"), _matrices, _MATRICES)
    chained = several.select("conversation", "part", "number", "signature").join(matrices, "signature").repartition("conversation")
    chained = chained.sortWithinPartitions("conversation", F.desc("part"), F.desc("number"))
    rests = _mapped(chained.select("conversation", "part", "number", "matrix"), _rests, "part int, number int, rest string")
    whole = segments.filter("alone").withColumn("rest", F.lit("")).unionByName(several.join(rests, ["part", "number"]))
    distinct = _by_end(whole.select("rest", "signature").distinct(), "rest", "signature")
    return whole.join(_mapped(distinct, _audits, _AUDITS), ["signature", "rest"])


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    return df.mapInArrow(partial(function, to_arrow_schema(StructType.fromDDL(schema))), schema)


def _by_end(df: DataFrame, *order: str) -> DataFrame:
    """Signatures, written from their end, in order: neighbours share suffixes."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def _in_order(rows: DataFrame, kind: str, length: int) -> DataFrame:
    """Turns in order, each segment before its first turn; dropped turns only name their conversation."""
    plan = _planned(rows, kind, length)
    segment = F.struct("audits", "costs", "ends", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")
    plan = plan.select("conversation", "turn", "role", "digest", F.lit(1).alias("kind"), "part", "number", segment.alias("segment"),
                       F.lit(None).cast("string").alias("text"))
    there = ~F.col("dropped")
    own = rows.select(
        "conversation", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"),
        F.when(there, _digest()).alias("digest"), F.when(there, 2).otherwise(0).alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("number"),
        F.lit(None).cast(plan.schema["segment"].dataType).alias("segment"), F.when(there, F.col("text")).alias("text"))
    both = own.unionByName(plan).repartition("conversation")
    order = ["conversation", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("digest").asc_nulls_first(), "kind", "part", "number"]
    return both.sortWithinPartitions(*order).select("conversation", "kind", "role", "segment", "text")


def repair_turns(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
) -> DataFrame:
    """The turns of the repaired conversations: the id, place (from 0), role, text, edit (K kept, R given a role, I inserted)."""
    kind = turns.schema[id].dataType.simpleString()
    found = _mapped(_in_order(_as_turns(turns, id, turn, role, text), kind, segment), _repaired,
                    f"conversation {kind}, place long, role string, text string, edit string")
    return found.withColumnRenamed("conversation", id)


def repair_summaries(rows: DataFrame, id: str = "conv_id", segment: int = SEGMENT) -> DataFrame:
    """Faults, cost, audit and digest of the repaired text of every conversation of ``damaged`` turns."""
    kind = rows.schema["conversation"].dataType.simpleString()
    found = _mapped(_in_order(rows, kind, segment), _summaries, (
        f"conversation {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string"))
    return found.withColumnRenamed("conversation", id)
