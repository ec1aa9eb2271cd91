"""Repair of conversations at the least cost, so that roles read: maybe one system turn, then user and assistant by turns.

The turns that stay, kept or reroled, are a subsequence of a conversation. A program over that subsequence, from its end,
prices each turn that may come next: the turns between are deleted, for a difference of prefix sums, and the roles of
the two tell how many empty turns must be inserted. So for each role the next turn costs a running minimum, and a
conversation is priced in one pass. Of equally cheap repairs the one whose audit, its edits in order, is the least in
ASCII is taken; as a D comes before all other edits, that is the one whose next kept turn is the farthest.

Rows are put in order by ranges, so a conversation of any length may lie in several blocks of bounded size. Of a
conversation inside one block everything is found there. For others a block gives what it costs to get from each state to
each other and how the audits of these ways compare; the ways are put together by conversation, and each block is then
repaired between the states that were chosen. Only the hash of the repaired text runs through a conversation from its
start to its end, batch by batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import column_bytes, materialise

#: Fixed prices: to change a role, to delete, to insert, and to leave a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and bytes of text of a block; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20

#: States: nothing yet, or the role of the last turn. Roles are states too.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_ROLE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 60
#: Inserts between a state and the role of the next turn. A system turn only comes first.
_INSERTS = {(NOTHING, SYSTEM): 0} | {(q, USER): int(q == USER) for q in range(4)} | {(q, ASSISTANT): int(q != USER) for q in range(4)}
#: Inserts after the last turn.
_CLOSING = (0, 2, 1, 0)
#: Faults of a turn.
FINE, CUT, GONE = range(3)


class Repair:
    """The cheapest ways through turns of the given roles (the states above, None for others) and faults.

    ends: what each last state costs; the audit leaves out what is inserted after the last turn.
    """

    def __init__(self, roles: list[int | None], faults: list[int], ends: list[int]):
        n = len(roles)
        self.n = n
        before = [0] * (n + 1)  # prices of deleting the first turns
        for i in range(n):
            before[i + 1] = before[i] + DELETE
        # For each role: the least of a next turn of that role, with all deletions before it, and that turn. An earlier
        # one only counts if it is cheaper, as the audit of the later one has a D where its own has something else.
        least, turn = [_NEVER] * 4, [n] * 4
        self.next: list[list[tuple[int, int] | None]] = [[None] * 4 for _ in range(n)]

        def after(i: int, state: int) -> tuple[int, tuple[int, int] | None]:
            """The cost of all that follows turn i in that state, and the next turn with its role, or None."""
            done = before[i + 1]
            best, order, chosen = ends[state] + before[n] - done, (-n, ""), None
            for role in (SYSTEM, USER, ASSISTANT):
                if least[role] >= _NEVER or (inserts := _INSERTS.get((state, role))) is None:
                    continue
                cost = least[role] - done + INSERT * inserts
                if cost <= best:
                    j = turn[role]
                    audit = (-j, "I" * inserts + ("K" if roles[j] == role else "R"))
                    if cost < best or audit < order:
                        best, order, chosen = cost, audit, (j, role)
            return best, chosen

        for i in range(n - 1, -1, -1):
            if faults[i] == GONE:
                continue
            left, found = TRUNCATED * (faults[i] == CUT), []
            for role in (SYSTEM, USER, ASSISTANT):
                if role == SYSTEM and roles[i] != SYSTEM:
                    continue
                cost, self.next[i][role] = after(i, role)
                found.append((role, before[i] + left + REROLE * (roles[i] != role) + cost))
            for role, cost in found:
                if cost < least[role]:
                    least[role], turn[role] = cost, i
        self.roles = roles
        self.first = [after(-1, state) for state in range(4)]

    def cost(self, state: int) -> int:
        return self.first[state][0]

    def edits(self, state: int) -> Iterator[tuple[str, int | None, int | None]]:
        """Edit, turn and role: turns deleted and kept, and roles inserted, in order."""
        at, chosen = 0, self.first[state][1]
        while chosen is not None:
            j, role = chosen
            for i in range(at, j):
                yield "D", i, None
            if _INSERTS[state, role]:
                yield "I", None, USER if role == ASSISTANT else ASSISTANT
            yield ("K" if self.roles[j] == role else "R"), j, role
            at, state, chosen = j + 1, role, self.next[j][role]
        for i in range(at, self.n):
            yield "D", i, None

    def audit(self, state: int) -> str:
        return "".join(e for e, _, _ in self.edits(state))


def _closing(state: int) -> list[str]:
    """The turns inserted after the last one."""
    return [["user:", "assistant:"], ["assistant:"]][state - 1] if _CLOSING[state] else []


WHOLE = [INSERT * k for k in _CLOSING]


def _last_state(repair: Repair, state: int) -> int:
    for _, _, role in repair.edits(state):
        state = role if role is not None else state
    return state


def _lines(repair: Repair, state: int, role: list[str], text: list[str]) -> list[str]:
    """role:text of all turns that stay or are inserted."""
    out = []
    for edit, i, new in repair.edits(state):
        if edit == "K":
            out.append(f"{role[i]}:{text[i]}")
        elif edit == "R":
            out.append(f"{_NAMES[new]}:{text[i]}")
        elif edit == "I":
            out.append(f"{_NAMES[new]}:")
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: by crc32 of `conv_id:turn` modulo 20 a row goes (0), loses its text (1) or its sentence
    ends (2), is there twice (3) or is the user's (4). A null is one space, but for the conv_id and turn that are returned."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20).alias("kind"))
    rows = rows.where("kind <> 0").withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _placed(block_rows: int, block_bytes: int):
    """Adds part, block and place, so that they order the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled, place = TaskContext.get().partitionId(), 0.0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # Each row counts for its share of a block's rows and bytes.
            fills = np.cumsum(np.diff(column_bytes(batch.column("text"))[1]) / block_bytes + 1 / block_rows) + filled
            columns = [pa.array(np.full(n, part)), pa.array(np.floor(fills).astype(np.int64)), pa.array(np.arange(place, place + n))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns], names=["part", "block", "place", *batch.schema.names])
            filled, place = float(fills[-1]), place + n

    return run


def _segments(rows: pa.Table, again: pa.Table) -> Iterator[tuple[int, int, dict]]:
    """First row, row after the last and columns of each conversation of a block; faults are in the column `fault`."""
    rows = rows.sort_by("place")
    found = {c: rows.column(c).to_pylist() for c in rows.schema.names}
    repeated = set(again.column("place").to_pylist())
    found["blank_"] = found["blank"]
    found["duplicate_"] = [p in repeated for p in found["place"]]
    found["fault"] = [GONE if b or d else CUT if t else FINE for b, d, t in zip(found["blank"], found["duplicate_"], found["cut"], strict=True)]
    ids, start = found["conv_id"], 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[start]:
            yield start, i, found
            start = i


_NUMBERS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {"su", "ua", "au"}


def _found(schema: pa.Schema):
    """Of each conversation of a block: all of it if it is in the middle of the block, else what its ways cost."""

    def run(key, rows, again):
        out, n = [], rows.num_rows
        for a, b, x in _segments(rows, again):
            role, fault = x["role"][a:b], x["fault"][a:b]
            roles, first = [_ROLE.get(r[:1]) for r in role], [r[:1] for r in role]
            row = {"conv_id": x["conv_id"][a], "part": key[0].as_py(), "block": key[1].as_py(), "open": a == 0 or b == n, "first": first[0], "last": first[-1]}
            row |= {"blank": sum(x["blank_"][a:b]), "duplicate": sum(d and not s for d, s in zip(x["duplicate_"][a:b], x["blank_"][a:b], strict=True)), "truncated": fault.count(CUT)}
            row["illegal"] = sum(p + q not in _LEGAL for p, q in zip(first, first[1:], strict=False))
            if row["open"]:
                ways = [Repair(roles, fault, [0 if q == end else _NEVER for q in range(4)]) for end in range(4)]
                row["costs"] = [w.cost(q) if w.cost(q) < _NEVER else -1 for q in range(4) for w in ways]
                row["order"] = []
                for q in range(4):
                    audits = [w.audit(q) if w.cost(q) < _NEVER else "~" for w in ways]
                    row["order"] += [sorted(audits).index(s) for s in audits]
            else:
                best = Repair(roles, fault, WHOLE)
                closing = _closing(_last_state(best, NOTHING))
                row |= {"cost": best.cost(NOTHING), "audit": best.audit(NOTHING) + "I" * len(closing), "repaired_sha256": hashlib.sha256("\n".join(_lines(best, NOTHING, role, x["text"][a:b]) + closing).encode()).hexdigest()}
            out.append(row)
        return pa.Table.from_pylist(out, schema)

    return run


def _joined(schema: pa.Schema):
    """The states in which the parts of one conversation begin and end, and its numbers."""

    def run(key, table):
        parts = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
        rest = [WHOLE]
        ways = [[[c if c >= 0 else _NEVER for c in r["costs"][4 * q : 4 * q + 4]] for q in range(4)] for r in parts]
        for way in reversed(ways):
            rest.append([min(way[q][p] + rest[-1][p] for p in range(4)) for q in range(4)])
        rest.reverse()
        out, state = [], NOTHING
        for k, (r, way) in enumerate(zip(parts, ways, strict=True)):
            end = min(range(4), key=lambda p: (way[state][p] + rest[k + 1][p], r["order"][4 * state + p]))
            row = {c: r[c] for c in ("conv_id", "part", "block", "blank", "duplicate", "truncated")} | {"entry": state, "exit": end, "cost": 0 if k else rest[0][NOTHING]}
            out.append(row | {"illegal": r["illegal"] + (k > 0 and parts[k - 1]["last"] + r["first"] not in _LEGAL), "closing": k + 1 == len(parts)})
            state = end
        return pa.Table.from_pylist(out, schema)

    return run


def _pieces(schema: pa.Schema):
    """The audit and the repaired lines of the part of a conversation that a block holds."""

    def run(key, rows, again):
        out = []
        for a, b, x in _segments(rows, again):
            role, entry, end = x["role"][a:b], x["entry"][a], x["exit"][a]
            repair = Repair([_ROLE.get(r[:1]) for r in role], x["fault"][a:b], [0 if q == end else _NEVER for q in range(4)])
            closing = _closing(end) if x["closing"][a] else []
            lines = _lines(repair, entry, role, x["text"][a:b]) + closing
            out.append({"conv_id": x["conv_id"][a], "part": key[0].as_py(), "block": key[1].as_py(), "audit": repair.audit(entry) + "I" * len(closing), "repaired": "\n".join(lines).encode() if lines else None})
        return pa.Table.from_pylist(out, schema)

    return run


def _hashed(schema: pa.Schema):
    """audit and hash of each conversation from its pieces in order; none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, audit, some = None, None, [], False

        def end() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if sha is None or row["conv_id"] != now:
                    if sha is not None:
                        yield end()
                    now, sha, audit, some = row["conv_id"], hashlib.sha256(), [], False
                audit.append(row["audit"])
                if row["repaired"] is not None:
                    sha.update(b"\n" * some + row["repaired"])
                    some = True
        if sha is not None:
            yield end()

    return run


def _arrow(ddl: str, id_type: pa.DataType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([("conv_id", id_type), *((n, kinds[k]) for n, k in (f.split() for f in ddl.split(", ")))])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair_conversations(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conv_id of turns
    (conv_id, turn, role, text), as they are, damage done or not.

    Rows go by turn, nulls first, equal ones by role and SHA-256 of the text. blank, duplicate and truncated count the first
    fault of each row; gaps counts the numbers missing between the smallest and the largest turn. cost, audit and the hash
    of the `role:text` lines are those of the cheapest repair: Keep, Delete, Rerole to user or assistant, Insert. Null
    roles and texts count as one space, so such a text is blank; a role is known by its first letter, other roles are
    deleted or changed. Null ids are one conversation. Without rows there is no conversation; other columns are not
    looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spaced = lambda c: F.coalesce(F.col(c), F.lit(" "))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"))
    rows = rows.select("*", F.sha2("text", 256).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    order = ["conv_id", "turn", "role", "digest"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_placed(block_rows, block_bytes), f"part bigint, block bigint, place bigint, {kinds}"), "turns")

    said = placed.where("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "place")).alias("at"), F.count("*").alias("n")).where("n > 1")
    said = materialise(said.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "at"), "said-twice")
    again = placed.join(said, _same(F.col("conv_id"), F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))).where(F.struct("part", "place") != F.col("at"))
    again = materialise(again.select("part", "block", "place"), "said-again")

    kind, id_type = placed.schema["conv_id"].dataType.simpleString(), to_arrow_type(placed.schema["conv_id"].dataType)
    by_block = lambda df: df.groupBy("part", "block")

    def together(df: DataFrame, make, ddl: str, name: str) -> DataFrame:
        return materialise(by_block(df).cogroup(by_block(again)).applyInArrow(make(_arrow(ddl, id_type)), f"conv_id {kind}, {ddl}"), name)

    slim = ["part", "block", "place", "conv_id", "role", "text", "blank", "cut"]
    results = "audit string, repaired_sha256 string"
    numbers = ", ".join(f"{c} bigint" for c in _NUMBERS)
    found = together(placed.select(*slim), _found, f"part bigint, block bigint, open boolean, first string, last string, {numbers}, {results}, costs array<bigint>, order array<bigint>", "conversations")

    ddl = f"part bigint, block bigint, {numbers}, entry bigint, exit bigint, closing boolean"
    joined = materialise(found.where("open").groupBy("conv_id").applyInArrow(_joined(_arrow(ddl, id_type)), f"conv_id {kind}, {ddl}"), "joined")
    states = joined.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("k"), "entry", "exit", "closing")
    split = placed.select(*slim).join(states, (F.col("part") == F.col("p")) & (F.col("block") == F.col("k")) & _same(F.col("conv_id"), F.col("c")))
    pieces = together(split.select(*slim, "entry", "exit", "closing"), _pieces, "part bigint, block bigint, audit string, repaired binary", "pieces")
    in_order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    texts = in_order.mapInArrow(_hashed(_arrow(results, id_type)), f"conv_id {kind}, {results}")

    totals = joined.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _NUMBERS])
    texts = texts.withColumnRenamed("conv_id", "c")
    long = totals.join(texts, _same(F.col("conv_id"), F.col("c"))).select("conv_id", *_NUMBERS, "audit", "repaired_sha256")
    all_ = long.unionByName(found.where("NOT open").select("conv_id", *_NUMBERS, "audit", "repaired_sha256"))
    spans = placed.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return all_.join(spans, _same(F.col("conv_id"), F.col("c"))).select("conv_id", "gaps", *_NUMBERS, "audit", "repaired_sha256")


def with_missing(repaired: DataFrame, turns: DataFrame) -> DataFrame:
    """repaired, and a row for each conv_id of turns that it lacks: zeros, an empty audit and the hash of nothing."""
    ids = turns.select(F.col("conv_id").alias("asked")).distinct()
    nothing = F.lit(hashlib.sha256().hexdigest())
    joined = ids.join(repaired, _same(F.col("asked"), F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *_NUMBERS)]
    return joined.select(F.col("asked").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
