"""Repair of conversations: the cheapest edits that leave an optional system turn and then pairs of user and assistant.

Each row's fault is found by Spark: blank (nothing but ASCII white space), duplicate (its role and text
came earlier), truncated (does not end in . ! or ?). A row is then one byte, of its role's initial and
its fault, and a task reads its conversations' bytes in order and searches for the edits: depth first,
with an explicit stack, lower bounds of what a suffix must cost, an incumbent, and for each node (rows
done, what the repaired turns end in) the least cost it was reached at. Of equal costs the audit (the
edits' initials) that is least in ASCII wins. Texts are read again, in order, with the edits before
them, to digest the repaired conversation; so a task holds a byte or two for each row of one
conversation, never its texts.

Edits: Keep (0; not of a blank or duplicate row), Rerole to user or assistant (2; likewise), Delete (3),
Insert an empty user or assistant turn (2). A truncated row that stays adds 1.

Nulls are read as one space, but for turn in the order (nulls first). Rows of one turn are in the order
of role and text's hashes; repeated rows are duplicates. Only initials s, u and a can be kept. A null
conv_id is a conversation of its own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import importable, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What the repaired turns end in: nothing yet, s, u, a; and where a turn of each initial leads from there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DONE = (True, False, False, True)
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
MEMO = 50_000
NEVER = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
ORDER = ["conv_id", "turn", "role", "h1", "h2", "copy"]  # ascending: nulls first


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, h1, h2, copy, gone): rows after damage by crc32 of `conv_id:turn` modulo 20: 0 drops a row (gone; it stays as a mark of its conversation), 1 empties its text, 2 takes out . ! and ?, 3 repeats it, 4 makes its role user. h1 and h2, hashes of the text before, keep the order of rows of one turn."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat(plain[0], F.lit(":"), plain[1]), "UTF-8")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    out = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows as `damaged` gives them, as they are."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"), F.lit(False).alias("gone"), F.lit(0).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, copy, gone, code): code is 4 * fault + initial, by FAULTS and INITIALS."""
    own = F.struct("role", F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"), F.octet_length("text").alias("n"))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    marked = rows.select("conv_id", "turn", "role", "h1", "h2", "copy", "gone", own.alias("own"), last.alias("last"))
    initial = F.when(F.substring("role", 1, 1) == "s", 0).when(F.substring("role", 1, 1) == "u", 1).when(F.substring("role", 1, 1) == "a", 2).otherwise(3)
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "own").orderBy(*ORDER)) > 1
    fault = F.when(F.col("last") == "", 1).when(again, 2).when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0)
    return marked.withColumn("initial", initial).select("conv_id", "turn", "role", "h1", "h2", "copy", "gone", (4 * fault + F.col("initial")).alias("code"))


def moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of a row, in order of their initials."""
    fault, initial = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault in (0, 3):
        more = TRUNCATED * (fault == 3)
        if (after := NEXT[state].get(INITIALS[initial])) is not None:
            out.append(("K", KEEP + more, after))
        out.extend(("R", REROLE + more, after) for x, after in NEXT[state].items() if x != "s")
    return out


#: Of each code and state, the moves of a row; of each state, where an inserted turn leads.
MOVES = [[moves(code, state) for state in range(4)] for code in range(16)]
INSERTS = [next(after for x, after in NEXT[state].items() if x != "s") for state in range(4)]


def bounds(codes: bytes) -> list[tuple[int, ...]]:
    """For each suffix and state, a cost that no completion undercuts: a pass from the end."""
    def settled(costs: list[int]) -> tuple[int, ...]:
        for _ in range(3):  # three inserts reach every state
            costs = [min(c, INSERT + costs[INSERTS[s]]) for s, c in enumerate(costs)]
        return tuple(costs)

    out = [settled([0 if x else NEVER for x in DONE])]
    for code in reversed(codes):
        after = out[-1]
        out.append(settled([min(cost + after[to] for _, cost, to in MOVES[code][s]) for s in range(4)]))
    return out[::-1]


def search(codes: bytes) -> tuple[int, str]:
    """The least cost and, of the edits that have it, the audit that is least in ASCII.

    A node's edits are tried in order of their initials (D, I, K, R), so that of prefixes that reach a
    node at one cost the first is the least; a later one is pruned, as is a prefix whose cost and
    suffix's bound are over the incumbent's cost, until no prefix is left. Prefixes of equal cost at a node never begin one
    another: only inserts lead back to a node, and they cost.
    """
    least, n = bounds(codes), len(codes)
    incumbent, audit = least[0][0], None  # a bound that dearer prefixes are held to before the first completion
    best = [[NEVER] * 4 for _ in range(n + 1)]
    path: list[str] = []
    stack = [(0, 0, 0, 0, "")]  # rows done, state, cost, length of the path before, edit
    while stack:
        i, state, cost, depth, edit = stack.pop()
        if cost >= best[i][state] or cost + least[i][state] > incumbent:
            continue
        best[i][state] = cost
        del path[depth:]
        path.append(edit)
        if i == n and DONE[state]:
            found = "".join(path)
            if audit is None or (cost, found) < (incumbent, audit):
                incumbent, audit = cost, found
        children = [("I", INSERT, i, INSERTS[state])]
        if i < n:
            children += [(e, c, i + 1, to) for e, c, to in MOVES[codes[i]][state]]
        for e, c, j, to in sorted(children, reverse=True):
            stack.append((j, to, cost + c, depth + 1, e))
    return incumbent, audit


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, gone, code) sorted by conversation and order, as a row for each conversation."""
    known: dict[bytes, tuple[int, str]] = {}
    rows: list[tuple] = []
    conv: object = known  # no conversation yet
    codes, turns, first, last = bytearray(), 0, None, None

    def close() -> None:
        key = bytes(codes)
        if key not in known:
            if len(known) > MEMO:
                known.clear()
            known[key] = search(key)
        marks = "".join(INITIALS[x & 3] for x in key)
        illegal = sum(marks[i : i + 2] not in ("su", "ua", "au") for i in range(len(marks) - 1))
        gaps = 0 if first is None else min(last - first + 1 - turns, (1 << 63) - 1)
        count = [sum(x >> 2 == f for x in key) for f in (1, 2, 3)]
        rows.append((conv, gaps, *count, illegal, *known[key]))

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RESULT)], schema=RESULT)
        rows.clear()
        return out

    for part in batches:
        for c, turn, gone, code in zip(*(x.to_pylist() for x in part.columns)):
            if c != conv:
                if conv is not known:
                    close()
                conv, codes, turns, first, last = c, bytearray(), 0, None, None
            if gone:
                continue
            codes.append(code)
            if turn is not None and turn != last:
                turns, first, last = turns + 1, turn if first is None else first, turn
        if len(rows) > 1000:
            yield batch()
    if conv is not known:
        close()
    if rows:
        yield batch()


def repaired(audit: str, roles: Iterator[tuple[str, str]]) -> Iterator[str]:
    """`role:text` of each repaired turn."""
    state = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(roles)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = NEXT[state][role[0]]
        yield f"{role}:{text}"


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, audit, role, text): each conversation's audit, then its rows in order; as (conv_id, repaired_sha256)."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(x.to_pylist() for x in b.columns))

    out: list[tuple] = []
    names, types = ["c", "repaired_sha256"], [pa.int64(), pa.string()]
    stream = rows()
    row = next(stream, None)
    while row is not None:
        conv, audit = row[0], row[1]
        following = None

        def own() -> Iterator[tuple[str, str]]:
            nonlocal following
            for x in stream:
                if x[1] is not None:
                    following = x
                    return
                yield x[2], x[3]

        turns, sha, begun = own(), hashlib.sha256(), False
        for line in repaired(audit, turns):
            sha.update((("\n" if begun else "") + line).encode())
            begun = True
        if next(turns, None) is not None:
            raise ValueError(f"conversation {conv} has more rows than its audit edits")
        out.append((conv, sha.hexdigest()))
        row = following
        if len(out) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of `damaged` or `undamaged` rows."""
    importable(rows.sparkSession)
    coded = faults(rows).repartition("conv_id").sortWithinPartitions(*ORDER).select("conv_id", "turn", "gone", "code")
    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    found = stored(coded.mapInArrow(searched, kinds), "audits")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("h1", "long"), ("h2", "long"), ("copy", "int"))]
    both = rows.where("NOT gone").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "h1", "h2", "copy").unionByName(found.select("conv_id", "audit", *none))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *ORDER[1:]).select("conv_id", "audit", "role", "text")
    texts = both.mapInArrow(digested, "c long, repaired_sha256 string")
    return found.join(texts, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
