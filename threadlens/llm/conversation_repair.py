"""Cheapest repair of a conversation's turn structure by the auction shortest-path algorithm.

The role initials of a repaired conversation read ``(s?(ua)+)?``. Its edits are
a path through a lattice with a node for each (row, state of that pattern):
Keep, Rerole and Delete lead to the next row, Insert to another state before
the same row; all costs are integers. The auction keeps a price for each node
and one path from the start. The path's last node either raises its price to
the least of cost + price over its arcs, and the path contracts by one, or the
path extends by such an arc. Prices never break price(i) <= cost + price(j), so
when the path reaches the end, every shortest path consists of tight arcs
alone, and the ASCII-least one is traced over these, letter by letter.

Conversations of at most CHUNK rows and CHUNK_BYTES are repaired one after the
other in the tasks that hold them. Longer ones are numbered by a distributed
sort and cut into chunks of CHUNK rows: the auction prices each chunk between
its boundary states, then runs over the lattice of FAN chunks, and so on up;
the exact prices of the boundaries come down the same way, and with them each
chunk is traced on its own. No task holds such a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.staging import bound_batches, stage
from threadlens.operators.sampling import sequence_number

CHUNK = 128
CHUNK_BYTES = 16 << 20
FAN = 64
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
FAR = 1 << 60  # beyond any cost
#: A row's code: its initial (0 s, 1 u, 2 a, 3 other), plus CUT if truncated; GONE must be deleted.
CUT, GONE = 4, 8

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_KEPT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
_ADDED = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_SPACE = r"' \t\n\x0B\f\r'"

Arcs = list[list[tuple[str, int, int]]]


def lattice(codes: bytes, ends: tuple[int, int, int, int], last: bool) -> Arcs:
    """Arcs (letter, cost, node) of each node 4 * row + state, in order of the letter; the end is the last node.

    ``ends`` are the costs from the states after the last row to the end, FAR
    for none. Turns are inserted there only if ``last``: else the next chunk does.
    """
    n, arcs = len(codes), []
    for k in range(n + 1):
        for state in range(4):
            here: list[tuple[str, int, int]] = []
            if k == n:
                if ends[state] < FAR:
                    here.append(("", ends[state], 4 * n + 4))
            else:
                here.append(("D", DELETE, 4 * k + 4 + state))
            if k < n or last:
                here.append(("I", INSERT, 4 * k + _ADDED[state]))
            if k < n and codes[k] < GONE:
                more = UNFINISHED if codes[k] & CUT else 0
                kept = _KEPT[state].get(codes[k] & 3)
                if kept is not None:
                    here.append(("K", KEEP + more, 4 * k + 4 + kept))
                here.append(("R", REROLE + more, 4 * k + 4 + _ADDED[state]))
            arcs.append(here)
    arcs.append([])
    return arcs


def chain(blocks: list[list[int]], ends: tuple[int, int, int, int]) -> Arcs:
    """The lattice over chunks, each with the costs from state to state (row-major, FAR for none)."""
    n = len(blocks)
    arcs = [
        [("", block[4 * s + t], 4 * k + 4 + t) for t in range(4) if block[4 * s + t] < FAR] for k, block in enumerate(blocks) for s in range(4)
    ]
    return arcs + [[("", ends[s], 4 * n + 4)] if ends[s] < FAR else [] for s in range(4)] + [[]]


def auction(arcs: Arcs, price: list[int], origin: int) -> int:
    """The distance from ``origin`` to the last node, which it must reach; raises ``price``."""
    target, path = len(arcs) - 1, [origin]
    while path[-1] != target:
        i = path[-1]
        best, to = FAR, -1
        for _, cost, j in arcs[i]:
            if cost + price[j] < best:
                best, to = cost + price[j], j
        if price[i] < best:
            price[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return price[origin] - price[target]


def reaching(arcs: Arcs) -> list[bool]:
    """Which nodes reach the last one."""
    back: list[list[int]] = [[] for _ in arcs]
    for i, here in enumerate(arcs):
        for _, _, j in here:
            back[j].append(i)
    found, todo = [False] * len(arcs), [len(arcs) - 1]
    while todo:
        j = todo.pop()
        if not found[j]:
            found[j] = True
            todo += back[j]
    return found


def prune(arcs: Arcs) -> tuple[Arcs, list[bool]]:
    """The arcs that lead to the last node: without the others no price rises for ever."""
    live = reaching(arcs)
    return [[a for a in here if live[a[2]]] for here in arcs], live


def trace(arcs: Arcs, price: list[int], origin: int) -> list[tuple[str, int]]:
    """(letter, node left) along the ASCII-least path of tight arcs to the last node."""
    target, path, dead = len(arcs) - 1, [], set()
    i = origin
    while i != target:
        for letter, cost, j in arcs[i]:  # in order of the letter
            if price[i] == cost + price[j] and j not in dead:
                path.append((letter, i))
                i = j
                break
        else:
            dead.add(i)
            i = path.pop()[1]
    return path


@lru_cache(maxsize=1 << 16)
def solve(codes: bytes, ends: tuple[int, int, int, int] = (0, FAR, FAR, 0), last: bool = True, origin: int = 0) -> tuple[int, tuple[tuple[str, int], ...]]:
    """Cost and edits (letter, node left) of the cheapest repair, the ASCII-least one of a tie."""
    arcs, _ = prune(lattice(codes, ends, last))
    price = [0] * len(arcs)
    cost = auction(arcs, price, origin)
    return cost, tuple(trace(arcs, price, origin))


def turns(edits: tuple[tuple[str, int], ...]) -> Iterator[tuple[int | None, str | None]]:
    """(row, new role) of each repaired turn: an inserted one has no row, a kept one no new role."""
    for letter, node in edits:
        if letter == "K":
            yield node // 4, None
        elif letter in ("R", "I"):
            yield (node // 4 if letter == "R" else None), _ROLE[_ADDED[node % 4]]


def audit(edits: tuple[tuple[str, int], ...]) -> str:
    return "".join(letter for letter, _ in edits)


# --- rows ------------------------------------------------------------------------

def _rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, code): null roles and texts are one space; GONE marks blank texts."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    bare = F.expr(f"trim(TRAILING {_SPACE} FROM text)")
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = first + F.when(bare == "", GONE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(0)
    return rows.withColumn("code", code)


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations, and (with ``key`` and ``n``) of long ones, if there are any."""
    key = F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("id "), F.col("conv_id").cast("string")))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("size"))
    long = stage(sizes.filter((F.col("n") > CHUNK) | (F.col("size") > CHUNK_BYTES)).select(key.alias("key"), "n"), "long-conversations")
    if long.isEmpty():
        return rows, None
    keyed = rows.withColumn("key", key)
    return keyed.join(long, "key", "left_anti").drop("key"), keyed.join(long, "key")


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _report(rows: list[tuple]) -> tuple[list, list[tuple[str, str]]]:
    """A short conversation's report, and its repaired (role, text)."""
    known = [r[0] for r in rows if r[0] is not None]
    seen, codes = set(), bytearray()
    blank = duplicate = cut = 0
    for _, role, text, code in rows:
        first = (role, text) not in seen
        seen.add((role, text))
        if code & GONE:
            blank += 1
        elif not first:
            duplicate += 1
        elif code & CUT:
            cut += 1
        codes.append(code if first and not code & GONE else GONE)
    pairs = [(a[3] & 3, b[3] & 3) for a, b in zip(rows, rows[1:])]
    cost, edits = solve(bytes(codes))
    lines = [(role or rows[k][1], "" if k is None else rows[k][2]) for k, role in turns(edits)]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return [gaps, blank, duplicate, cut, sum(p not in _LEGAL for p in pairs), cost, audit(edits), digest], lines


def _sorted(rows: DataFrame) -> DataFrame:
    return bound_batches(rows).select("conv_id", "turn", "role", "text", "code").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """(conv_id, its rows), conversation by conversation, from sorted batches."""
    conv, rows = None, []
    for batch in batches:
        for c, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if rows and c != conv:
                yield conv, rows
                rows = []
            conv = c
            rows.append(tuple(row))
    if rows:
        yield conv, rows


def _short_reports(rows: DataFrame) -> DataFrame:
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(_REPORT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        for conv, own in _each(batches):
            done.append([conv, *_report(own)[0]])
            if len(done) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], arrow)
                done = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], arrow)

    arrow = _arrow(schema)
    return _sorted(rows).mapInArrow(run, schema)


def _short_turns(rows: DataFrame) -> DataFrame:
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL("pos long, role string, text string")])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, own in _each(batches):
            lines = [dict(zip(schema.names, (conv, pos, *line))) for pos, line in enumerate(_report(own)[1])]
            yield pa.RecordBatch.from_pylist(lines, arrow)

    return _sorted(rows).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# --- long conversations ----------------------------------------------------------

def between(arcs_to: list[Arcs]) -> list[int]:
    """Costs from each state at the start to each at the end (row-major), FAR for none."""
    out = [FAR] * 16
    for t, arcs in enumerate(arcs_to):
        arcs, live = prune(arcs)
        price = [0] * len(arcs)
        for s in range(4):
            if live[s]:
                out[4 * s + t] = auction(arcs, price, s)
    return out


def _only(state: int) -> tuple[int, int, int, int]:
    return tuple(0 if s == state else FAR for s in range(4))


def _priced_chunk(codes: bytes, last: bool) -> list[int]:
    # The last chunk also takes what is inserted after its rows.
    return between([lattice(codes, _only(t), last) for t in range(4)])


def _prices(arcs: Arcs, nodes: range) -> list[int]:
    """Distances of ``nodes`` to the last node, FAR for none."""
    arcs, live = prune(arcs)
    price = [0] * len(arcs)
    found = {i: auction(arcs, price, i) if live[i] else FAR for i in reversed(nodes)}
    return [found[i] for i in nodes]


def _per_parent(table: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of each FAN neighbours, a list of rows by idx, gives rows."""
    arrow = _arrow(T.StructType.fromDDL(schema))

    def run(part: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(function(sorted(part.to_pylist(), key=lambda r: r["idx"])), arrow)

    return table.withColumn("parent", F.expr(f"idx div {FAN}")).groupBy("key", "parent").applyInArrow(run, schema)


def _per_row(table: DataFrame, function, schema: str) -> DataFrame:
    arrow = _arrow(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(function(row), arrow)

    return table.mapInArrow(run, schema)


def _combine(rows: list[dict]) -> list[dict]:
    blocks = [r["m"] for r in rows]
    return [{"key": rows[0]["key"], "idx": rows[0]["parent"], "m": between([chain(blocks, _only(t)) for t in range(4)])}]


def _hand_down(rows: list[dict]) -> list[dict]:
    """The prices at each child's end, from the price at the parent's end."""
    arcs = chain([r["m"] for r in rows], tuple(rows[0]["e"]))
    prices = _prices(arcs, range(4 * len(rows) + 4))
    out = []
    for k, r in enumerate(rows):
        own = prices[4 * k + 4 : 4 * k + 8]
        # Only differences matter, and small prices make a short auction.
        out.append({"key": r["key"], "idx": r["idx"], "e": [p if p == FAR else p - min(own) for p in own]})
    return out


def _compose(rows: list[dict]) -> list[dict]:
    to = [0, 1, 2, 3]
    for r in rows:
        to = [r["to"][t] for t in to]
    return [{"key": rows[0]["key"], "idx": rows[0]["parent"], "to": to}]


def _enter(rows: list[dict]) -> list[dict]:
    """The state each child is entered in, from that of the parent."""
    state, out = rows[0]["state"], []
    for r in rows:
        out.append({"key": r["key"], "idx": r["idx"], "state": state})
        state = r["to"][state]
    return out


def _levels(table: DataFrame, combine, column: str, name: str) -> list[DataFrame]:
    """``table`` (key, idx, column), its parents and so on up to one row a conversation."""
    levels = [table]
    while levels[-1].filter("idx > 0").limit(1).count():
        levels.append(stage(_per_parent(levels[-1], combine, f"key string, idx long, {column}"), name))
    return levels


def _down(levels: list[DataFrame], top: DataFrame, function, column: str, name: str) -> DataFrame:
    """From ``top`` (key, idx, column of the top level) down to the lowest one."""
    for level in reversed(levels[:-1]):
        parents = top.withColumnRenamed("idx", "of")
        own = level.join(parents, (level["key"] == parents["key"]) & (F.expr(f"idx div {FAN}") == F.col("of"))).drop(parents["key"]).drop("of")
        top = stage(_per_parent(own, function, f"key string, idx long, {column}"), name)
    return top


def _trace_chunk(row: dict) -> list[dict]:
    """The cheapest edits from each state at the chunk's start."""
    out = []
    codes, ends = bytes(row["codes"]), tuple(row["e"])
    _, live = prune(lattice(codes, ends, row["last"]))
    for state in range(4):
        if live[state]:
            edits = solve(codes, ends, row["last"], state)[1]
            lines = [{"k": k, "role": role} for k, role in turns(edits)]
            out.append({"key": row["key"], "idx": row["idx"], "state": state, "to": edits[-1][1] % 4, "audit": audit(edits), "lines": lines})
    return out


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports of long conversations, without the digest, and their repaired turns (conv_id, key, idx, at, role, text)."""
    numbered = stage(sequence_number(rows, ["turn", "role", "text"], ["key"]).withColumn("seq", F.col("seq") - 1), "numbered-turns")
    first = numbered.groupBy("key", "role", F.sha2("text", 256)).agg(F.min("seq").alias("seq")).select("key", "seq", F.lit(True).alias("first"))
    facts = numbered.select("key", "conv_id", "n", "seq", "turn", "code").join(first, ["key", "seq"], "left")
    facts = stage(facts.withColumn("first", F.coalesce("first", F.lit(False))).withColumn("idx", F.expr(f"seq div {CHUNK}")), "turn-facts")
    gone, cut = F.col("code") >= GONE, F.col("code").bitwiseAND(F.lit(CUT)) > 0
    row = F.struct("seq", F.when(gone | ~F.col("first"), GONE).otherwise(F.col("code")).alias("code"), F.col("code").bitwiseAND(F.lit(3)).alias("initial"))
    chunks = facts.groupBy("key", "idx", "n").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    chunks = stage(
        chunks.select(
            "key", "idx", F.expr(f"(idx + 1) * {CHUNK} >= n").alias("last"), F.expr("transform(rows, r -> r.code)").alias("codes"), F.expr("transform(rows, r -> r.initial)").alias("initials")
        ),
        "chunks",
    )
    priced = stage(
        _per_row(chunks.select("key", "idx", "last", "codes"), lambda r: [{"key": r["key"], "idx": r["idx"], "m": _priced_chunk(bytes(r["codes"]), r["last"])}], "key string, idx long, m array<long>"),
        "chunk-costs",
    )
    levels = _levels(priced, _combine, "m array<long>", "block-costs")
    ended = F.array(*[F.lit(e).cast("long") for e in (0, FAR, FAR, 0)]).alias("e")
    ends = _down(levels, levels[-1].select("key", "idx", ended), _hand_down, "e array<long>", "block-prices")
    # The last chunk ends the conversation itself, as any conversation does.
    traced = stage(
        _per_row(
            chunks.select("key", "idx", "last", "codes").join(ends, ["key", "idx"]),
            _trace_chunk, "key string, idx long, state int, to int, audit string, lines array<struct<k:int,role:string>>",
        ),
        "traces",
    )
    maps = traced.groupBy("key", "idx").agg(F.map_from_entries(F.collect_list(F.struct("state", "to"))).alias("to"))
    maps = stage(maps.select("key", "idx", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.coalesce(F.col("to")[s], F.lit(0))).alias("to")), "chunk-maps")
    levels = _levels(maps, _compose, "to array<int>", "block-maps")
    states = _down(levels, levels[-1].select("key", "idx", F.lit(0).alias("state")), _enter, "state int", "entered")
    chosen = stage(traced.join(states, ["key", "idx", "state"]), "chosen")
    letters = chosen.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("idx", "audit"))).alias("a")).select("key", F.expr("array_join(transform(a, x -> x.audit), '')").alias("audit"))
    counts = facts.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(gone.cast("long")).alias("blank"),
        F.sum((~gone & ~F.col("first")).cast("long")).alias("duplicate"),
        F.sum((~gone & F.col("first") & cut).cast("long")).alias("truncated"),
    )
    # Pairs within a chunk, and of its last row with the next chunk's first one.
    after = chunks.select("key", (F.col("idx") - 1).alias("idx"), F.col("initials")[0].alias("next"))
    pair = "x in (1, 12, 21)"  # 10 * initial + next initial: su, ua, au
    illegal = (
        chunks.join(after, ["key", "idx"], "left")
        .withColumn("initials", F.when(F.col("next").isNull(), F.col("initials")).otherwise(F.concat("initials", F.array("next"))))
        .select("key", F.expr(f"size(filter(transform(sequence(1, size(initials)), i -> if(i = size(initials), 1, 10 * initials[i - 1] + initials[i])), x -> not ({pair})))").alias("illegal"))
        .groupBy("key").agg(F.sum("illegal").alias("illegal"))
    )
    undone = facts.filter(~gone & F.col("first") & cut).select("key", "seq")
    lines = chosen.select("key", "idx", F.posexplode("lines").alias("at", "line")).select(
        "key", "idx", "at", F.when(F.col("line.k").isNotNull(), F.col("idx") * CHUNK + F.col("line.k")).alias("seq"), F.col("line.role").alias("to")
    )
    kept_cut = lines.join(undone, ["key", "seq"]).groupBy("key").agg(F.count(F.lit(1)).alias("unfinished"))
    count = lambda letter: F.length("audit") - F.length(F.replace("audit", F.lit(letter)))
    cost = DELETE * count("D") + REROLE * count("R") + INSERT * count("I") + UNFINISHED * F.coalesce("unfinished", F.lit(0))
    report = (
        counts.join(illegal, "key").join(letters, "key").join(kept_cut, "key", "left")
        .select("key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", cost.cast("long").alias("cost"), "audit")
    )
    own = numbered.select("key", "seq", "role", "text")
    found = lines.join(own, ["key", "seq"], "left").select("key", "idx", "at", F.coalesce("to", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return report, found


def _digests(lines: DataFrame) -> DataFrame:
    """(key, repaired_sha256): a hash has to read its bytes in order, so a task
    streams each conversation's sorted lines, holding one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            for k, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if digest is not None and k == key:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [digest.hexdigest()]})
                    key, digest = k, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [digest.hexdigest()]})

    ordered = lines.repartition("key").sortWithinPartitions("key", "idx", "at")
    return ordered.mapInArrow(run, "key string, repaired_sha256 string")


# --- interface -------------------------------------------------------------------

def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows come in order of turn (nulls first), role and text; repeated rows are
    duplicates of the first. A null role or text is one space, so a null text
    is blank. Rows with a null conversation id are one conversation. An empty
    table gives no rows. ``audit`` holds the initials of the cheapest edits
    (Keep, Rerole, Delete, Insert), the digest is of the repaired
    ``role:text`` lines. Other columns of the table are not read.
    """
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col)
    short, long = _split(rows)
    reports = _short_reports(short)
    if long is None:
        return reports
    found, lines = _long(long)
    whole = found.join(_digests(lines), "key", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
    return reports.unionByName(whole.select(*reports.columns))


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, pos (from 0), role, text; inserted turns have an empty text."""
    rows = _rows(conversations, conv_col, turn_col, role_col, text_col)
    short, long = _split(rows)
    out = _short_turns(short)
    if long is None:
        return out
    report, lines = _long(long)
    lines = sequence_number(lines, ["idx", "at"], ["key"], "pos").join(report.select("key", "conv_id"), "key")
    return out.unionByName(lines.select("conv_id", (F.col("pos") - 1).alias("pos"), "role", "text"))
