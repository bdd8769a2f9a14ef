"""Conversation structure repair by weighted finite-state composition.

A conversation is an acceptor: one arc a row, whose symbol is the role's initial and the row's fault. An edit transducer of one state reads
a symbol and keeps (K), reroles (R) or deletes (D) the row, or inserts one (I) without reading. An acceptor of role initials, `(s?(ua)+)?`, reads what
it writes. The composition is never built: arcs are made, and remembered, for the pairs of grammar state and symbol that are met. Insertions
stand before the row that follows them, and a run of them meets a grammar state once at most (a cycle of them only costs), so states in the order of rows are
in topological order. Weights are (cost, label string), compared in this order; labels of a row's arc end with the only one that reads,
so none is the beginning of another, and strings are compared by their ranks among the paths that are still open: a step takes the same time at any length.

A conversation of more than MOST_ROWS rows or MOST_BYTES of text isn't gathered in one task. Its rows are dealt by ranges of their order and form
blocks; of each block the best weight between any two grammar states is known (4 x 4 costs and ranks); a fold over blocks picks the states
in between, and each block finds its own edits. Rows seen before are told by a shuffle on role and digest of the text.

Defined results: order is by turn (nulls first), then role, then text; null role or text: one space; a role without a first character, or with another one than
s, u and a, can't be kept; of equal (role, text) all but the first are duplicates; null conv_id is one conversation; no rows: no row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash
from .components import FILTER_BITS, bitmap

#: From so many rows or bytes of text on, a conversation is dealt to several tasks.
MOST_ROWS, MOST_BYTES = 1_000, 1 << 20
#: Rows and bytes of a block of such a conversation; a block has one row at least.
BLOCK_ROWS, BLOCK_BYTES = 1_000, 1 << 20
#: Conversations of up to so many rows are remembered by their symbols.
REMEMBERED_ROWS = 64

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar: (state, initial) -> state. A conversation may end in FINAL states.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = 4, (0, 3)
NAMES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
INITIALS = "sua"
FINE, BLANK, CUT, TWICE = 0, 1, 2, 3
INF = float("inf")


def symbol(role: str, fault: int) -> int:
    """Fault: FINE, CUT, or one that must go. 0 to 11."""
    at = INITIALS.find(role[0]) if role else -1
    return (at % STATES) * 3 + (0 if fault == FINE else 2 if fault == CUT else 1)


def inserted(state: int) -> Iterator[tuple[int, str, int]]:
    """Runs of insertions from a state: cost, labels, state reached; the empty one first."""
    cost, labels, met = 0, "", {state}
    yield cost, labels, state
    while (nxt := next((t for (s, i), t in GRAMMAR.items() if s == state and i in NAMES), None)) is not None and nxt not in met:
        cost, labels, state = cost + INSERT, labels + "I", nxt
        met.add(state)
        yield cost, labels, state


def edits(code: int) -> Iterator[tuple[int, str, str | None]]:
    """Arcs of the transducer that read this symbol: cost, label, initial written."""
    initial, fault = (INITIALS + "?")[code // 3], code % 3
    yield DELETE, "D", None
    if fault != 1:
        more = TRUNCATED if fault == 2 else 0
        yield KEEP + more, "K", initial
        for name in NAMES:
            yield REROLE + more, "R", name


@cache
def arcs(state: int, code: int) -> tuple[tuple[int, str, int], ...]:
    """Arcs of the composition that leave a state with this row: cost, labels, state."""
    out = []
    for paid, run, at in inserted(state):
        for cost, label, written in edits(code):
            to = at if written is None else GRAMMAR.get((at, written))
            if to is not None:
                out.append((paid + cost, run + label, to))
    return tuple(out)


#: Best weight from each state to the end, without rows.
ENDS = [min(((c, w) for c, w, t in inserted(s) if t in FINAL), default=(INF, "")) for s in range(STATES)]


def _ranks(keys: list) -> list[int]:
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    return [order[k] for k in keys]


def sweep(codes: bytes, cost: list[list[float]], rank: list[list[int]]) -> tuple[list[list[float]], list[list[int]], list]:
    """Best weights from each state over the rows to each end. cost, rank: by state and end. Also the choice at each row, last row first."""
    ends, choices = range(len(cost[0])), []
    for code in reversed(codes):
        best = [[min(((c + cost[t][e], w, rank[t][e], t) for c, w, t in arcs(s, code)), default=(INF, "", 0, 0)) for e in ends] for s in range(STATES)]
        cost = [[b[0] for b in row] for row in best]
        flat = _ranks([(b[1], b[2]) for row in best for b in row])
        rank = [flat[s * len(ends) : (s + 1) * len(ends)] for s in range(STATES)]
        choices.append([[(b[1], b[3]) for b in row] for row in best])
    return cost, rank, choices


def _follow(choices: list, state: int, end: int) -> str:
    out = []
    for row in reversed(choices):
        labels, state = row[state][end]
        out.append(labels)
    return "".join(out)


def whole(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a conversation."""
    cost, _, choices = sweep(codes, [[c] for c, _ in ENDS], [[r] for r in _ranks([w for _, w in ENDS])])
    labels, state = _follow(choices, 0, 0), 0
    for (_, to) in _walk(labels, codes):
        state = to
    return int(cost[0][0]), labels + ENDS[state][1]


remembered = lru_cache(maxsize=1 << 16)(whole)


def between(codes: bytes) -> tuple[list[float], list[int], list]:
    """Costs and ranks, state by state and end by end, and the choices."""
    cost, rank, choices = sweep(codes, [[0.0 if s == e else INF for e in range(STATES)] for s in range(STATES)], [[0] * STATES for _ in range(STATES)])
    return sum(cost, []), sum(rank, []), choices


def _walk(labels: str, codes: bytes, state: int = 0) -> Iterator[tuple[str | None, int]]:
    """The initial that each edit writes, or None, and the state after it."""
    row = 0
    for label in labels:
        written = None
        if label in "IR":
            written = next(i for (s, i) in GRAMMAR if s == state and i in NAMES)
        elif label == "K":
            written = (INITIALS + "?")[codes[row] // 3]
        row += label != "I"
        state = state if written is None else GRAMMAR[(state, written)]
        yield written, state


def applied(labels: str, codes: bytes, roles: list[str], texts: list[str], state: int = 0) -> tuple[list[str], list[str]]:
    """Roles and texts of the repaired rows."""
    out_roles, out_texts, row = [], [], 0
    for label, (written, _) in zip(labels, _walk(labels, codes, state), strict=True):
        if written is not None:
            out_roles.append(roles[row] if label == "K" else NAMES[written])
            out_texts.append("" if label == "I" else texts[row])
        row += label != "I"
    return out_roles, out_texts


def _illegal(roles: list[str]) -> int:
    firsts = [r[:1] for r in roles]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))


COUNTS = "least_turn long, most_turn long, turns long, blank long, duplicate long, truncated long, illegal long"
REPAIRED = f"conv_id long, block long, alone boolean, {COUNTS}, cost long, audit string, roles array<string>, texts array<string>"
_BLOCKS = f"conv_id long, block long, {COUNTS}, first_role string, last_role string, codes binary, costs array<double>, ranks array<int>, roles array<string>, texts array<string>"


def _types(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in schema.split(", "))])


def _counts(turns: list[int | None], faults: list[int], roles: list[str]) -> dict:
    known = sorted({t for t in turns if t is not None})
    return {
        "least_turn": known[0] if known else None, "most_turn": known[-1] if known else None, "turns": len(known), "blank": faults.count(BLANK), "duplicate": faults.count(TWICE),
        "truncated": faults.count(CUT), "illegal": _illegal(roles)}


def _emit(schema: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], most: int = 4 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as dicts into batches of some MB."""
    kinds = _types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in make(batches):
            rows.append(row)
            size += 200 + sum(map(len, row.get("texts") or ()))
            if size > most:
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return run


def _solve_small(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Sorted rows of whole conversations."""
    now, group = None, []

    def done() -> dict:
        turns, faults, roles, texts, seen = [], [], [], [], set()
        for turn, role, text, state, copies in group:
            for _ in range(copies):
                fault = state
                if state != BLANK:
                    fault = TWICE if (role, text) in seen else state
                    seen.add((role, text))
                turns.append(turn)
                faults.append(fault)
                roles.append(role)
                texts.append(text)
        codes = bytes(map(symbol, roles, faults))
        cost, audit = remembered(codes) if len(codes) <= REMEMBERED_ROWS else whole(codes)
        kept_roles, kept_texts = applied(audit, codes, roles, texts)
        return {"conv_id": now, "block": 0, "alone": True, **_counts(turns, faults, roles), "cost": cost, "audit": audit, "roles": kept_roles, "texts": kept_texts}

    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(6)]
        for conv, *row in zip(*cols, strict=True):
            if group and conv != now:
                yield done()
                group = []
            now = conv
            group.append(row)
    if group:
        yield done()


def _to_blocks(block_rows: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Sorted rows of parts of conversations; `first` tells the first row of equal ones."""
        base, n = TaskContext.get().partitionId() << 32, 0
        now, size = None, 0
        turns, faults, roles, texts = [], [], [], []

        def done() -> dict:
            nonlocal n, size, turns, faults, roles, texts
            codes = bytes(map(symbol, roles, faults))
            costs, ranks, _ = between(codes)
            out = {"conv_id": now, "block": base + n, **_counts(turns, faults, roles), "first_role": roles[0], "last_role": roles[-1], "codes": codes, "costs": costs, "ranks": ranks, "roles": roles, "texts": texts}
            n, size, turns, faults, roles, texts = n + 1, 0, [], [], [], []
            return out

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for conv, turn, role, text, state, copies, first in zip(*cols, strict=True):
                for i in range(copies):
                    if roles and (conv != now or len(roles) >= block_rows or size >= block_bytes):
                        yield done()
                    now = conv
                    turns.append(turn)
                    faults.append(state if state == BLANK or (first and i == 0) else TWICE)
                    roles.append(role)
                    texts.append(text)
                    size += len(text)
        if roles:
            yield done()

    return run


_PICKED = "block long, enters int, leaves int, last boolean, more_illegal long, same_turn long"


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks of whole conversations in order; some bytes of each stay until the last is read."""
    now = None
    blocks, back, notes = [], bytearray(), []
    cost, rank, role, turn = [], [], None, None

    def done() -> Iterator[dict]:
        state = min(range(STATES), key=lambda s: (cost[s] + ENDS[s][0], rank[s], ENDS[s][1]))
        states = [state]
        for i in range(len(blocks) - 1, -1, -1):
            states.append(back[i * STATES + states[-1]])
        states.reverse()
        for i, block in enumerate(blocks):
            yield {"block": block, "enters": states[i], "leaves": states[i + 1], "last": i == len(blocks) - 1, "more_illegal": notes[i][0], "same_turn": notes[i][1]}

    for batch in batches:
        for conv, block, costs, ranks, first_role, last_role, least, most in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if blocks and conv != now:
                yield from done()
                blocks, back, notes = [], bytearray(), []
            if not blocks:
                now, cost, rank, role, turn = conv, [0.0] + [INF] * (STATES - 1), [0] * STATES, None, None
            best = [min((cost[s] + costs[s * STATES + e], rank[s], ranks[s * STATES + e], s) for s in range(STATES)) for e in range(STATES)]
            cost, rank = [b[0] for b in best], _ranks([(b[1], b[2]) for b in best])
            back += bytes(b[3] for b in best)
            blocks.append(block)
            notes.append((int(role is not None and role[:1] + first_role[:1] not in ("su", "ua", "au")), int(turn is not None and turn == least)))
            role, turn = last_role, turn if most is None else most
    if blocks:
        yield from done()


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in batch.to_pylist():
            costs, _, choices = between(row["codes"])
            audit, state = _follow(choices, row["enters"], row["leaves"]), row["enters"]
            roles, texts = applied(audit, row["codes"], row["roles"], row["texts"], state)
            paid = int(costs[state * STATES + row["leaves"]])
            if row["last"]:
                more, labels = ENDS[row["leaves"]]
                state = row["leaves"]
                extra_roles, extra_texts = applied(labels, b"", [], [], state)
                paid, audit, roles, texts = paid + more, audit + labels, roles + extra_roles, texts + extra_texts
            counts = {k: row[k] for k in ("least_turn", "most_turn", "blank", "duplicate", "truncated")}
            yield {"conv_id": row["conv_id"], "block": row["block"], "alone": False, **counts, "turns": row["turns"] - row["same_turn"], "illegal": row["illegal"] + row["more_illegal"], "cost": paid, "audit": audit, "roles": roles, "texts": texts}


def _only(df: DataFrame, bits, wanted: bool) -> DataFrame:
    """Rows whose conversation's bit is set, or isn't."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            is_set = (shared.value[at >> 3] >> (at & 7).astype("uint8") & 1).astype(bool)
            yield batch.filter(pa.array(is_set if wanted else ~is_set))

    return df.mapInArrow(run, df.schema).drop("bit")


def _order(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_first() for n in names]


def repair(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows: conv_id, turn, role, text and, if there is such a column, copies (how often the row stands there, adjacently).

    conv_id, block, alone (the conversation has one block), counts, cost, audit (edits' initials), roles and texts of the repaired rows. Blocks of
    a conversation in ascending order are the whole of it."""
    small, large = repair_parts(rows, most_rows, most_bytes, block_rows, block_bytes)
    return small if large is None else small.unionByName(large)


def repair_parts(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """repair's rows: of conversations that one task solves, and of those that are dealt to several, if there are any."""
    small_batches(rows.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    trimmed = F.rtrim("text", F.lit(WHITE))
    state = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        text.alias("text"), copies.cast("long").alias("copies")).select("conv_id", "turn", "role", "text", state.alias("state"), "copies")
    bit = F.pmod(F.xxhash64("conv_id"), F.lit(1 << FILTER_BITS))
    large = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("b")).filter((F.col("n") > most_rows) | (F.col("b") > most_bytes))
    bits = bitmap(large.select(bit.alias("bit")))
    order = ("conv_id", "turn", "role", "text")
    if not bits.any():
        small, parts = rows, None
    else:
        named = rows.select(bit.alias("bit"), *rows.columns)
        small, parts = _only(named, bits, False), _only(named, bits, True)
    out = small.repartition("conv_id").sortWithinPartitions(*_order(*order)).mapInArrow(_emit(REPAIRED, _solve_small), REPAIRED)
    return out, None if parts is None else _repair_large(parts, block_rows, block_bytes)


def _repair_large(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Conversations of any size, dealt by ranges."""
    order = ("conv_id", "turn", "role", "text")
    rows = stash(rows.groupBy(*order, "state").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)), "rows")
    place = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("at"))
    told = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    told = stash(told.select("conv_id", "turn", "role", "text", "state", "copies", F.col("turn").eqNullSafe(F.col("at.turn")).alias("first")), "rows")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begin = F.left("text", F.lit(40)).asc_nulls_first()  # bounds of ranges go through the driver
    dealt = told.repartitionByRange(n, *_order(*order[:3]), begin).sortWithinPartitions(*_order(*order))
    blocks = stash(dealt.mapInArrow(_emit(_BLOCKS, _to_blocks(block_rows, block_bytes)), _BLOCKS), "blocks")
    ends = blocks.select("conv_id", "block", "costs", "ranks", "first_role", "last_role", "least_turn", "most_turn")
    picked = ends.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "block")).mapInArrow(_emit(_PICKED, _pick), _PICKED)
    joined = blocks.select("block", "conv_id", *(c.split(" ")[0] for c in COUNTS.split(", ")), "codes", "roles", "texts").join(picked, "block")
    return joined.mapInArrow(_emit(REPAIRED, _solve_blocks), REPAIRED)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows harmed by crc32 of `conv_id:turn` mod 20: 0 dropped, 1 emptied, 2 without .!?, 3 twice (copies), 4 said by user; nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("how")).filter("how != 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("how") == 3, 2).otherwise(1).alias("copies"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pieces of whole conversations in order: the digest is fed piece by piece. It depends on every byte before, so this can't be dealt."""
    now, sha, audit, some = None, None, [], False
    for batch in batches:
        for conv, piece, empty, labels in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if sha is not None and conv != now:
                yield {"conv_id": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                sha = None
            if sha is None:
                now, sha, audit, some = conv, hashlib.sha256(), [], False
            if not empty:
                sha.update(b"\n" * some + piece.encode())
                some = True
            audit.append(labels)
    if sha is not None:
        yield {"conv_id": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}


def audited(conversations: DataFrame, small: DataFrame, large: DataFrame | None) -> DataFrame:
    """One row for each conv_id of the first table: gaps, counts, cost, audit and the digest of the repaired rows; zeros where none are left.
    small, large: as repair_parts gives them."""
    piece = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    gaps = lambda a, b, n: F.coalesce(b - a + 1 - n, F.lit(0))
    out = small.select("conv_id", gaps(F.col("least_turn"), F.col("most_turn"), F.col("turns")).alias("gaps"), *counts, "audit", F.sha2(piece.cast("binary"), 256).alias("repaired_sha256"))
    if large is not None:
        parts = stash(large.select("*", piece.alias("piece"), (F.size("roles") == 0).alias("empty")).drop("roles", "texts"), "pieces")
        sums = parts.groupBy("conv_id").agg(gaps(F.min("least_turn"), F.max("most_turn"), F.sum("turns")).alias("gaps"), *(F.sum(c).alias(c) for c in counts))
        kinds = "conv_id long, audit string, repaired_sha256 string"
        pieces = parts.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "block")).select("conv_id", "piece", "empty", "audit")
        ends = pieces.mapInArrow(_emit(kinds, _digests), kinds).withColumnRenamed("conv_id", "c")
        out = out.unionByName(sums.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts)]
    return ids.join(out, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
