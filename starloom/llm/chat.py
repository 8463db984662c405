"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, beginning with the user and
ending with the assistant. Each turn may be kept, relabelled, merged into the turn before it, and preceded by one inserted empty
turn; the end may need empty turns too. Dynamic programming over the automaton's states finds the cheapest repair. Costs of a
run of turns are a small matrix from state to state, and matrices multiply in (min, +).

Rows are put in order by range, however many of them a conversation or a turn number has, and cut into chunks of CHUNK rows (or
BYTES of text) where they lie. Chunks become matrices side by side, each conversation's matrices are walked through to fix the
states at the chunks' borders, and chunks are then repaired and rendered side by side. No task holds more of a conversation's
turns than a chunk, and of its matrices, 16 numbers for a chunk, one task holds all.

Defined results: turns are in the order of (turn, role, hash of the text), rows without a turn number last; repeated rows are turns of
their own. Null and unknown roles are relabelled at less cost than wrong ones. A null text is rendered empty. Texts are rendered
whole. Rows with a null conv_id are one conversation. Of equally cheap repairs the first in the order keep, relabel, merge, insert
is taken within a chunk, and the first state at a chunk's border. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import small_batches, spread, written

CHUNK = 4096
#: Bytes of text in a chunk, about.
BYTES = 1 << 24
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: The automaton: state -> {role: next state}. A state other than START is named by the role of the turn that led there.
LEGAL = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
#: Empty turns that complete a conversation which ends in a state.
TAIL = {START: (), SYSTEM: (1, 2), USER: (2,), ASSISTANT: ()}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
FAR = 1 << 40

#: (cost, next state, inserted role or None, new role, merged)
Step = tuple[int, int, int | None, int, bool]


def _steps(state: int, role: int) -> list[Step]:
    """What may be done with a turn of a role (3: none of ROLES), in order of preference."""
    label = lambda q: 0 if q == role else UNKNOWN if role == 3 else RELABEL
    order = [role, *(q for q in range(3) if q != role)] if role < 3 else [0, 1, 2]
    out: list[Step] = [(label(q), LEGAL[state][q], None, q, False) for q in order if q in LEGAL[state]]
    if state != START:
        out.append((MERGE + label(state - 1), state, None, state - 1, True))
    for p, between in LEGAL[state].items():
        out += [(INSERT + label(q), LEGAL[between][q], p, q, False) for q in order if q in LEGAL[between]]
    return sorted(out, key=lambda s: s[0])


STEPS = [[_steps(state, role) for role in range(4)] for state in range(4)]
#: The cheapest step between two states for a turn of a role, by role, from, to.
CHEAPEST = [[[min((s for s in STEPS[a][role] if s[1] == b), key=lambda s: s[0], default=None) for b in range(4)] for a in range(4)] for role in range(4)]
LAST = [INSERT * len(TAIL[s]) for s in range(4)]


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 3


def matrix(roles: list[int]) -> list[list[int]]:
    """Least costs of a run of turns from state to state."""
    now = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for role in roles:
        best = CHEAPEST[role]
        now = [[min((row[m] + best[m][b][0] for m in range(4) if best[m][b]), default=FAR) for b in range(4)] for row in now]
    return now


def borders(chunks: list[list[list[int]]]) -> list[tuple[int, int]]:
    """(state before, state after) each chunk of a conversation, on a cheapest way."""
    ahead = [LAST]
    for m in reversed(chunks):
        ahead.append([min(m[a][b] + ahead[-1][b] for b in range(4)) for a in range(4)])
    ahead.reverse()
    out, state = [], START
    for k, m in enumerate(chunks):
        after = min(range(4), key=lambda b: (m[state][b] + ahead[k + 1][b], b))
        out.append((state, after))
        state = after
    return out


def repaired(roles: list[int], before: int, after: int) -> list[Step]:
    """The steps of a cheapest repair of a run of turns between two states."""
    ahead = [[0 if s == after else FAR for s in range(4)]]
    for role in reversed(roles):
        last = ahead[-1]
        ahead.append([min((s[0] + last[s[1]] for s in STEPS[a][role]), default=FAR) for a in range(4)])
    ahead.reverse()
    out, state = [], before
    for k, role in enumerate(roles):
        step = next(s for s in STEPS[state][role] if s[0] + ahead[k + 1][s[1]] == ahead[k][state])
        out.append(step)
        state = step[1]
    return out


def rendered(step: Step, text: str | None, first: bool) -> str:
    open_ = lambda r: f"<|{ROLES[r]}|>\n"
    if step[4]:
        return "\n" + (text or "")
    return ("" if first else "\n") + (open_(step[2]) + "\n" if step[2] is not None else "") + open_(step[3]) + (text or "")


def end(state: int) -> str:
    return "".join(f"\n<|{ROLES[r]}|>\n" for r in TAIL[state]) + "\n<|end|>"


def runs(batches: Iterator, keys: list[str]) -> Iterator[list[dict]]:
    """Rows of sorted batches, those of a key together."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and any(row[k] != held[-1][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def chunk_rows(chunk: int) -> Callable[[Iterator], Iterator]:
    """(conv_id, turn, role, text, chunk, place): rows in order, numbered; chunks of later partitions have larger numbers."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number, place, size, last = (TaskContext.get().partitionId() << 32) - 1, 0, 0, ()
        for b in batches:
            numbers, places = [], []
            for conv, length in zip(b.column("conv_id").to_pylist(), pc.binary_length(b.column("text")).to_pylist(), strict=True):
                if last != (conv,) or place >= chunk or size > BYTES:
                    number, place, size, last = number + 1, 0, 0, (conv,)
                numbers.append(number)
                places.append(place)
                place, size = place + 1, size + (length or 0)
            kept = [b.column(c) for c in ("conv_id", "turn", "role", "text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], names=["conv_id", "turn", "role", "text", "chunk", "place"])

    return run


def matrix_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    out = [(r[0]["conv_id"], r[0]["chunk"], [c for row in matrix([role_of(x["role"]) for x in r]) for c in row]) for r in runs(batches, ["chunk"])]
    if out:
        c, k, m = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(k, pa.int64()), pa.array(m, pa.list_(pa.int64()))], names=["conv_id", "chunk", "costs"])


def border_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    out = []
    for r in runs(batches, ["conv_id"]):
        states = borders([[x["costs"][4 * a : 4 * a + 4] for a in range(4)] for x in r])
        out += [(x["chunk"], *s, k == len(r) - 1) for k, (x, s) in enumerate(zip(r, states, strict=True))]
    if out:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["chunk", "before", "after", "last"])


OUT = "conv_id long, turn long, role string, new_role string, merged boolean, inserted string, cost int, rendered string"


def repaired_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string())
    names = [f.split()[0] for f in OUT.split(", ")]
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for r in runs(batches, ["chunk"]):
        steps = repaired([role_of(x["role"]) for x in r], r[0]["before"], r[0]["after"])
        for k, (x, s) in enumerate(zip(r, steps, strict=True)):
            closes = x["last"] and k == len(r) - 1
            cost = s[0] + (LAST[s[1]] if closes else 0)
            text = rendered(s, x["text"], k == 0 and x["before"] == START) + (end(s[1]) if closes else "")
            out.append((x["conv_id"], x["turn"], x["role"], ROLES[s[3]], s[4], None if s[2] is None else ROLES[s[2]], cost, text))
        if len(out) > 4000:
            yield rows()
            out.clear()
    if out:
        yield rows()


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each turn: its new role, whether it merges into the turn before, the empty turn inserted before it, the cost and the rendered piece.

    A conversation's pieces in the order of its turns, put together, are the formatted conversation.
    """
    spark = turns.sparkSession
    text, role = F.col("text").cast("string"), F.col("role").cast("string")
    # The number of a row tells repeated ones apart, so that any number of them is dealt out; read from files it stays what it is.
    rows = small_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "h", "row"]
    placed = rows.repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
    chunks = written(placed.mapInArrow(chunk_rows(chunk), "conv_id long, turn long, role string, text string, chunk long, place long"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(spread(spark), "chunk").sortWithinPartitions("chunk", "place")

    costs = dealt(chunks.select("conv_id", "chunk", "place", "role")).mapInArrow(matrix_rows, "conv_id long, chunk long, costs array<long>")
    ways = written(costs.repartition(spread(spark), "conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(border_rows, "chunk long, before int, after int, last boolean"))
    return dealt(chunks.join(ways, "chunk")).mapInArrow(repaired_rows, OUT)
