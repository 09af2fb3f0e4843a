"""Row pattern matching: the regular expression `A (D|U)*? P` over each client's rows in time, without backtracking.

A table read from right to left holds, for each row and state of the automaton, the most cents that A may have had for the
match still to succeed; a walk from left to right then prefers what the expression prefers and never has to turn back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut, drop, lean

NONE = np.iinfo(np.int64).min
#: Bits of a row's flags: it has cents; may be D or U after the row before; may be P after it; is below it; its kind may be D or U; its kind may be P.
HAS, STEP, GOAL, BELOW, STEPS, GOALS = 1, 2, 4, 8, 16, 32
_PLACED = (
    "client_id long, part int, at long, first_id long, last_id long, n_rows long, sum_cents long, labels string, "
    "prev_at long, tail boolean, first_ts long, last_ts long, ids array<long>, cents array<long>, flags binary"
)


def most_cents(cents: list[int], flags: bytes, after: int = NONE) -> list[int]:
    """For each row: the most cents of an A before it with which the loop, reading this row next, still reaches a P.

    `after`: the same of the row behind the last one.
    """
    best, m = [NONE] * len(cents), after
    for i in range(len(cents) - 1, -1, -1):
        f = flags[i]
        m = max(m if f & STEP else NONE, cents[i] if f & GOAL else NONE)
        best[i] = m
    return best


def _end(i: int, c: int, cents: list[int], flags: bytes) -> int | None:
    """The first row from i on that is a P for an A of c cents; None if it lies behind the last row."""
    for j in range(i, len(cents)):
        if flags[j] & GOAL and cents[j] >= c:
            return j
    return None


def _starts(i: int, cents: list[int], flags: bytes, best: list[int], after: int) -> bool:
    return bool(flags[i] & HAS) and (best[i + 1] if i + 1 < len(best) else after) >= cents[i] and (best[i + 1] if i + 1 < len(best) else after) != NONE


def walk(start: int, cents: list[int], flags: bytes, best: list[int], after: int = NONE) -> Iterator[tuple[int, int | None]]:
    """Matches (first row, last row) of the search that starts there; a last row of None lies behind the last row."""
    i, n = start, len(cents)
    while i < n:
        if _starts(i, cents, flags, best, after):
            j = _end(i + 1, cents[i], cents, flags)
            yield i, j
            if j is None:
                return
            i = j + 1
        else:
            i += 1


def _labels(first: int, last: int, flags: bytes, opens: bool, ends: bool) -> str:
    """Letters of the rows first to last, A at the first if the match opens there and P at the last if it ends there."""
    out = ["D" if flags[k] & BELOW else "U" for k in range(first, last + 1)]
    if opens:
        out[0] = "A"
    if ends:
        out[-1] = "P"
    return "".join(out)


class _Out:
    """Rows of matches and of pieces on their way to Arrow."""

    def __init__(self, part: int):
        self.part, self.rows = part, {f.split()[0]: [] for f in _PLACED.split(", ")}

    def add(self, **row) -> None:
        for k, v in self.rows.items():
            v.append(row.get(k, self.part if k == "part" else None))

    def flush(self) -> pa.RecordBatch:
        types = {"part": pa.int32(), "labels": pa.string(), "tail": pa.bool_(), "ids": pa.list_(pa.int64()), "cents": pa.list_(pa.int64()), "flags": pa.binary()}
        batch = pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in self.rows.items()], names=list(self.rows))
        self.rows = {k: [] for k in self.rows}
        return batch


def _match(client, at, first, last, ids, cents, flags) -> dict:
    return {"client_id": client, "at": at + first, "first_id": ids[first], "last_id": ids[last], "n_rows": last - first + 1, "sum_cents": sum(cents[first : last + 1]), "labels": _labels(first, last, flags, True, True)}


def _solver(max_gap: int, longest: int):
    """The function for mapInArrow over range partitions in order of client and time.

    A run is a row and the rows after it that may stand in a match with the row before them; no match leaves its run. Runs
    whose both ends lie in the partition are solved here, `longest` rows at most; others are handed on as pieces.
    """

    def run(batches):
        out = _Out(TaskContext.get().partitionId())
        held = None  # the rows of the run that isn't over
        last = None  # client, ts, cents, has, id, tag of the row before
        at, prev_at = 0, None  # place of the first held row; place of the piece before it, if it goes on from one
        head = True  # whether the held run is the partition's first

        def piece(rows, tail):
            client, ts, ids, cents, flags = (x.tolist() if k != 4 else x.tobytes() for k, x in enumerate(rows[:5]))
            ids = [None if gone else i for i, gone in zip(ids, rows[5].tolist())]
            out.add(client_id=client[0], at=at, prev_at=prev_at, tail=tail, first_ts=ts[0], last_ts=ts[-1], ids=ids, cents=cents, flags=flags)

        for rows in _blocks(batches):
            client, ts, ids, gone, cents, has, kind, tag = rows
            if last is not None:
                client_b, ts_b, cents_b, has_b, tag_b = (np.concatenate([[x], y[:-1]]) for x, y in zip(last, (client, ts, cents, has, tag)))
            else:
                client_b, ts_b, cents_b, has_b, tag_b = (np.concatenate([y[:1], y[:-1]]) for y in (client, ts, cents, has, tag))
            same = (client == client_b) & (ts == ts_b) & (tag == tag_b)
            if last is None:
                same[0] = False
            last = (client[-1], ts[-1], cents[-1], has[-1], tag[-1])
            near = (client == client_b) & has & has_b & (ts - ts_b <= max_gap)
            if at == 0 and held is None:
                near[0] = False
            step, goal = near & (kind > 0) & (cents != cents_b), near & (kind == 2)
            flags = (has * HAS + step * STEP + goal * GOAL + (step & (cents < cents_b)) * BELOW + (kind > 0) * STEPS + (kind == 2) * GOALS).astype(np.uint8)
            new = [x[~same] for x in (client, ts, ids, cents, flags, gone)]
            held = [np.concatenate(x) for x in zip(held, new)] if held is not None else new
            if not len(held[0]):
                held = None
                continue
            # the first row of what is held always starts a run or goes on from a piece
            breaks = np.flatnonzero((held[4] & (STEP | GOAL)) == 0)
            breaks = breaks[breaks > 0]
            if len(breaks):
                ends = breaks.tolist()
                bounds = list(zip([0, *ends[:-1]], ends))
                goals = np.add.reduceat((held[4] & GOAL) > 0, [b for b, _ in bounds]) if bounds else []
                for k, (b, e) in enumerate(bounds):
                    if k == 0 and (head or prev_at is not None):
                        piece([x[b:e] for x in held], False)
                        prev_at = None
                    elif goals[k] and e - b > 1:
                        cut_ids = [None if g else i for i, g in zip(held[2][b:e].tolist(), held[5][b:e].tolist())]
                        c, f = held[3][b:e].tolist(), held[4][b:e].tobytes()
                        for i, j in walk(0, c, f, most_cents(c, f)):
                            out.add(**_match(int(held[0][b]), at + b, i, j, cut_ids, c, f))
                    head = False
                at += ends[-1]
                held = [x[ends[-1] :] for x in held]
            while len(held[0]) > longest:
                piece([x[:longest] for x in held], False)
                prev_at, head, at = at, False, at + longest
                held = [x[longest:] for x in held]
            if len(out.rows["at"]) > 4096:
                yield out.flush()
        if held is not None and len(held[0]):
            piece(held, True)
        yield out.flush()

    return run


def _blocks(batches, rows: int = 1 << 15):
    """Columns of Arrow batches as numpy arrays, some batches at a time."""
    some, n = [], 0

    def arrays():
        whole = pa.Table.from_batches(some).combine_chunks()
        get = lambda k, fill=0: whole.column(k).fill_null(fill).to_numpy()
        return get("client"), whole.column("ts").cast(pa.int64()).to_numpy(), get("id"), whole.column("id").is_null().to_numpy(), get("cents"), whole.column("cents").is_valid().to_numpy(), get("kind"), get("tag")

    for batch in batches:
        if batch.num_rows:
            some, n = [*some, batch], n + batch.num_rows
        if n >= rows:
            yield arrays()
            some, n = [], 0
    if n:
        yield arrays()


def _exits(row, state_of) -> tuple:
    """What a piece does to a search that comes in: (its state at the end if it comes in searching; for an open match the
    state at the end by A's cents, as bars in rising order; whether a match with more cents than all bars passes through)."""
    cents, flags, after = row["cents"], row["flags"], row["after"]
    best, memo = most_cents(cents, flags, after), {}

    def searching(i):
        if i not in memo:
            memo[i] = next((state_of(k) for k, j in walk(i, cents, flags, best, after) if j is None), None)
        return memo[i]

    bars, top, passes = [], NONE, True
    for j, f in enumerate(flags):
        if f & GOAL and (cents[j] > top or top == NONE):
            to = searching(j + 1)
            if bars and bars[-1][1] == to:
                bars[-1] = (cents[j], to)
            else:
                bars.append((cents[j], to))
            top = cents[j]
        if not f & STEP:
            passes = False
            break
    return searching(0), bars, passes


def _apply(f: tuple, state):
    """The state behind the pieces that f stands for; a state is None (searching) or (A's cents, its id, part, place)."""
    if state is None:
        return f[0]
    return next((to for upto, to in f[1] if state[0] <= upto), state)


def _then(f: tuple, g: tuple) -> tuple:
    """f, then g."""
    bars = [(upto, _apply(g, to)) for upto, to in f[1]]
    if f[2]:
        bars += [b for b in g[1] if not f[1] or b[0] > f[1][-1][0]]
    short: list = []
    for upto, to in bars:
        if short and short[-1][1] == to:
            short[-1] = (upto, to)
        else:
            short.append((upto, to))
    return _apply(g, f[0]), short, f[2] and g[2]


def _linked(placed: DataFrame, max_gap: int) -> DataFrame:
    """Pieces with `prev` (part, at) of the piece that they go on from, or null, and the flags of first rows known."""
    pieces = placed.where(F.col("flags").isNotNull()).drop("first_id", "last_id", "n_rows", "sum_cents", "labels")
    last = lambda c: F.element_at(c, -1)
    bit = lambda k: F.conv(F.hex(F.substring("flags", k, 1)), 16, 10).cast("int")
    tails = pieces.where("tail").select((F.col("part") + 1).alias("part"), F.lit(0).cast("long").alias("at"), "client_id", F.col("at").alias("_at"), F.col("last_ts").alias("_ts"), last("cents").alias("_cents"), bit(-1).bitwiseAND(HAS).alias("_has"))
    met = pieces.join(tails, ["part", "at", "client_id"], "left")
    first, c = bit(1), F.element_at("cents", 1)
    near = (F.coalesce("_has", F.lit(0)) > 0) & (first.bitwiseAND(HAS) > 0) & (F.col("first_ts") - F.col("_ts") <= max_gap)
    step = near & (first.bitwiseAND(STEPS) > 0) & (c != F.col("_cents"))
    goal = near & (first.bitwiseAND(GOALS) > 0)
    mended = first + F.when(step, STEP).otherwise(0) + F.when(goal, GOAL).otherwise(0) + F.when(step & (c < F.col("_cents")), BELOW).otherwise(0)
    byte = F.unhex(F.lpad(F.hex(mended.cast("long")), 2, "0"))
    head = F.col("at") == 0
    where = F.when(F.col("prev_at").isNotNull(), F.struct(F.col("part").alias("part"), F.col("prev_at").alias("at"))).when(head & (step | goal), F.struct((F.col("part") - 1).alias("part"), F.col("_at").alias("at")))
    return met.select("client_id", F.struct("part", "at").alias("id"), where.alias("prev"), "ids", "cents", F.when(head, F.concat(byte, F.expr("substring(flags, 2)"))).otherwise(F.col("flags")).alias("flags"))


def _after(pieces: DataFrame) -> DataFrame:
    """pieces with `after`: the most cents of an open A that the pieces behind still bring to a P; links double each round."""

    def scan(batches):
        for b in batches:
            best, through = [], []
            for c, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                best.append(most_cents(c, f)[0])
                through.append(all(x & STEP for x in f))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int64()), pa.array(through)], names=["id", "most", "through"])

    own = pieces.select("id", "cents", "flags").mapInArrow(lean(scan), "id struct<part int, at long>, most long, through boolean")
    behind = pieces.where("prev is not null").select(F.col("prev").alias("id"), F.col("id").alias("next"))
    now = cut(own.join(behind, "id", "left"))
    while now.where("through and next is not null").limit(1).count():
        ask = now.where("through and next is not null").select("id", "most", F.col("next").alias("_n"))
        more = ask.join(now.select(F.col("id").alias("_n"), F.col("most").alias("_m"), "through", "next"), "_n").select("id", F.greatest("most", "_m").alias("most"), "through", "next")
        now = cut(now.where("not through or next is null").unionByName(more))
    most = now.select(F.col("id").alias("next"), F.col("most").alias("after"))
    following = behind.join(most, "next").select("id", "after")
    return pieces.join(following, "id", "left").withColumn("after", F.coalesce("after", F.lit(NONE)))


def _entered(pieces: DataFrame) -> DataFrame:
    """pieces with `state`, pickled: the search's state where it comes in; functions of pieces are composed, links doubling."""

    def own(batches):
        for b in batches:
            fs = []
            for r in b.to_pylist():
                part, at = r["id"]["part"], r["id"]["at"]
                fs.append(pickle.dumps(_exits(r, lambda k, r=r, part=part, at=at: (r["cents"][k], r["ids"][k], part, at + k))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fs, pa.binary())], names=["id", "prev", "f"])

    def compose(batches):
        for b in batches:
            fs = [pickle.dumps(_then(pickle.loads(x), pickle.loads(y))) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fs, pa.binary())], names=["id", "prev", "f"])

    def enter(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pickle.dumps(pickle.loads(f)[0]) for f in b.column(1).to_pylist()], pa.binary())], names=["id", "state"])

    form = "id struct<part int, at long>, prev struct<part int, at long>, f binary"
    each = cut(pieces.select("id", "prev", "ids", "cents", "flags", "after").mapInArrow(lean(own), form))
    # g takes the state before `prev` to the state before id; a prev without a prev of its own is entered searching
    now = cut(each.where("prev is not null").select("id", "prev").join(each.select(F.col("id").alias("prev"), "f", F.col("prev").alias("_p")), "prev").select("id", F.col("prev").alias("at"), F.col("_p").alias("prev"), "f").select("id", F.when(F.col("prev").isNotNull(), F.col("at")).alias("prev"), "f"))
    while now.where("prev is not null").limit(1).count():
        more = now.where("prev is not null").select(F.col("id").alias("_i"), F.col("prev").alias("id"), F.col("f").alias("g")).join(now, "id").select(F.col("_i").alias("id"), "prev", "f", "g").mapInArrow(lean(compose), form)
        now = cut(now.where("prev is null").unionByName(more))
    states = now.select("id", "f").mapInArrow(lean(enter), "id struct<part int, at long>, state binary")
    return pieces.join(states, "id", "left")


def _fragments(pieces: DataFrame) -> DataFrame:
    """Matches of pieces, or the parts of matches that lie in them: part and at are those of the A."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                cents, flags, ids, (part, at) = r["cents"], r["flags"], r["ids"], r["id"].values()
                state, start = pickle.loads(r["state"]) if r["state"] else None, 0
                best = most_cents(cents, flags, r["after"])

                def add(a_part, a_at, first_id, first, j, opens, r=r, cents=cents, flags=flags, ids=ids, part=part, at=at):
                    last = len(cents) - 1 if j is None else j
                    out.append((r["client_id"], a_part, a_at, part, at, first_id, None if j is None else ids[j], j is not None, last - first + 1, sum(cents[first : last + 1]), _labels(first, last, flags, opens, j is not None)))

                if state is not None:
                    j = _end(0, state[0], cents, flags)
                    add(state[2], state[3], state[1], 0, j, False)
                    start = len(cents) if j is None else j + 1
                for i, j in walk(start, cents, flags, best, r["after"]):
                    add(part, at + i, ids[i], i, j, True)
            cols = list(zip(*out)) if out else [[]] * 11
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["client_id", "part", "at", "_part", "_at", "first_id", "last_id", "done", "n_rows", "sum_cents", "labels"])

    found = pieces.select("client_id", "id", "ids", "cents", "flags", "after", "state").mapInArrow(lean(run), "client_id long, part int, at long, _part int, _at long, first_id long, last_id long, done boolean, n_rows long, sum_cents long, labels string")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_at", "labels"))), lambda x: x["labels"]), "")
    return found.groupBy("client_id", "part", "at").agg(F.max("first_id").alias("first_id"), F.max(F.when(F.col("done"), F.col("last_id"))).alias("last_id"), F.sum("n_rows").alias("n_rows"), F.sum("sum_cents").alias("sum_cents"), whole.alias("labels"))


def cents(value: Column) -> Column:
    """floor(100 value + 0.5) as a long; null for null, NaN and values without a whole number of cents in a long."""
    return F.when(F.abs(value) < 9e16, F.floor(F.lit(100.0) * value + F.lit(0.5)).cast("long"))


def match_rows(
    rows: DataFrame, client: str = "client_id", ts: str = "ts", row_id: str = "click_id", kind: str = "kind", value: str = "value", goal: str = "purchase", barred: str = "error",
    max_gap_us: int = 600_000_000, longest: int = 8192,
) -> DataFrame:
    """client_id, match_no (from 1 per client), first_id, last_id, n_rows, sum_cents and labels of each match of
    `A (D|U)*? P` over each client's distinct rows in order of time and id.

    A is any row with a value; D (U) has fewer (more) cents than the row before and a kind that is neither null nor `barred`;
    P is of kind `goal` with at least A's cents; D, U and P come at most max_gap_us after the row before. The search goes on
    one row later where nothing matches, and behind a match's last row otherwise.

    Rows of a null client or time are left out; a row whose value is null or not finite fits no letter and ends a run; ids may
    be null; rows alike in all columns count once; rows alike in time and id stand by cents, kind and hash. An empty table has
    no matches; other columns only tell rows apart.

    Rows are sorted over range partitions, so a client of any size is spread over many. Runs that end within a partition are
    solved there; pieces of longer ones are linked, and what must cross them (cents still able to succeed, and open matches)
    is composed over links that double each round. Only one match's labels meet in one task: a character a row.
    """
    c = lambda name: F.col(f"`{name}`")
    every = [c(x) for x in rows.columns]
    code = F.when(c(kind).isNull() | (c(kind) == barred), 0).when(c(kind) == goal, 2).otherwise(1).cast("int")
    picked = rows.where(c(client).isNotNull() & c(ts).isNotNull()).select(
        c(client).cast("long").alias("client"), c(ts).alias("ts"), c(row_id).cast("long").alias("id"), cents(c(value)).alias("cents"), code.alias("kind"), F.xxhash64(*every, *[x.isNull() for x in every]).alias("tag"),
    )
    order = ["client", "ts", "id", "cents", "kind", "tag"]
    placed = cut(picked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_solver(max_gap_us, longest)), _PLACED))
    linked = cut(_linked(placed, max_gap_us))
    ahead = cut(_after(linked))
    parts = _fragments(_entered(ahead))
    names = ["client_id", "part", "at", "first_id", "last_id", "n_rows", "sum_cents", "labels"]
    found = cut(placed.where(F.col("flags").isNull()).select(*names).unionByName(parts.select(*names)))
    drop(placed, linked, ahead)
    before = Window.partitionBy("client_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = found.groupBy("client_id", "part").agg(F.count("*").alias("_n")).select("client_id", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("client_id", "part").orderBy("at"))
    return found.withColumn("_in", within).join(counts, ["client_id", "part"]).select("client_id", (F.col("_before") + F.col("_in")).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels")


#: The same rows of a table `clicks`, with labels hashed: each start's first end, then the chain of matches from the left.
SQL = r"""
WITH RECURSIVE r AS (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST, cents NULLS FIRST) AS i, lag(ts) OVER k AS ts_b, lag(cents) OVER k AS cents_b
  FROM (SELECT DISTINCT client_id, ts, click_id, kind, value, arrived_at, props, CASE WHEN isfinite(value) THEN floor(100.0 * value + 0.5)::BIGINT END AS cents FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL)
  WINDOW k AS (PARTITION BY client_id ORDER BY ts, click_id NULLS FIRST, cents NULLS FIRST)
), f AS (
  SELECT *, near AND kind <> 'error' AND cents <> cents_b AS step, near AND kind = 'purchase' AS goal
  FROM (SELECT *, coalesce(cents IS NOT NULL AND cents_b IS NOT NULL AND ts - ts_b <= INTERVAL 10 MINUTE, false) AS near FROM r)
), g AS (
  SELECT *, max(CASE WHEN step THEN NULL ELSE i END) OVER (PARTITION BY client_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_i FROM f
), m AS (
  SELECT a.client_id, a.i AS s, min(p.i) AS e FROM g p JOIN g a ON p.client_id = a.client_id AND a.i < p.i AND a.i >= p.from_i AND a.cents <= p.cents WHERE p.goal GROUP BY 1, 2
), chain AS (
  SELECT client_id, s, e, 1 AS match_no FROM m QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY s) = 1
  UNION ALL
  (SELECT m.client_id, m.s, m.e, c.match_no + 1 FROM chain c JOIN m ON m.client_id = c.client_id AND m.s > c.e QUALIFY row_number() OVER (PARTITION BY m.client_id ORDER BY m.s) = 1)
)
SELECT c.client_id, c.match_no::BIGINT AS match_no, any_value(g.click_id) FILTER (g.i = c.s) AS first_id, any_value(g.click_id) FILTER (g.i = c.e) AS last_id, count(*) AS n_rows, sum(g.cents)::BIGINT AS sum_cents,
  sha256(string_agg(CASE WHEN g.i = c.s THEN 'A' WHEN g.i = c.e THEN 'P' WHEN g.cents < g.cents_b THEN 'D' ELSE 'U' END, '' ORDER BY g.i)) AS labels_sha256
FROM chain c JOIN g ON g.client_id = c.client_id AND g.i BETWEEN c.s AND c.e GROUP BY c.client_id, c.match_no
"""
