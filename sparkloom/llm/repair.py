"""Repair of conversations' structure: cheapest edits by Dijkstra's search on the implicit lattice (row, grammar state)."""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, lean

#: States of the grammar `(s?(ua)+)?`: nothing yet, after s, after u, after a; what each role's initial does; ends that are accepted.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTED = (START, ASSISTANT)
#: The only role that can be made in a state (system may be kept, not made).
MADE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
_NAMES = ["conv_id", "turn", "role", "text", "fault", "part", "at", "k", "edit", "illegal", "inits", "marks", "paths", "rows"]
_ROW = "conv_id long, turn long, role string, text string, fault string, part int, at long, k int, edit string, illegal boolean, inits string, marks string, paths array<struct<enter: int, leave: int, cost: long, audit: string>>, rows int"


def repair(inits: str, marks: str, enter: int = START, whole: bool = True) -> dict[int, tuple[int, str]]:
    """End state -> (cost, audit) of the cheapest edits that lead there from state `enter`, ties by the least audit.

    inits: the first character of each row's role, a blank for none; marks: d must be deleted, t truncated, a dot else.
    A search that is `whole` stops at the first accepted end node popped; else it settles all end nodes. The key (cost, audit)
    never falls along an edge, as audits grow; two audits of one node and cost aren't prefixes of each other, as they differ
    in inserts at least, so what is popped first for a node stays the best.
    """
    n, done, out = len(inits), set(), {}
    heap = [(0, "", 0, enter)]
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            out[q] = (cost, audit)
            if whole and q in ACCEPTED:
                return {q: out[q]}
        made = NEXT[q, MADE[q]]
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, made))
        if i < n:
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, q))
            if marks[i] != "d":
                late = TRUNCATED if marks[i] == "t" else 0
                heapq.heappush(heap, (cost + REROLE + late, audit + "R", i + 1, made))
                if (q, inits[i]) in NEXT:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, NEXT[q, inits[i]]))
    return out


def replay(inits: str, enter: int, audit: str) -> list[tuple[str, str | None, int | None]]:
    """(edit, role made or None, row or None) of each edit."""
    q, i, out = enter, 0, []
    for e in audit:
        made = NAMES[MADE[q]] if e in "RI" else None
        if e in "RI":
            q = NEXT[q, MADE[q]]
        elif e == "K":
            q = NEXT[q, inits[i]]
        out.append((e, made, None if e == "I" else i))
        i += e != "I"
    return out


def _mark(fault: str | None) -> str:
    return {"blank": "d", "duplicate": "d", "truncated": "t"}.get(fault, ".")


def _initial(role: str) -> str:
    return role[:1] or " "


def _solver(longest: int, longest_bytes: int):
    """For mapInArrow over range partitions in order of conversation and turn: edits of conversations that lie in the
    partition and fit one block; of others rows as they are, and the block's paths between all states on its first row."""

    def run(batches):
        part, out = TaskContext.get().partitionId(), []
        held, size, at, state = [], 0, 0, {"first": True, "whole": True, "last": None}

        def flush(over: bool):
            """over: the conversation ends here for all that this partition knows."""
            nonlocal held, size, at
            inits, marks = "".join(_initial(r[2]) for r in held), "".join(_mark(r[4]) for r in held)
            if over and state["whole"]:
                (_, (_, audit)), = repair(inits, marks).items()
                for k, (e, made, i) in enumerate(replay(inits, START, audit)):
                    r = held[i] if i is not None else (held[0][0], None, None, "", None, False)
                    out.append((r[0], r[1], made or r[2], r[3], r[4], part, at, k, e, r[5], None, None, None, len(held)))
            else:
                paths = [{"enter": q, "leave": p, "cost": c, "audit": a} for q in range(4) for p, (c, a) in repair(inits, marks, q, False).items()]
                for k, r in enumerate(held):
                    out.append((*r[:5], part, at, k, None, r[5], inits if k == 0 else None, marks if k == 0 else None, paths if k == 0 else None, len(held)))
            at, held, size = at + len(held), [], 0
            state["whole"] = over

        def batch():
            nonlocal out
            cols = list(zip(*out)) if out else [[]] * 14
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])), pa.int32()]
            out = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=_NAMES)

        for b in batches:
            for conv, turn, role, text, fault, again in zip(*(b.column(k).to_pylist() for k in range(6))):
                last = state["last"]
                new = last is None or last[0] != conv
                if held and new:
                    state["whole"] &= not state["first"]  # the partition's first conversation may have begun before it
                    flush(True)
                    state["whole"], state["first"] = True, False
                elif held and (len(held) >= longest or size >= longest_bytes):
                    flush(False)
                if fault != "blank" and (again or (not new and last[1:] == (turn, role, text))):
                    fault = "duplicate"
                held.append((conv, turn, role, text, fault, not new and _initial(last[2]) + _initial(role) not in LEGAL))
                size += len(text)
                state["last"] = (conv, turn, role, text)
            if len(out) >= 512:
                yield batch()
        if held:
            state["whole"] = False  # the last one may go on behind the partition
            flush(False)
        yield batch()

    return run


def _compose(rows):
    """Blocks of one conversation in order: how each is entered, and its audit, for the cheapest edits of all."""
    import pandas as pd

    rows = rows.sort_values(["part", "at"])
    best, slices, extra, before = {START: (0, "", ())}, [], [], None
    for _, r in rows.iterrows():
        extra.append(bool(before is not None and r["at"] == 0 and before + r["inits"][0] not in LEGAL))
        before = r["inits"][-1]
        now: dict = {}
        for p in r["paths"]:
            if p["enter"] in best:
                cost, audit, way = best[p["enter"]]
                k = (cost + p["cost"], audit + p["audit"], (*way, (p["enter"], p["audit"])))
                if p["leave"] not in now or k < now[p["leave"]]:
                    now[p["leave"]] = k
        best = now
    way = min(best[q] for q in ACCEPTED if q in best)[2]
    slices = [(int(r["part"]), int(r["at"]), q, a, r["inits"], x) for (_, r), (q, a), x in zip(rows.iterrows(), way, extra)]
    return pd.DataFrame(slices, columns=["part", "at", "enter", "audit", "inits", "illegal_first"])


def _applied(batches):
    """Edits of rows whose block's audit is known; inserts behind the last row stand with it."""
    for b in batches:
        out, plans = [], {}
        for r in b.to_pylist():
            key = (r["part"], r["at"])
            if key not in plans:
                plans[key] = {}
                for k, (e, made, i) in enumerate(replay(r["block"], r["enter"], r["audit"])):
                    plans[key].setdefault(i, []).append((k, e, made)) if i is not None else plans[key].setdefault("open", []).append((k, e, made))
                    if i is not None:
                        plans[key][i] = plans[key].pop("open", []) + plans[key][i]
            mine = plans[key][r["k"]] + (plans[key].get("open", []) if r["k"] == r["rows"] - 1 else [])
            for k, e, made in mine:
                own = e != "I"
                out.append((r["conv_id"], r["turn"] if own else None, made or r["role"], r["text"] if own else "", r["fault"] if own else None, r["part"], r["at"], k, e, own and (r["illegal"] or (r["k"] == 0 and r["illegal_first"]))))
        cols = list(zip(*out)) if out else [[]] * 10
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["conv_id", "turn", "role", "text", "fault", "part", "at", "k", "edit", "illegal"])


EDITS = ["conv_id", "part", "at", "k", "edit", "fault", "illegal", "turn", "role", "text"]


def edits(rows: DataFrame, longest: int = 1024, longest_bytes: int = 1 << 23) -> DataFrame:
    """The cheapest edits that give each conversation's roles the form `(s?(ua)+)?`, one row each: conv_id, their order by
    (part, at, k), edit (K, R, D or I), the row's fault (blank, duplicate, truncated or null), illegal (its initial may not
    follow that of the row before), turn, role and text as repaired; of deleted rows as they were, of inserts turn null.

    Rows stand by turn, nulls first, then role and text; null roles and texts are one space, a null conv_id is a conversation.
    Extra columns are left out; an empty table has no edits; repeated rows are duplicates.

    Rows are sorted over range partitions, so one conversation may span many. One that lies in its partition with `longest`
    rows at most is searched at once. Longer ones are searched block by block from each state to each, and blocks' results
    (not their rows) are composed for each conversation.
    """
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    own = own.withColumn("th", F.sha2("text", 256))
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    firsts = own.groupBy("conv_id", "role", "th").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("th").alias("_t"), "first")
    met = own.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("th") == F.col("_t")), "left")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    again = F.coalesce(at > F.col("first"), F.lit(False))
    marked = met.select("conv_id", "turn", "role", "text", fault.alias("fault"), again.alias("again"))
    order = ["conv_id", "turn", "role", "text"]
    solved = cut(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_solver(longest, longest_bytes)), _ROW))
    blocks = solved.where("paths is not null").select("conv_id", "part", "at", "inits", "paths")
    ways = cut(blocks.groupBy("conv_id").applyInPandas(_compose, "part int, at long, enter int, audit string, inits string, illegal_first boolean"))
    left = solved.where("edit is null").drop("inits", "paths", "marks", "edit").join(ways.withColumnRenamed("inits", "block"), ["part", "at"])
    late = left.mapInArrow(lean(_applied), "conv_id long, turn long, role string, text string, fault string, part int, at long, k int, edit string, illegal boolean")
    return solved.where("edit is not null").select(*EDITS).unionByName(late.select(*EDITS))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted damage: by crc32(`conv_id:turn`) % 20 a row is dropped, emptied, left without `[.!?]`,
    repeated or given to the user; nulls are one space there and in role and text."""
    blank = F.lit(" ")
    kind = F.pmod(F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))), F.lit(20))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    marked = rows.select("conv_id", "turn", kind.alias("_kind"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 4, "user").otherwise(role).alias("role")).where("_kind <> 0")
    return marked.withColumn("_again", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _cost(edit: Column, fault: Column) -> Column:
    late = F.when(fault == "truncated", TRUNCATED).otherwise(0)
    return F.when(edit == "D", DELETE).when(edit == "I", INSERT).when(edit == "R", REROLE + late).otherwise(late)


def digest(original: DataFrame, damaged: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each conv_id of `original`: gaps, counts of faults, illegal pairs, cost, audit and the hash of the repair.

    Audit and hash are of whole conversations, so each conversation's edits go through one task in order, as a stream: what
    it keeps is the hash's state and one character an edit.
    """
    form = "conv_id long, audit string, repaired_sha256 string"

    def stream(batches):
        sha, audit, last, some = None, [], None, False
        for b in batches:
            out = []
            for conv, e, role, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                if some and conv != last:
                    out.append((last, "".join(audit), sha.hexdigest()))
                if not some or conv != last:
                    sha, audit, last, some, begun = hashlib.sha256(), [], conv, True, False
                audit.append(e)
                if e != "D":
                    sha.update((("\n" if begun else "") + role + ":" + text).encode())
                    begun = True
            yield _three(out)
        yield _three([(last, "".join(audit), sha.hexdigest())] if some else [])

    def _three(out):
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["conv_id", "audit", "repaired_sha256"])

    whole = found.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at", "k").select("conv_id", "edit", "role", "text").mapInArrow(lean(stream), form)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    fault = lambda name: count(F.col("fault") == name).alias(name)
    sums = found.groupBy("conv_id").agg(fault("blank"), fault("duplicate"), fault("truncated"), count(F.col("illegal")).alias("illegal"), F.sum(_cost(F.col("edit"), F.col("fault"))).cast("long").alias("cost"))
    turns = damaged.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    out = original.select("conv_id").distinct()
    for side in (turns, sums, whole):
        side = side.withColumnRenamed("conv_id", "_id")
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
