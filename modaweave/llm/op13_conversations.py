"""Conversation repair by alignment with the alternating grammar ``(s?(ua)+)?``.

Turns are aligned with each feasible length of the grammar's string by Wagner-Fischer: keep a turn (0),
give it the wanted role (1), delete it (2, forced for blank and duplicate turns), insert an empty turn
(5); a truncated turn that stays costs 5 more.  Strings of all lengths share their ends, so one table
over (turn, letters left) holds every alignment.  A plain left-to-right repair gives the incumbent cost,
and what it costs beyond the least that any repair pays bounds the diagonals, as Ukkonen does.  Cheapest
lengths are traced and their audits compared; the least in ASCII order stays.

A conversation of more than ``MOST`` turns or ``MOST_BYTES`` of text is not gathered.  Its turns are
ranked by a distributed sort and cut into chunks; each chunk is aligned for every grammar state before
and after it.  Costs to go run back over the chunks, a chunk then knows its best way on from each state,
and states run forward: two passes over a small record a chunk.  Only the digest passes over the texts in
order, as a hash must, a chunk at a time.

Order is by turn, nulls first; equal turns stand in order of role, then text.  Null role and text are one
space; a null conversation id is a conversation of its own, a null turn is ignored by ``gaps``.  Ids whose
rows are all dropped give zeros; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ordered_rank
from ..session import broadcast_small, cut_lineage

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
MOST, MOST_BYTES, CHUNK = 1024, 32 << 20, 512
NAMES = {"u": "user", "a": "assistant"}
OTHER = {"u": "a", "a": "u"}
LEGAL = {"su", "ua", "au"}
#: States between chunks: nothing yet, a system turn only, user next, assistant next.
STATES = "ZSua"
INF = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
_solid = re.compile(r"[^\x20\x09-\x0D]").search


class Turn(NamedTuple):
    """What the alignment sees of a turn: first letter of the role, deletion forced, cut off."""

    initial: str
    gone: bool
    cut: bool


def least_cost(turns: list[Turn]) -> int:
    """What every repair pays: a deletion for each blank, duplicate or truncated turn."""
    return DELETE * sum(t.gone or t.cut for t in turns)


def plain_repair(turns: list[Turn], letter: str) -> tuple[int, str]:
    """(cost, letter wanted next) of keeping every turn that may stay, with the wanted role."""
    cost = 0
    for t in turns:
        if t.gone:
            cost += DELETE
        else:
            cost += (t.initial != letter) * REROLE + t.cut * CUT_OFF
            letter = OTHER[letter]
    return cost, letter


class Table:
    """Costs to align the turns from the i-th on with the last j letters of the alternating string that
    leaves ``after`` wanted next.  ``open_end``: letters may be inserted behind the last turn."""

    def __init__(self, turns: list[Turn], after: str, incumbent: int, open_end: bool):
        self.turns, self.after = turns, after
        slack = incumbent - least_cost(turns)
        up, down = slack // INSERT, slack // DELETE
        usable = cut = 0
        row = [k * INSERT for k in range(up + 1)] if open_end else [0] + [INF] * up
        self.first, self.cost = [0], [row]
        for t in reversed(turns):
            usable += not t.gone
            cut += t.cut and not t.gone
            lo, below, base = max(0, usable - cut - down), self.first[-1], self.cost[-1]
            row = []
            stay = CUT_OFF if t.cut else 0
            for j in range(lo, usable + up + 1):
                best = base[j - below] + DELETE if 0 <= j - below < len(base) else INF
                if j and not t.gone and 0 <= j - 1 - below < len(base):
                    best = min(best, base[j - 1 - below] + stay + (KEEP if t.initial == self.letter(j) else REROLE))
                if row and row[-1] + INSERT < best:
                    best = row[-1] + INSERT
                row.append(best)
            self.first.append(lo)
            self.cost.append(row)
        self.first.reverse()
        self.cost.reverse()

    def letter(self, j: int) -> str:
        """The j-th letter from the end."""
        return OTHER[self.after] if j % 2 else self.after

    def at(self, i: int, j: int) -> int:
        k = j - self.first[i]
        return self.cost[i][k] if 0 <= k < len(self.cost[i]) else INF

    def lengths(self, i: int, entry: str, least: int = 0) -> range:
        """Letters left that the band holds at turn i and that begin with ``entry``."""
        lo = max(self.first[i], least)
        return range(lo + (lo % 2 != (entry != self.after)), self.first[i] + len(self.cost[i]), 2)

    def audit(self, i: int, j: int) -> str:
        """Initials of the cheapest edits from (i, j) on, the least in ASCII order."""
        out = []
        n = len(self.turns)
        while i < n or j:
            here = self.at(i, j)
            if i < n and self.at(i + 1, j) + DELETE == here:
                out.append("D")
                i += 1
                continue
            if j and self.at(i, j - 1) + INSERT == here:
                out.append("I")
                j -= 1
                continue
            out.append("K" if self.turns[i].initial == self.letter(j) else "R")
            i, j = i + 1, j - 1
        return "".join(out)


Option = tuple[int, str]


def _least(options: list[tuple[int, Callable[[], str]]]) -> Option | None:
    """The cheapest option; audits are traced and compared only where costs are equal."""
    cost = min((c for c, _ in options), default=INF)
    return (cost, min(trace() for c, trace in options if c == cost)) if cost < INF else None


def _after_system(turns: list[Turn], table: Table, least: int) -> list[tuple[int, Callable[[], str]]]:
    """Alignments that delete some first turns, keep a system turn and go on with ``least`` letters or more."""
    out = []
    for i, t in enumerate(turns):
        if t.initial == "s" and not t.gone:
            spent = DELETE * i + CUT_OFF * t.cut
            for j in table.lengths(i + 1, "u", least):
                out.append((spent + table.at(i + 1, j), lambda i=i, j=j: "D" * i + "K" + table.audit(i + 1, j)))
    return out


def repaired(turns: list[Turn]) -> Option:
    """(cost, audit) of a whole conversation: every feasible length, with and without a system turn."""
    cost, letter = plain_repair(turns, "u")
    incumbent = cost + (INSERT if letter == "a" else 0)
    lead = next((i for i, t in enumerate(turns) if not t.gone), None)
    if lead is not None and turns[lead].initial == "s":
        cost, letter = plain_repair(turns[lead + 1 :], "u")
        kept = len([t for t in turns[lead + 1 :] if not t.gone])
        if kept:
            incumbent = min(incumbent, DELETE * lead + CUT_OFF * turns[lead].cut + cost + (INSERT if letter == "a" else 0))
    table = Table(turns, "u", min(incumbent, DELETE * len(turns)), True)
    options = [(table.at(0, j), lambda j=j: table.audit(0, j)) for j in table.lengths(0, "u")]
    best = _least(options + _after_system(turns, table, 2))
    assert best is not None
    return best


def transitions(turns: list[Turn]) -> list[Option | None]:
    """(cost, audit) of a chunk from each state to each state, in the order of ``STATES`` squared."""
    found: dict[str, Option | None] = {}
    wipe = DELETE * len(turns)
    found["ZZ"] = found["SS"] = (wipe, "D" * len(turns))
    lone = [(wipe - DELETE + CUT_OFF * t.cut, lambda i=i: "D" * i + "K" + "D" * (len(turns) - i - 1)) for i, t in enumerate(turns) if t.initial == "s" and not t.gone]
    found["ZS"] = _least(lone)
    usable = sum(not t.gone for t in turns)
    for after in "ua":
        # One table serves all ways in; its incumbent is the dearest of their plain repairs.
        incumbent = 0
        for entry in "ua":
            same = (usable % 2 == 0) == (entry == after)
            incumbent = max(incumbent, plain_repair(turns, entry)[0] if same else INSERT + plain_repair(turns, OTHER[entry])[0])
        # A way in from "nothing yet" or "a system turn only" needs a letter here: one inserted pair at most.
        table = Table(turns, after, incumbent + 2 * INSERT, False)
        for entry in "ua":
            found[entry + after] = _least([(table.at(0, j), lambda j=j, t=table: t.audit(0, j)) for j in table.lengths(0, entry)])
        begun = [(table.at(0, j), lambda j=j, t=table: t.audit(0, j)) for j in table.lengths(0, "u", 1)]
        found["S" + after] = _least(begun)
        found["Z" + after] = _least(begun + _after_system(turns, table, 1))
    return [found.get(x + y) for x in STATES for y in STATES]


#: Edits behind the last turn that close a conversation in each state.
CLOSING = {"Z": "", "S": "II", "u": "", "a": "I"}


def edited(turns: list[tuple[str, str]], audit: str, state: str) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of each edit; a deletion has neither role nor text."""
    k = 0
    for edit in audit:
        if edit == "D":
            k += 1
            yield edit, None, None
            continue
        role, text = ("", "") if edit == "I" else turns[k]
        k += edit != "I"
        if edit == "K" and role[:1] == "s":
            state = "S"
        else:
            letter = state if state in OTHER else "u"
            if edit != "K":
                role = NAMES[letter]
            state = OTHER[letter]
        yield edit, role, text


# Spark


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, here: rows damaged by crc32 of ``conv_id:turn`` modulo 20.

    A dropped row stays as a mark of its conversation with ``here`` false."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    case = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    hit = rows.withColumn("_case", case)
    text = F.when(F.col("_case") == 1, "").when(F.col("_case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_case") == 4, "user").otherwise(F.col("role"))
    out = hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), "_case").withColumn("here", F.col("_case") != 0)
    blank_dropped = [F.when(F.col("here"), F.col(c)).alias(c) for c in ("turn", "role", "text")]
    twice = F.explode(F.when(F.col("_case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", *blank_dropped, "here", twice.alias("_copy")).drop("_copy")


def _is_blank(text: str) -> bool:
    return _solid(text) is None


def _is_cut(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in (".", "!", "?")


class Digest:
    """Running record of one conversation, fed a chunk at a time."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.distinct = 0
        self.first = self.last = self.before = None
        self.audit: list[str] = []
        self.sha, self.begun = hashlib.sha256(), False

    def add_turns(self, initials: list[str], turns: list[int | None], blank: int, duplicate: int, truncated: int) -> None:
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        for x in initials:
            if self.before is not None and self.before + x not in LEGAL:
                self.illegal += 1
            self.before = x
        for t in turns:
            if t is not None and t != self.last:
                self.distinct += 1
                self.first = t if self.first is None else self.first
                self.last = t

    def add_edits(self, cost: int, audit: str, lines: list[str]) -> None:
        self.cost += cost
        self.audit.append(audit)
        for line in lines:
            self.sha.update(("\n" + line if self.begun else line).encode())
            self.begun = True

    def row(self, conv_id: int | None) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.last is not None else 0
        return conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def _lines(edits: list[tuple[str, str | None, str | None]]) -> list[str]:
    return [f"{role}:{text}" for _, role, text in edits if role is not None]


def _one(conv_id: int | None, rows: list[tuple[int | None, str, str]], turns: bool) -> list[tuple]:
    """Output rows of a conversation whose rows fit: its digest, or its edits."""
    seen: set[tuple[str, str]] = set()
    faults, counts = [], [0, 0, 0]
    for _, role, text in rows:
        blank = _is_blank(text)
        again = not blank and (role, text) in seen
        cut = not (blank or again) and _is_cut(text)
        seen.add((role, text))
        for k, hit in enumerate((blank, again, cut)):
            counts[k] += hit
        faults.append(Turn(role[:1], blank or again, cut))
    cost, audit = repaired(faults)
    edits = list(edited([(role, text) for _, role, text in rows], audit, "Z"))
    if turns:
        return [(conv_id, k, *e) for k, e in enumerate(edits)]
    d = Digest()
    d.add_turns([t.initial for t in faults], [t for t, _, _ in rows], *counts)
    d.add_edits(cost, audit, _lines(edits))
    return [d.row(conv_id)]


def _batches(rows: Iterator[tuple], schema: str, size: int = 2000) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, rows that are there) of each conversation in a sorted partition."""
    current, rows, begun = None, [], False
    for batch in batches:
        for conv_id, here, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "here", "turn", "role", "text")), strict=True):
            if not begun or conv_id != current:
                if begun:
                    yield current, rows
                current, rows, begun = conv_id, [], True
            if here:
                rows.append(tuple(row))
    if begun:
        yield current, rows


def _ordinary(rows: DataFrame, turns: bool) -> DataFrame:
    schema = TURNS if turns else DIGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((x for conv_id, group in _grouped(batches) for x in _one(conv_id, group, turns)), schema)

    laid = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return laid.mapInArrow(run, schema)


def _large(rows: DataFrame, turns: bool, chunk: int) -> DataFrame:
    """The same for conversations that no task may hold."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    there = rows.filter("here").select(key.alias("_c"), "turn", "role", "text")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranked = cut_lineage(ordered_rank(there, order, ["_c"], "_rank"))
    firsts = ranked.groupBy("_c", "role", "text").agg(F.min("_rank").alias("_rank")).select("_c", "_rank", F.lit(True).alias("_first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = ~blank & F.col("_first").isNull()
    cut = ~blank & ~again & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    laid = cut_lineage(
        ranked.join(firsts, ["_c", "_rank"], "left").select(
            "_c", F.expr(f"(_rank - 1) div {chunk}").alias("_chunk"), "_rank", "turn", "role", "text", blank.alias("blank"), again.alias("again"), cut.alias("cut")
        )
    )

    def faults(pdf: pd.DataFrame) -> list[Turn]:
        return [Turn(r[:1], bool(b or d), bool(c)) for r, b, d, c in zip(pdf["role"], pdf["blank"], pdf["again"], pdf["cut"], strict=True)]

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        found = transitions(faults(pdf.sort_values("_rank")))
        return pd.DataFrame({"_c": [pdf["_c"].iat[0]], "_chunk": [pdf["_chunk"].iat[0]], "costs": [[INF if x is None else x[0] for x in found]], "audits": [["" if x is None else x[1] for x in found]]})

    options = cut_lineage(laid.drop("turn", "text").groupBy("_c", "_chunk").applyInPandas(ways, "_c string, _chunk long, costs array<long>, audits array<string>"))

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, togo = None, []
        for pdf in batches:
            out = []
            for c, k, costs in zip(pdf["_c"], pdf["_chunk"], pdf["costs"], strict=True):
                if c != current:
                    current, togo = c, [INSERT * len(CLOSING[s]) for s in STATES]
                out.append((c, k, togo))
                togo = [min(INF, min(costs[4 * x + y] + togo[y] for y in range(4))) for x in range(4)]
            yield pd.DataFrame(out, columns=["_c", "_chunk", "togo"])

    ends = options.drop("audits").repartition("_c").sortWithinPartitions("_c", F.desc("_chunk")).mapInPandas(back, "_c string, _chunk long, togo array<long>")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            steps = [[min(range(4), key=lambda y: (c[4 * x + y] + t[y], a[4 * x + y])) for x in range(4)] for c, a, t in zip(pdf["costs"], pdf["audits"], pdf["togo"], strict=True)]  # noqa: B023
            yield pd.DataFrame({"_c": pdf["_c"], "_chunk": pdf["_chunk"], "costs": pdf["costs"], "audits": pdf["audits"], "step": steps})

    chosen = cut_lineage(options.join(ends, ["_c", "_chunk"]).mapInPandas(choose, "_c string, _chunk long, costs array<long>, audits array<string>, step array<int>"))

    def forth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, 0
        for pdf in batches:
            out = []
            for c, k, step in zip(pdf["_c"], pdf["_chunk"], pdf["step"], strict=True):
                if c != current:
                    current, state = c, 0
                out.append((c, k, state))
                state = int(step[state])
            yield pd.DataFrame(out, columns=["_c", "_chunk", "state"])

    states = chosen.select("_c", "_chunk", "step").repartition("_c").sortWithinPartitions("_c", "_chunk").mapInPandas(forth, "_c string, _chunk long, state int")
    last = chosen.groupBy("_c").agg(F.max("_chunk").alias("_last"))
    way = F.expr("4 * state + step[state]")
    taken = chosen.join(states, ["_c", "_chunk"]).join(last, "_c").select(
        "_c", "_chunk", "state", F.col("costs")[way].alias("cost"), F.col("audits")[way].alias("audit"), F.when(F.col("_chunk") == F.col("_last"), F.expr("step[state]")).alias("_end")
    )

    def write(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pdf, way = left.sort_values("_rank"), right.iloc[0]
        audit, cost, state = way["audit"], int(way["cost"]), STATES[int(way["state"])]
        edits = list(edited(list(zip(pdf["role"], pdf["text"], strict=True)), audit, state))
        if pd.notna(way["_end"]):
            end = STATES[int(way["_end"])]
            extra = CLOSING[end]
            edits += edited([], extra, end)
            audit, cost = audit + extra, cost + INSERT * len(extra)
        return pd.DataFrame({
            "_c": [way["_c"]], "_chunk": [way["_chunk"]], "cost": [cost], "audit": [audit],
            "edits": [[{"edit": e, "role": r, "text": t} for e, r, t in edits]],
            "initials": [[r[:1] for r in pdf["role"]]], "turns": [[None if pd.isna(t) else int(t) for t in pdf["turn"].astype(object)]],
            "blank": [int(pdf["blank"].sum())], "again": [int(pdf["again"].sum())], "cut": [int(pdf["cut"].sum())],
        })

    schema = "_c string, _chunk long, cost long, audit string, edits array<struct<edit:string,role:string,text:string>>, initials array<string>, turns array<long>, blank long, again long, cut long"
    text_turn = laid.withColumn("turn", F.col("turn").cast("string"))
    done = text_turn.groupBy("_c", "_chunk").cogroup(taken.groupBy("_c", "_chunk")).applyInPandas(write, schema)
    conv_id = F.when(F.col("_c") != "none", F.col("_c")).cast("bigint")
    if turns:
        each = done.select(conv_id.alias("conv_id"), (F.col("_chunk") * (4 * chunk)).alias("_base"), F.posexplode("edits").alias("_at", "_e"))
        return each.select("conv_id", (F.col("_base") + F.col("_at")).alias("place"), "_e.edit", "_e.role", "_e.text")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, d = None, None
        for batch in batches:
            for x in batch.to_pylist():
                if x["_c"] != current:
                    if d:
                        yield d.row(None if current == "none" else int(current))
                    current, d = x["_c"], Digest()
                d.add_turns(x["initials"], x["turns"], x["blank"], x["again"], x["cut"])
                d.add_edits(x["cost"], x["audit"], _lines([(e["edit"], e["role"], e["text"]) for e in x["edits"]]))
        if d:
            yield d.row(None if current == "none" else int(current))

    laid_out = done.repartition("_c").sortWithinPartitions("_c", "_chunk")
    return laid_out.mapInArrow(lambda b: _batches(records(b), DIGEST), DIGEST)


def repair(rows: DataFrame, turns: bool = False, most: int = MOST, chunk: int = CHUNK) -> DataFrame:
    """Repair of rows (conv_id, turn, role, text without nulls, here).

    By default a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.  ``turns`` gives the edits instead: conv_id, place (ascending), edit, role, text.
    """
    sizes = rows.filter("here").groupBy("conv_id").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("_b"))
    large = broadcast_small(sizes.filter((F.col("_n") > most) | (F.col("_b") > MOST_BYTES)).select(F.col("conv_id").alias("_large")))
    if large.isEmpty():
        return _ordinary(rows, turns)
    same = rows.conv_id.eqNullSafe(large._large)
    return _ordinary(rows.join(large, same, "left_anti"), turns).unionByName(_large(rows.join(large, same, "left_semi"), turns, chunk))


def op13(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
