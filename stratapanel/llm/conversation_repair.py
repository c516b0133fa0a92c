"""Conversation structure repair: the cheapest audit of edits that makes the roles alternate.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials.
Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (the only
choice for a blank row or a duplicate), Insert an empty user or assistant row 3;
a truncated row that stays adds 3.  Among the cheapest audits (the edits'
initials in order) the ASCII-least wins.

Persistent audit DP.  Every prefix of an audit is a node linked to the prefix
before it, so the four states of the role pattern share what they have in
common.  A node keeps its ancestors at powers of two and a rolling hash of its
string; a tie between two audits is settled by searching their longest common
prefix down the ancestors and comparing the first letters that differ.  Equal
hashes of different nodes are verified letter by letter.

At scale.  Rows are ordered by range partitioning on (conversation, turn, role,
text), which spreads a hot conversation over many tasks, and are cut into blocks
of consecutive rows.  A conversation inside a block is audited there.  One that
crosses blocks gets a transfer table per block: cost and audit from each state to
each state.  Audits from one state to different states differ inside the block,
so their rank by string is all a later comparison needs: a conversation is
routed by the same DP over small tables (costs and ranks, no texts), with ranks
as letters.  Texts meet the edits again by the row's place.

Defined results: rows go by turn (nulls first), then role, then text; a null
role or text counts as one space, a null ``conv_id`` is a conversation of its
own; a conversation's repeated rows are duplicates; an empty table gives no rows;
other columns are ignored.  Very long texts never enter Python on the audit's
path.  All initials but s, u and a (as they are written) must be reroled or deleted.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratapanel.llm.arrow import column
from stratapanel.llm.store import width, written

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: Rows of a block; a conversation that crosses blocks costs one transfer table a block.
BLOCK_ROWS = 4096
#: States of the role pattern: start, after s, after u, after a.
NEXT = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NONE_KEPT = (None,) * 4
ROLES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60
#: Letters inside: J is a kept system row, which a written audit calls K; no tie ever sets J against K.
_D, _I, _J, _K, _R = map(ord, "DIJKR")
_MODULUS = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 % _MODULUS
#: Characters that do not count as content.
BLANKS = " \t\n\x0b\f\r"


class Trails:
    """Strings of symbols that share their prefixes; node 0 is the empty one."""

    def __init__(self):
        self.up: list[tuple[int, ...]] = [()]
        self.symbol, self.depth, self.hash = [-1], [0], [0]

    def add(self, parent: int, symbol: int) -> int:
        ups, k = [parent], 0
        while k < len(self.up[ups[k]]):
            ups.append(self.up[ups[k]][k])
            k += 1
        self.up.append(tuple(ups))
        self.symbol.append(symbol)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + symbol + 1) % _MODULUS)
        return len(self.symbol) - 1

    def lifted(self, node: int, depth: int) -> int:
        rest = self.depth[node] - depth
        while rest:
            k = rest.bit_length() - 1
            node = self.up[node][k]
            rest -= 1 << k
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth spell the same string: by hash, then letter by letter down to a shared node."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.symbol[a] != self.symbol[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, x: int, b: int, y: int) -> bool:
        """Whether string(a) + x comes before string(b) + y."""
        if a == b:
            return x < y
        short = min(self.depth[a], self.depth[b])
        p, q = self.lifted(a, short), self.lifted(b, short)
        if self.same(p, q):
            if self.depth[a] == self.depth[b]:
                return x < y
            if self.depth[a] < self.depth[b]:
                return x <= self.symbol[self.lifted(b, short + 1)]
            return self.symbol[self.lifted(a, short + 1)] < y
        for k in reversed(range(len(self.up[p]))):
            if k < len(self.up[p]) and not self.same(self.up[p][k], self.up[q][k]):
                p, q = self.up[p][k], self.up[q][k]
        return self.symbol[p] < self.symbol[q]

    def string(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.symbol[node])
            node = self.up[node][0]
        return out[::-1]


class Best:
    """The best offer (cost, then string) for each of the four states."""

    def __init__(self, trails: Trails):
        self.trails, self.cost, self.parent, self.symbol = trails, [NEVER] * 4, [0] * 4, [0] * 4

    def offer(self, state: int, cost: int, parent: int, symbol: int) -> bool:
        taken = cost < self.cost[state] or cost == self.cost[state] and self.trails.less(parent, symbol, self.parent[state], self.symbol[state])
        if taken:
            self.cost[state], self.parent[state], self.symbol[state] = cost, parent, symbol
        return taken

    def nodes(self) -> list[int]:
        return [self.trails.add(p, x) if c < NEVER else 0 for c, p, x in zip(self.cost, self.parent, self.symbol)]


def _end(trails: Trails, node: int) -> tuple[int, int]:
    return (trails.up[node][0], trails.symbol[node]) if node else (0, -1)


def _inserted(trails: Trails, cost: list[int], node: list[int]) -> tuple[list[int], list[int]]:
    """Costs and nodes with any number of inserts taken now; a state's inserts start from a strictly cheaper one."""
    cost, node, left = list(cost), list(node), [0, 1, 2, 3]
    while left:
        state = min(left, key=cost.__getitem__)
        left.remove(state)
        to, total = NEXT[state], cost[state] + INSERT
        if to in left and total < NEVER:
            if total < cost[to] or total == cost[to] and trails.less(node[state], _I, *_end(trails, node[to])):
                cost[to], node[to] = total, trails.add(node[state], _I)
    return cost, node


def _consumed(trails: Trails, cost: list[int], node: list[int], initial: str, doomed: bool, cut: bool) -> tuple[list[int], list[int]]:
    """Inserts, then one row kept, reroled or deleted."""
    cost, node = _inserted(trails, cost, node)
    best, extra, kept = Best(trails), TRUNCATED if cut else 0, KEPT.get(initial, NONE_KEPT)
    for state in range(4):
        now = cost[state]
        if now >= NEVER:
            continue
        best.offer(state, now + DELETE, node[state], _D)
        if not doomed:
            if kept[state] is not None:
                best.offer(kept[state], now + KEEP + extra, node[state], _J if kept[state] == 1 else _K)
            best.offer(NEXT[state], now + REROLE + extra, node[state], _R)
    return best.cost, best.nodes()


def audited(rows, start: int = 0) -> tuple[Trails, list[int], list[int]]:
    """Costs and nodes of the four states after ``rows`` of (initial, doomed, cut), from one state."""
    trails = Trails()
    cost, node = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for row in rows:
        cost, node = _consumed(trails, cost, node, *row)
    return trails, cost, node


def finished(trails: Trails, cost: list[int], node: list[int]) -> tuple[int, str]:
    """The cheapest, then least, audit that ends where a conversation may end."""
    cost, node = _inserted(trails, cost, node)
    ends = [s for s in (0, 3) if cost[s] < NEVER]
    best = ends[0]
    for s in ends[1:]:
        if cost[s] < cost[best] or cost[s] == cost[best] and trails.less(*_end(trails, node[s]), *_end(trails, node[best])):
            best = s
    return cost[best], "".join(map(chr, trails.string(node[best])))


def transfer(rows, starts=(0, 1, 2, 3)) -> tuple[list[int], list[str], list[int]]:
    """Cost, audit and rank (by audit, among those from one state) from each state to each; cost -1 where there is no way."""
    costs, audits, ranks = [-1] * 16, [""] * 16, [0] * 16
    for start in starts:
        trails, cost, node = audited(rows, start)
        ends = [e for e in range(4) if cost[e] < NEVER]
        for e in ends:
            costs[4 * start + e], audits[4 * start + e] = cost[e], "".join(map(chr, trails.string(node[e])))
        for rank, e in enumerate(sorted(ends, key=lambda e: audits[4 * start + e])):
            ranks[4 * start + e] = rank
    return costs, audits, ranks


def routed(tables) -> tuple[int, list[tuple[int, int]], str]:
    """Total cost, (start, end) of each of the consecutive (costs, ranks) tables, and the inserts after the last."""
    trails, cost, node = Trails(), [0, NEVER, NEVER, NEVER], [0] * 4
    came: list[list[int]] = []
    for costs, ranks in tables:
        best, source = Best(trails), [0] * 4
        for s in range(4):
            for e in range(4):
                if cost[s] < NEVER and costs[4 * s + e] >= 0:
                    if best.offer(e, cost[s] + costs[4 * s + e], node[s], ranks[4 * s + e]):
                        source[e] = s
        cost, node = best.cost, best.nodes()
        came.append(source)
    # What remains is an insert or two; different ends already differ in their strings.
    tails = {0: "", 1: "II", 2: "I", 3: ""}
    ends = [s for s in range(4) if cost[s] < NEVER]
    end = ends[0]
    total = lambda s: cost[s] + INSERT * len(tails[s])
    for s in ends[1:]:
        if total(s) < total(end) or total(s) == total(end) and trails.less(*_end(trails, node[s]), *_end(trails, node[end])):
            end = s
    path, at = [], end
    for source in reversed(came):
        path.append((source[at], at))
        at = source[at]
    return total(end), path[::-1], tails[end]


def _spaced(name: str):
    return F.coalesce(F.col(name), F.lit(" "))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with their ``place`` in the order of (conv_id, turn, role, text), and flags that need the row alone."""
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    slim = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), _spaced("role").alias("role"), _spaced("text").alias("text"))
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    flagged = slim.repartitionByRange(width(rows.sparkSession), *keys).sortWithinPartitions(*keys).select(
        "*", F.monotonically_increasing_id().alias("place"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.sha2("text", 256).alias("digest"))
    return written(flagged, "turns")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, initial, and the first fault of each row: blank, duplicate, truncated or none."""
    first = rows.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first")).select("first")
    kind = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    slim = rows.select("conv_id", "turn", "place", F.substring("role", 1, 1).alias("initial"), "blank", "cut")
    return slim.join(first.hint("merge"), F.col("place") == F.col("first"), "left").select("conv_id", "turn", "place", "initial", kind.alias("fault"))


FRAGMENTS = "conv_id long, block long, place long, n long, whole boolean, illegal long, first string, last string, costs array<long>, ranks array<int>, audits array<string>"


def fragments(found: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation and block: its audit where ``whole``, else its transfer table."""
    names = [c.split()[0] for c in FRAGMENTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]

    def block_of(block, convs, places, rows):
        bounds = [0, *(i for i in range(1, len(convs)) if convs[i] != convs[i - 1]), len(convs)]
        out = []
        for i, j in zip(bounds[:-1], bounds[1:]):
            part, whole = rows[i:j], 0 < i and j < len(convs)
            illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(part[:-1], part[1:]))
            if whole:
                cost, audit = finished(*audited(part))
                table = [cost], [], [audit]
            else:  # what comes first in a block may go on from the block before
                costs, audits, ranks = transfer(part, (0,) if i else (0, 1, 2, 3))
                table = costs, ranks, audits
            out.append((convs[i], block, places[i], j - i, whole, illegal, part[0][0], part[-1][0], *table))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches):
        now, convs, places, rows = None, [], [], []
        for batch in batches:
            data = [column(batch, c).to_pylist() for c in ("block", "conv_id", "place", "initial", "fault")]
            for block, conv, place, initial, fault in zip(*data):
                if block != now:
                    if rows:
                        yield block_of(now, convs, places, rows)
                    now, convs, places, rows = block, [], [], []
                convs.append(conv)
                places.append(place)
                rows.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        if rows:
            yield block_of(now, convs, places, rows)

    # A block's rows lie together: places are consecutive inside a range partition.
    blocks = found.withColumn("block", F.floor(F.col("place") / block_rows).cast("bigint"))
    dealt = blocks.repartition(width(found.sparkSession), "block").sortWithinPartitions("block", "place")
    return dealt.select("block", "conv_id", "place", "initial", "fault").mapInArrow(run, FRAGMENTS)


def audits(parts: DataFrame) -> DataFrame:
    """conv_id, block, place, start, audit, cost and illegal (both on a conversation's last part, else null) of every fragment."""

    def route(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        total, path, tail = routed((r["costs"], r["ranks"]) for r in rows)
        illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows[:-1], rows[1:]))
        end = len(rows) - 1
        return pa.table({
            "conv": pa.array([r["conv_id"] for r in rows], pa.int64()), "part": pa.array([r["block"] for r in rows], pa.int64()),
            "start": pa.array([s for s, _ in path], pa.int32()), "choice": pa.array([4 * s + e for s, e in path], pa.int32()),
            "tail": ["" if k < end else tail for k in range(len(rows))],
            "total": pa.array([None if k < end else total for k in range(len(rows))], pa.int64()), "all_illegal": pa.array([None if k < end else illegal for k in range(len(rows))], pa.int64())})

    whole = parts.where("whole").select("conv_id", "block", "place", F.lit(0).alias("start"), F.col("audits")[0].alias("audit"), F.col("costs")[0].alias("cost"), "illegal")
    crossing = parts.where("not whole")
    routes = crossing.select("conv_id", "block", "illegal", "first", "last", "costs", "ranks").groupBy("conv_id").applyInArrow(
        route, "conv long, part long, start int, choice int, tail string, total long, all_illegal long")
    chosen = crossing.join(routes, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("block") == F.col("part")))
    return whole.unionByName(chosen.select("conv_id", "block", "place", "start", F.concat(F.col("audits")[F.col("choice")], "tail").alias("audit"), F.col("total").alias("cost"), F.col("all_illegal").alias("illegal")))


def edits(found: DataFrame) -> DataFrame:
    """at (the row's place), edit (its letter), role (null: unchanged), before and after (roles inserted around it)."""

    def run(batches):
        for batch in batches:
            out = []
            for place, state, audit in zip(*(column(batch, c).to_pylist() for c in ("place", "start", "audit"))):
                before: list[str] = []
                for letter in audit:
                    role = None
                    if letter != "D":
                        state = 1 if letter == "J" else NEXT[state]
                    if letter in "IR":
                        role = ROLES[state]
                    if letter == "I":
                        before.append(role)
                        continue
                    out.append([place, "K" if letter == "J" else letter, role, before, []])
                    place, before = place + 1, []
                if before:
                    out[-1][4] = before
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.string()),
                 pa.array([r[3] for r in out], pa.list_(pa.string())), pa.array([r[4] for r in out], pa.list_(pa.string()))],
                ["at", "edit", "role", "before", "after"])

    return found.select("place", "start", "audit").mapInArrow(run, "at long, edit string, role string, before array<string>, after array<string>")


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """The repaired rows and the report.

    Repaired rows: conv_id, place, part (their order in a conversation), turn
    (null where inserted), role, text, edit (I, K or R).  Report: a row for every
    conversation of ``rows``: conv_id, gaps (turns missing between the least and
    the largest), blank, duplicate, truncated, illegal (adjacent roles out of
    order), cost, audit.
    """
    turns = ordered(rows)
    found = written(faults(turns), "faults")
    paths = written(audits(written(fragments(found, block_rows), "fragments")), "audits")
    changes = edits(paths)
    made = lambda roles: F.transform(roles, lambda r: F.struct(F.lit(None).cast("bigint").alias("turn"), r.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    texts = turns.select("conv_id", "turn", F.col("role").alias("was"), "text", "place")
    met = texts.hint("merge").join(changes, F.col("place") == F.col("at"))
    own = F.struct("turn", F.coalesce("role", "was").alias("role"), "text", "edit")
    stays = F.when(F.col("edit") == "D", F.filter(F.array(own), lambda x: F.lit(False))).otherwise(F.array(own))
    fixed = met.select("conv_id", "place", F.posexplode(F.concat(made(F.col("before")), stays, made(F.col("after")))).alias("part", "r")).select("conv_id", "place", "part", "r.*")

    kinds = [F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")]
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = found.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *kinds)
    text = F.translate(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda p: p["audit"]), ""), "J", "K")
    sums = paths.groupBy(F.col("conv_id").alias("conv")).agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), text.alias("audit"))
    report = counts.join(sums, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    return fixed, report


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id and sha256 (lowercase hex) of its ``role:text`` rows, newline-joined: each conversation streams through one task, a batch at a time."""

    def run(batches):
        now, state = None, None
        for batch in batches:
            convs, digests = [], []
            for conv, role, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or conv != now:
                    if state is not None:
                        convs.append(now)
                        digests.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(digests, pa.string())], ["conv", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["conv", "sha256"])

    dealt = fixed.repartition("conv_id").sortWithinPartitions("conv_id", "place", "part")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv long, sha256 string")
