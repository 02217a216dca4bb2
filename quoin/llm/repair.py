"""Repair of the structure of conversations, by auction.

A conversation is sound if its role initials are none, or pairs of user and assistant behind an
optional system turn. Rows may be kept (0), given another role (1) or deleted (2), and empty user
or assistant turns inserted (5). Blank and repeated rows must go; a truncated row that stays costs
5 more. The cheapest repair is a shortest path over a lattice of (rows read, role written last).

The path is found by auction. Nodes have prices, at first zero, that no arc undercuts: a price is
at most an arc's cost and the price behind it. A path grows from the node asked for: where the
cheapest arc behind its end is as cheap as the end's price it is extended by it, else the price
rises to that cost and the path contracts by a node. It ends at a node whose price is settled,
and settles all it has. Nodes are asked for in rows from the last to the first, ``STRIDE`` rows
apart, and those before start at the least price found, so that a long conversation costs in
proportion. Arcs whose cost is the difference of their settled prices are tight; the edits are
traced along tight arcs, of several by the least letter: D(elete), I(nsert), K(eep), R(ole).

On Spark, rows are dealt by conversation and sorted. Each comes twice: first as facts (initial,
fault, digest), from which the edits are found, then with its text, which goes into the digest of
the repaired conversation as it passes. So a task holds of a conversation some bytes a row and a
letter for each edit, which its one result row has as well, and no texts.

Rows are ordered by turn, nulls first, those of one turn by role and text's digest. Null role and
text are one space, in the damaging rule null turns and conv_ids too. A null conv_id is a
conversation like others. A role's first character is its initial; a row of an empty role can't be
kept. Texts of any length count whole. A conversation that has lost all rows has zeros and empty
strings; a table without rows has no conversations. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import read

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: Rows between those whose nodes are settled in turn.
STRIDE = 16
#: Roles written last: none, system, user, assistant; what may follow each, and where that leads.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
SOUND_PAIRS = {"su", "ua", "au"}
CLEAN, BLANK, DUPLICATE, CUT_OFF = range(4)
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


class Lattice:
    """Nodes are 4 * rows read + role written last."""

    def __init__(self, initials: list[str], faults: list[int]):
        self.initials, self.faults, self.n = initials, faults, len(initials)
        self.price = [0] * (4 * self.n + 4)
        self.settled = bytearray(4 * self.n + 4)
        for last in (NONE, ASSISTANT):  # a sound end
            self.settled[4 * self.n + last] = 1

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, next node, cost) in the order of the letters."""
        i, last = divmod(node, 4)
        turn = "a" if last == USER else "u"
        insert = ("I", 4 * i + NEXT[last][turn], INSERT)
        if i == self.n:
            return [insert]
        out = [("D", node + 4, DELETE), insert]
        fault = self.faults[i]
        if fault in (CLEAN, CUT_OFF):
            more = TRUNCATED if fault == CUT_OFF else 0
            kept = NEXT[last].get(self.initials[i])
            if kept is not None:
                out.append(("K", 4 * (i + 1) + kept, more))
            out.append(("R", 4 * (i + 1) + NEXT[last][turn], REROLE + more))
        return out

    def settle(self, node: int) -> None:
        """Make the price of ``node`` the cost of the cheapest way to the end."""
        price, settled = self.price, self.settled
        path = [node]
        while not settled[path[-1]]:
            end = path[-1]
            cost, best = min((c + price[to], to) for _, to, c in self.arcs(end))
            if price[end] < cost:
                price[end] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)
        for x in path:
            settled[x] = 1

    def solve(self) -> tuple[int, str]:
        """The least cost, and the edits' letters."""
        for i in range(self.n - self.n % STRIDE, 0, -STRIDE):
            for last in range(4):
                self.settle(4 * i + last)
            # no node before these can cost less than the cheapest of them
            self.price[4 * max(0, i - STRIDE) : 4 * i] = [min(self.price[4 * i : 4 * i + 4])] * (4 * min(STRIDE, i))
        node, out = NONE, []
        self.settle(node)
        while not (node >= 4 * self.n and node - 4 * self.n in (NONE, ASSISTANT)):
            for letter, to, cost in self.arcs(node):
                if cost + self.price[to] > self.price[node]:
                    continue
                self.settle(to)
                if cost + self.price[to] == self.price[node]:
                    out.append(letter)
                    node = to
                    break
        return self.price[NONE], "".join(out)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as the damaging rule leaves it, and ``gone`` where it drops a
    row; such rows stay as marks of their conversations."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    role = F.when(case == 4, "user").otherwise(known("role"))
    made = rows.select("conv_id", F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (case == 0).alias("gone"), F.when(case == 3, 2).otherwise(1).alias("times"))
    return made.withColumn("copy", F.explode(F.expr("sequence(1, times)"))).drop("times", "copy")


def facts(rows: DataFrame) -> DataFrame:
    """Each row twice: ``phase`` 0 without its text, then 1 with it."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT_OFF).otherwise(CLEAN)
    told = rows.withColumns({"fault": fault, "digest": F.unhex(F.md5(F.col("text").cast("binary"))), "phase": F.explode(F.expr("IF(gone, array(0), array(0, 1))"))})
    return told.withColumn("text", F.when(F.col("phase") == 1, F.col("text")))


class Conversation:
    """One conversation as its rows pass: facts first, then texts."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.roles: list[str] = []
        self.faults: list[int] = []
        self.seen: set[tuple[str, bytes]] = set()
        self.turns: set[int] = set()
        self.audit = None

    def fact(self, turn, role: str, fault: int, digest: bytes) -> None:
        if turn is not None:
            self.turns.add(turn)
        key = (role, digest)
        if fault != BLANK and key in self.seen:
            fault = DUPLICATE
        self.seen.add(key)
        self.roles.append(role)
        self.faults.append(fault)

    def decide(self) -> None:
        self.initials = [role[:1] for role in self.roles]
        self.cost, self.audit = Lattice(self.initials, self.faults).solve()
        self.at, self.last, self.digest, self.first = 0, NONE, hashlib.sha256(), True

    def say(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False
        self.last = NEXT[self.last][role[:1]]

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.say(ROLES["a" if self.last == USER else "u"], "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        if self.audit is None:
            self.decide()
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            self.say(role if letter == "K" else ROLES["a" if self.last == USER else "u"], text)

    def result(self) -> tuple:
        if self.audit is None:
            self.decide()
        self.inserted()
        count = self.faults.count
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        illegal = sum(a + b not in SOUND_PAIRS for a, b in zip(self.initials, self.initials[1:]))
        return self.conv_id, gaps, count(BLANK), count(DUPLICATE), count(CUT_OFF), illegal, self.cost, self.audit, self.digest.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text, gone): its faults, the
    least cost, the edits (``audit``) and the digest of the repaired conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        for batch in batches:
            out = []
            for conv_id, gone, phase, turn, role, fault, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv_id != now.conv_id:
                    if started:
                        out.append(now.result())
                    now, started = Conversation(conv_id), True
                if phase:
                    now.text(role, text)
                elif not gone:
                    now.fact(turn, role, fault, digest)
            yield made(out)
        if started:
            yield made([now.result()])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    order = ["conv_id", "phase", F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = facts(rows).repartition("conv_id").sortWithinPartitions(*order)
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return dealt.select("conv_id", "gone", "phase", "turn", "role", "fault", "digest", "text").mapInArrow(run, schema)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the rule and repaired at the least cost."""
    return repaired(damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
