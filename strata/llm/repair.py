"""Conversation structure repair by the auction algorithm for shortest paths.

A conversation must read as role initials ``(s?(ua)+)?``.  Its rows, in order,
span a lattice: a node is a number of rows done and a state (nothing yet, after
s, after u, after a), an arc an edit with an integer cost.  Keep costs 0,
Rerole to user or assistant 3, Delete 4 (required for blank and duplicate
rows), Insert of an empty user or assistant row 3; a truncated row that is not
deleted adds 3.  The auction extends a path from the origin along the arc of
least cost plus price, and contracts it, raising the last node's price, where
no arc is tight.  Prices start at what the rows left cost at least, so only the
alternation has to be bid for.  At the end every arc of every cheapest path is
tight, and the tight arcs that reach the goal are traced by least edit initial.

On Spark, equal rows of a conversation are counted first, the rest is sorted by
conversation and order over range partitions, and cut into segments of
``SEGMENT`` rows.  A conversation in one segment is repaired there.  Segments
of others first bid for the costs between their border states, all at once; a
lattice of borders, of bounded blocks, then fixes each border's prices.  Only
one code a row travels so far; texts are shuffled once, and hashed as a sorted
stream, never gathered.

A null conv_id is a conversation of its own; a null turn comes first; a null
role or text is one space.  Rows of one turn go by role, then by the text's
SHA-256.  A role counts by its first character, and an empty one fits nowhere.
A conversation without rows after damage gets zeros, an empty audit and the
hash of the empty string.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm.common import crc32_sql, for_workers, table, written

SEGMENT_BITS = 7  # a segment holds 2**7 different rows at most
SEGMENT = 1 << SEGMENT_BITS
BORDERS = 32  # segments of one lattice of borders
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INF = float("inf")

START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = (0, INF, INF, 0)  # a repaired conversation ends before its first row or after an assistant
AFTER = (USER, USER, ASSISTANT, USER)  # state after a user or assistant row put where it must be
# A row's code: its role's initial (o: none of these), lower case; upper case if truncated; w-z if to be deleted.
CODES = {c: (kind, i) for kind, letters in enumerate(("suao", "SUAO", "wxyz")) for i, c in enumerate(letters)}
_ROLE_STATES = (SYSTEM, USER, ASSISTANT, None)
_ITEMS = re.compile(r"([a-zA-Z])(\d*)")  # a code and how many equal rows follow
_BLANK = r"[^\x20\x09-\x0D]"


# ---- the lattice and the auction -----------------------------------------------------------

def auction(arcs: list[list[tuple]], price: list[float], origin: int, goal: int) -> None:
    """Raises ``price`` until a path of tight arcs leads from origin to goal (or
    the origin's price is infinite).  Arcs are (label, cost, head); prices must
    not exceed cost plus the head's price of any arc, and never will; nodes with
    no way to the goal must have an infinite price."""
    path = [origin] if price[origin] < INF else [goal]
    while path[-1] != goal:
        i = path[-1]
        best, head = INF, -1
        for _, cost, j in arcs[i]:
            if cost + price[j] < best:
                best, head = cost + price[j], j
        if price[i] < best:  # nothing tight leaves here: contract
            price[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)


def parse(codes: str) -> list[tuple[int, int, int]]:
    """(kind, role, equal rows after it) of each row of a segment."""
    return [(*CODES[c], int(n or 0)) for c, n in _ITEMS.findall(codes)]


def _least(kind: int, role: int, more: int) -> int:
    """What a row and its repeats cost at least."""
    forced = (0, 0, 0, REROLE)[role] if kind == 0 else (min(TRUNCATED + (REROLE if role == 3 else 0), DELETE)) if kind == 1 else DELETE
    return forced + more * DELETE


def _reaching(arcs: list[list[tuple]], goal: int) -> set[int]:
    """The nodes from which some arcs lead to the goal."""
    back: list[list[int]] = [[] for _ in arcs]
    for i, out in enumerate(arcs):
        for _, _, j in out:
            back[j].append(i)
    live, todo = {goal}, [goal]
    while todo:
        for i in back[todo.pop()]:
            if i not in live:
                live.add(i)
                todo.append(i)
    return live


class Segment:
    """The lattice of some rows: node 4 * rows done + state, and one goal."""

    def __init__(self, rows: list[tuple[int, int, int]], ends: tuple):
        n = len(rows)
        self.rows, self.goal = rows, 4 * n + 4
        self.arcs: list[list[tuple]] = [[] for _ in range(4 * n + 5)]
        self.price: list[float] = [0.0] * (4 * n + 5)
        for state in range(4):
            if ends[state] < INF:
                self.arcs[4 * n + state].append(("", ends[state], self.goal))
        rest = min(ends)
        for i in range(n, -1, -1):
            for state in range(4):
                here = self.arcs[4 * i + state]
                if i < n:
                    kind, role, more = rows[i]
                    below, repeats = 4 * (i + 1), more * DELETE
                    here.append(("D", DELETE + repeats, below + state))
                    here.append(("I", INSERT, 4 * i + AFTER[state]))
                    if kind < 2:
                        extra = repeats + (TRUNCATED if kind else 0)
                        to = _ROLE_STATES[role]
                        if to == AFTER[state] or (to == SYSTEM and state == START):
                            here.append(("K", extra, below + to))
                        here.append(("R", REROLE + extra, below + AFTER[state]))
                else:
                    here.append(("I", INSERT, 4 * i + AFTER[state]))
                self.price[4 * i + state] = rest
            if i:
                rest += _least(*rows[i - 1])
        if ends[USER] == ends[ASSISTANT] == INF:  # else inserts lead there from anywhere
            live = _reaching(self.arcs, self.goal)
            self.price = [p if i in live else INF for i, p in enumerate(self.price)]

    def cost_from(self, state: int) -> float:
        auction(self.arcs, self.price, state, self.goal)
        return self.price[state]

    def trace(self, state: int) -> tuple[list[str], int]:
        """The ASCII-least cheapest edits from a state: one string a row (inserts
        before it, then its own edit; the last may end in inserts), and the last state."""
        self.cost_from(state)
        tight = [[a for a in arcs if self.price[i] == a[1] + self.price[a[2]]] for i, arcs in enumerate(self.arcs)]
        live = _reaching(tight, self.goal)
        labels, current, at = [], "", state
        while True:
            label, _, to = min(a for a in tight[at] if a[2] in live)
            if to == self.goal:
                break
            current += label
            if to // 4 != at // 4:
                labels.append(current)
                current = ""
            at = to
        if current:
            labels[-1:] = [(labels[-1] if labels else "") + current]
        return labels, at % 4


def border_costs(rows: list[tuple[int, int, int]]) -> list[list[float]]:
    """Costs between the states before and after some rows."""
    out = [[INF] * 4 for _ in range(4)]
    for end in range(4):
        segment = Segment(rows, tuple(0 if s == end else INF for s in range(4)))
        for state in range(4):
            out[state][end] = segment.cost_from(state)
    return out


def _border_lattice(costs: list, ends: tuple, origins: Iterable[int]) -> tuple[list[list[float]], list[float]]:
    n = len(costs)
    goal = 4 * n + 4
    arcs: list[list[tuple]] = [[("", c, 4 * (i + 1) + t) for t, c in enumerate(row) if c < INF] for i, m in enumerate(costs) for row in m]
    arcs += [[("", ends[s], goal)] if ends[s] < INF else [] for s in range(4)] + [[]]
    price, rest = [0.0] * (goal + 1), float(min(ends))
    for i in range(n, -1, -1):
        price[4 * i:4 * i + 4] = [rest] * 4
        if i:
            rest += min(map(min, costs[i - 1]))
    live = _reaching(arcs, goal)
    price = [p if i in live else INF for i, p in enumerate(price)]
    for origin in origins:
        auction(arcs, price, origin, goal)
    live = [False] * goal + [True]
    for i in range(goal - 1, -1, -1):  # heads come later than tails here
        live[i] = price[i] < INF and any(live[j] and price[i] == c + price[j] for _, c, j in arcs[i])
    exits = [[price[4 * i + s] if live[4 * i + s] else INF for s in range(4)] for i in range(1, n + 1)]
    return exits, price[:4]


def border_prices(costs: list, ends: tuple, origins: Iterable[int] = (START,)) -> list[list[float]]:
    """For each segment the prices of its last states (infinite where no cheapest
    path from an origin passes), given the costs between borders of all of them."""
    if len(costs) <= BORDERS:
        return _border_lattice(costs, ends, origins)[0]
    blocks = [costs[i:i + BORDERS] for i in range(0, len(costs), BORDERS)]
    joint = [list(zip(*(_border_lattice(b, tuple(0 if s == e else INF for s in range(4)), range(4))[1] for e in range(4)))) for b in blocks]
    outer = border_prices(joint, ends, origins)
    return [p for b, e in zip(blocks, outer) for p in border_prices(b, tuple(e), range(4))]


def audit_of(rows: list[tuple[int, int, int]], labels: list[str]) -> str:
    """All edits in order; inserts after the last row follow its repeats."""
    out = []
    for i, ((_, _, more), label) in enumerate(zip(rows, labels)):
        edit = label.rstrip("I") if i == len(rows) - 1 else label
        out.append(edit + "D" * more + label[len(edit):])
    return "".join(out) if rows else "".join(labels)


def edits_cost(rows: list[tuple[int, int, int]], labels: list[str]) -> int:
    prices = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
    kept_cut = sum(TRUNCATED for (kind, _, _), label in zip(rows, labels) if kind == 1 and "D" not in label)
    return sum(prices[e] for label in labels for e in label) + kept_cut + DELETE * sum(m for _, _, m in rows)


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def illegal_pairs(rows: list[tuple[int, int, int]]) -> int:
    roles = [r for _, r, _ in rows]
    return sum(p not in _LEGAL for p in zip(roles, roles[1:])) + sum(m for _, _, m in rows)


# ---- the job -------------------------------------------------------------------------------

def _space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: conv_id, turn, role, text, copies; by the crc32 of
    ``conv_id:turn`` modulo 20 a row goes, loses its text or its sentence ends,
    comes twice or becomes the user's."""
    key = F.concat(_space("conv_id"), F.lit(":"), _space("turn"))
    how = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _space("role").alias("role"), _space("text").alias("text"), how.alias("_how"))
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("_how <> 0").select(
        "conv_id", "turn", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("_how") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def _coded(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation: conv_id, turn, role, digest, copies, and
    whether they are blank, seen earlier or truncated."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    equal = rows.select(
        "conv_id", "turn", "role", _digest().alias("digest"), "copies", (~F.col("text").rlike(_BLANK)).alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
    ).groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies"))
    equal = written(equal, "repair-rows")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    first = (equal.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
             .where("_n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    return (equal.join(first, same, "left")
            .withColumn("again", F.coalesce(F.col("_first") != order, F.lit(False)) & ~F.col("blank"))
            .withColumn("cut", F.col("cut") & ~F.col("blank") & ~F.col("again"))
            .drop("_c", "_r", "_d", "_first"))


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    letters = F.when(F.col("blank") | F.col("again"), "wxyz").when(F.col("cut"), "SUAO").otherwise("suao")
    more = F.when(F.col("copies") > 1, (F.col("copies") - 1).cast("string")).otherwise("")
    return F.concat(F.substring(letters, place, F.lit(1)), more)


_SEGMENT_SCHEMA = ("conv_id long, seg long, keys array<struct<turn:long,role:string,digest:binary>>, labels array<string>, "
                   "audit string, cost long, illegal long, first int, last int")


def _segments(coded: DataFrame) -> DataFrame:
    """Codes and keys of each segment, and how many its conversation has."""
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("digest")]
    dealt = (coded.select("conv_id", "turn", "role", "digest", _code().alias("code"))
             .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = F.struct("_at", "code", F.struct("turn", "role", "digest").alias("key"))
    segments = (dealt.groupBy("conv_id", F.shiftright("_at", SEGMENT_BITS).alias("seg"))
                .agg(F.sort_array(F.collect_list(rows)).alias("_rows"))  # SEGMENT rows at most
                .select("conv_id", "seg", F.array_join("_rows.code", "").alias("codes"), F.col("_rows.key").alias("keys")))
    segments = written(segments, "repair-segments")
    count = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("segs")).withColumnRenamed("conv_id", "_c")
    return segments.join(count, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")


def _costs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [sum(border_costs(parse(c)), []) for c in batch.column("codes").to_pylist()]
        yield batch.append_column("costs", pa.array(costs, pa.list_(pa.float64())))


def _borders(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each segment of a conversation begins, and the prices of its ends."""
    pdf = pdf.sort_values("seg", ignore_index=True)
    costs = [np.reshape(c, (4, 4)).tolist() for c in pdf["costs"]]
    prices = border_prices(costs, ACCEPT)
    state, starts = START, []
    for codes, ends in zip(pdf["codes"], prices):
        starts.append(state)
        state = Segment(parse(codes), tuple(ends)).trace(state)[1]
    return pd.DataFrame({"conv_id": pdf["conv_id"], "seg": pdf["seg"], "start": np.array(starts, np.int32), "ends": prices})


def _traced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"labels": [], "audit": [], "cost": [], "illegal": [], "first": [], "last": []}
        starts, ends = batch.column("start").to_pylist(), batch.column("ends").to_pylist()
        for codes, start, end in zip(batch.column("codes").to_pylist(), starts, ends):
            rows = parse(codes)
            labels, _ = Segment(rows, tuple(end)).trace(start)
            out["labels"].append(labels)
            out["audit"].append(audit_of(rows, labels))
            out["cost"].append(edits_cost(rows, labels))
            out["illegal"].append(illegal_pairs(rows))
            out["first"].append(rows[0][1])
            out["last"].append(rows[-1][1])
        types = (pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("seg"), batch.column("keys"), *[pa.array(v, t) for v, t in zip(out.values(), types)]],
            ["conv_id", "seg", "keys", *out])


def _hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each repaired conversation from its sorted edits and texts: a
    row's edit comes before its text; equal rows after the first say nothing."""
    names = ("", "system", "user", "assistant")
    done: list[tuple] = []
    conv, digest, lines, state, edit, open_ = None, None, 0, START, None, False

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + role + ":" + text).encode())
        lines += 1

    for pdf in batches:
        for c, role, label, text in zip(pdf["conv_id"], pdf["role"], pdf["label"], pdf["text"]):
            c = None if pd.isna(c) else int(c)
            if not open_ or c != conv:
                if open_:
                    done.append((conv, digest.hexdigest()))
                conv, digest, lines, state, edit, open_ = c, hashlib.sha256(), 0, START, None, True
            if label is not None:
                edit = label
                continue
            if edit is None:
                continue
            for e in edit:
                if e == "K":
                    state = _ROLE_STATES["sua".find(role[:1])] if role[:1] in "sua" else state
                    line(role, text)
                elif e in "RI":
                    state = AFTER[state]
                    line(names[state], text if e == "R" else "")
            edit = None
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "sha"]).astype({"conv_id": "Int64"})
            done = []
    if open_:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv_id", "sha"]).astype({"conv_id": "Int64"})


def repair(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, copies; see ``damaged``) repaired: one
    row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    rows = for_workers(rows).withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    coded = _coded(rows)
    coded = written(coded, "repair-coded")
    segments = written(_segments(coded), "repair-counted")
    several = segments.where("segs > 1").select("conv_id", "seg", "codes")
    border = (several.mapInArrow(_costs, "conv_id long, seg long, codes string, costs array<double>")
              .groupBy("conv_id").applyInPandas(_borders, "conv_id long, seg long, start int, ends array<double>"))
    border = border.select(F.col("conv_id").alias("_c"), F.col("seg").alias("_s"), "start", "ends")
    ready = segments.join(border, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seg") == F.col("_s")), "left").select(
        "conv_id", "seg", "codes", "keys", F.coalesce("start", F.lit(START)).alias("start"),
        F.coalesce("ends", F.array(*[F.lit(float(a)) for a in ACCEPT])).alias("ends"))
    traced = written(ready.mapInArrow(_traced, _SEGMENT_SCHEMA), "repair-traced")

    part = F.array_sort(F.collect_list(F.struct("seg", "audit", "illegal", "first", "last")))  # a value a segment
    audits = (traced.groupBy("conv_id").agg(part.alias("_p"), F.sum("cost").alias("cost"))
              .select("conv_id", F.array_join("_p.audit", "").alias("audit"), "cost", _total_illegal().alias("illegal")))
    per_turn = coded.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("again"), 0).otherwise(1))).alias("duplicate"),
        F.sum(F.col("cut").cast("long")).alias("truncated"))
    counts = per_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"))

    null = F.lit(None).cast("string")
    edits = traced.select("conv_id", F.explode(F.arrays_zip("keys", "labels")).alias("e")).select(
        "conv_id", "e.keys.turn", "e.keys.role", "e.keys.digest", F.col("e.labels").alias("label"), null.alias("text"))
    edits = edits.where(F.col("label") != "D")
    texts = rows.select("conv_id", "turn", "role", _digest().alias("digest"), null.alias("label"), "text")
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("digest"), F.col("label").isNull()]
    # one conversation's texts make one hash, so they pass one task: as a stream, in order
    hashes = (edits.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
              .select("conv_id", "role", "label", "text").mapInPandas(_hashed, "conv_id long, sha string"))

    def right(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("conv_id", "_c")

    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    out = counts.join(right(audits), same).drop("_c").join(right(hashes), same).drop("_c")
    return out.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha").alias("repaired_sha256"))


def _total_illegal() -> Column:
    """Pairs within segments, and those across their borders."""
    p = F.col("_p")
    legal = F.array(*[F.lit(10 * a + b) for a, b in sorted(_LEGAL)])
    borders = F.zip_with(F.slice("_p.last", F.lit(1), F.size(p) - 1), F.slice("_p.first", F.lit(2), F.size(p)),
                         lambda a, b: F.when(F.array_contains(legal, 10 * a + b), 0).otherwise(1).cast("long"))
    add = lambda acc, x: acc + x
    zero = F.lit(0).cast("long")
    return F.aggregate("_p.illegal", zero, add) + F.aggregate(borders, zero, add)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "_c")
    zero = F.lit(0).cast("long")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _best_sql(ways: str) -> str:
    """The least (cost, audit) of each state among some ways."""
    return (f"list_filter(list_transform(range(4), lambda s: list_sort(list_filter({ways}, lambda w: w.state = s))[1]), "
            "lambda w: w IS NOT NULL)")


def _inserted_sql(ways: str) -> str:
    """``ways`` and what one insert makes of them."""
    role = "CASE WHEN w.state = 2 THEN 'assistant:' ELSE 'user:' END"
    more = (f"list_transform({ways}, lambda w: struct_pack(cost := w.cost + 3, audit := w.audit || 'I', "
            f"state := CASE WHEN w.state = 2 THEN 3 ELSE 2 END, text := concat_ws(chr(10), w.text, {role})))")
    return _best_sql(f"list_concat({ways}, {more})")


# One row's edits of one way; a row that may not stay has no state there.
_EDITS_SQL = """flatten(list_transform(ways, lambda w: list_filter([
    struct_pack(cost := w.cost + 4, audit := w.audit || 'D', state := w.state, text := w.text),
    struct_pack(cost := w.cost + cut, audit := w.audit || 'K', state := CASE
        WHEN NOT stays THEN NULL WHEN initial = 's' AND w.state = 0 THEN 1
        WHEN initial = 'u' AND w.state <> 2 THEN 2 WHEN initial = 'a' AND w.state = 2 THEN 3 END,
        text := concat_ws(chr(10), w.text, role || ':' || text)),
    struct_pack(cost := w.cost + 3 + cut, audit := w.audit || 'R', state := CASE WHEN NOT stays THEN NULL WHEN w.state = 2 THEN 3 ELSE 2 END,
        text := concat_ws(chr(10), w.text, CASE WHEN w.state = 2 THEN 'assistant:' ELSE 'user:' END || text))
  ], lambda c: c.state IS NOT NULL)))"""

# The best way to each state, row by row: forward dynamic programming, no lattice and no prices.
OP11_SQL = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT *, {crc32_sql("key")} % 20 AS how FROM source),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, copy,
         CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, LATERAL (SELECT unnest(range(CASE WHEN how = 3 THEN 2 ELSE 1 END)) AS copy) WHERE how <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated'
                 ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
rows AS (
  SELECT conv_id, pos, role, text, left(role, 1) AS initial, fault NOT IN ('blank', 'duplicate') AS stays,
         CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faulty),
start AS (SELECT [struct_pack(cost := 0, audit := '', state := 0, text := NULL::VARCHAR)] AS ways),
start1 AS (SELECT {_inserted_sql("ways")} AS ways FROM start),
start2 AS (SELECT {_inserted_sql("ways")} AS ways FROM start1),
steps AS (
  SELECT conv_id, 0::BIGINT AS pos, ways FROM (SELECT DISTINCT conv_id FROM rows), start2
  UNION ALL
  SELECT conv_id, pos, {_inserted_sql("ways")} AS ways FROM (
    SELECT conv_id, pos, {_inserted_sql("ways")} AS ways FROM (
      SELECT conv_id, pos, {_best_sql("ways")} AS ways FROM (
        SELECT r.conv_id, r.pos, {_EDITS_SQL} AS ways
        FROM steps s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos + 1)))),
ended AS (
  SELECT conv_id, list_sort(list_filter(arg_max(ways, pos), lambda w: w.state IN (0, 3)))[1] AS way FROM steps GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(way.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
