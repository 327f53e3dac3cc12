"""Conversation structure repair by aligning turns to the alternating grammar ``(s?(ua)+)?``.

Faults of a turn, the first that holds: blank (no character but ASCII white space), duplicate (role and text seen earlier in
its conversation), truncated (the last such character is none of ``. ! ?``). Edits: Keep 0, Rerole to user or assistant 2,
Delete 3 (the only one for blank and duplicate turns), Insert an empty user or assistant turn 2; a truncated turn that is not
deleted costs 1 more. The cheapest audit (the edits' initials) makes the roles' initials match the grammar; of equally cheap
ones the least in ASCII order.

1. Equal rows of a conversation are counted, not kept (combined before the shuffle). The first turn of every content that
   stands at several turns is joined back; what comes later is a duplicate. Only live turns (first, not blank) are aligned: forced
   deletions follow the edit of the live turn before them, which is also the least place in ASCII order.
2. Turns are range-sorted by conversation, turn, role and text. A task reads its range as a stream. The live turns of a
   conversation are aligned by Wagner and Fischer's table to each feasible string of the grammar, nearest lengths first;
   the incumbent's cost bounds the lengths still tried and, after Ukkonen, the diagonals of each table. Backtraced audits
   of equal cost are compared.
3. More than ``DIRECT`` live turns are aligned in blocks, for every grammar state before and after a block (after nothing, s,
   u, a), and blocks are joined pairwise by the cheapest state between them; that is exact, as an audit's part in
   a block is the cheapest between its states. Only the first and the last conversation of a range can go on in
   another one: their states' audits are joined over the ranges in a second step. So a conversation of any length is split.
4. Edits are rows; kept turns fetch their text by their place in the range (unique, so no key is hot).

Nulls: a null role or text is read as one space (a space is no role, such a text is blank); null turns come first; a null conv_id
is a conversation of its own. Ties: rows of one turn are ordered by role, then text, in binary order. Repeated rows are adjacent
and all but one are duplicates. An empty role has no initial and is never kept. Texts of any length are only compared and
passed on. Other columns are ignored. Empty tables give empty results. Counts past a bigint are held at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1     # costs of edits; CUT for a truncated turn that stays
DIRECT = 48                                  # live turns of a conversation that are aligned in one table
BLOCK = 8                                    # live turns of a block of a longer conversation
START, SYSTEM, USER, ASSISTANT = range(4)    # what the grammar has read last
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_ROLES = {"u": "user", "a": "assistant"}
_MAX = (1 << 63) - 1
_INF = 1 << 60
_SPACE = r"\x20\x09-\x0D"

Best = tuple[int, str]                       # cost and audit
Joined = dict[tuple[int, int], Best]         # best audit by the states before and after


def targets(state: int, length: int) -> list[str]:
    """The grammar's strings of a length after ``state`` (prefixes of what it allows)."""
    def alternate(first: str, n: int) -> str:
        return ("ua" if first == "u" else "au") * (n // 2) + first * (n % 2)

    if not length:
        return [""]
    if state == START:
        return ["s" + alternate("u", length - 1), alternate("u", length)]
    return [alternate("a" if state == USER else "u", length)]


_CHANGE = {(code, t): (0 if code.lower() == t else REROLE if t != "s" else _INF) + (CUT if code.isupper() else 0)
           for code in "suaxSUAX" for t in "sua"}


def align(codes: str, target: str, limit: int) -> Best | None:
    """Cheapest edits of live turns to ``target`` and, of those, the least audit; None if they cost more than ``limit``.

    ``codes``: s, u, a or x (another role) per turn, upper case if truncated. Cells outside the band of diagonals
    that ``limit`` allows are never filled."""
    n, m = len(codes), len(target)
    extra = m - n
    low, high = -((limit - 2 * extra) // 5), (limit + 3 * extra) // 5     # diagonals whose gaps alone fit the limit
    if (INSERT * extra if extra > 0 else -DELETE * extra) > limit:
        return None
    table = [[_INF] * (m + 2) for _ in range(n + 2)]
    for i in range(n, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            if i == n and j == m:
                row[j] = 0
                continue
            best = below[j] + DELETE if i < n else _INF
            if j < m:
                if target[j] != "s":
                    best = min(best, row[j + 1] + INSERT)
                if i < n:
                    best = min(best, below[j + 1] + _CHANGE[codes[i], target[j]])
            row[j] = best
    cost = table[0][0]
    if cost > limit:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:                       # D < I < K < R: the first edit that keeps the cost
        c = table[i][j]
        if i < n and table[i + 1][j] + DELETE == c:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and table[i][j + 1] + INSERT == c:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if codes[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


@lru_cache(maxsize=1 << 15)
def best_audits(codes: str, state: int) -> dict[int, Best]:
    """The best audit of live turns after ``state``, for every state after them (incumbents, by nearest length)."""
    n, system = len(codes), "s" in codes.lower()
    ends = {START: 3 + system, SYSTEM: 3, USER: 2, ASSISTANT: 2}[state]      # how many states can follow
    found: dict[int, Best] = {}
    far = n + (DELETE * n + 3 * INSERT) // INSERT + 1       # more insertions cost more than deleting all turns
    for m in sorted(range(far), key=lambda m: INSERT * (m - n) if m > n else DELETE * (n - m)):
        if len(found) == ends and (INSERT * (m - n) if m > n else DELETE * (n - m)) > max(c for c, _ in found.values()):
            break
        for target in targets(state, m):
            if target[:1] == "s" and not system:
                continue
            end = _AFTER[target[-1]] if target else state
            incumbent = found.get(end)
            got = align(codes, target, incumbent[0] if incumbent else (DELETE + INSERT) * (n + m))
            if got and (incumbent is None or got < incumbent):
                found[end] = got
    return found


def weave(audit: str, runs: list[int]) -> str:
    """An audit of live turns with the forced deletions: ``runs[0]`` first, ``runs[k]`` after live turn ``k``."""
    if not any(runs):
        return audit
    out, k = ["D" * runs[0]], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            k += 1
            out.append("D" * runs[k])
    return "".join(out)


def join(a: Joined, b: Joined) -> Joined:
    """Two blocks one after the other, by the cheapest state between them."""
    out: Joined = {}
    for (p, mid), (c1, s1) in a.items():
        for q in range(4):
            right = b.get((mid, q))
            if right is None:
                continue
            cost, old = c1 + right[0], out.get((p, q))
            if old is None or cost < old[0] or (cost == old[0] and s1 + right[1] < old[1]):
                out[p, q] = cost, s1 + right[1]
    return out


def joined(codes: str, runs: list[int], states=range(4), direct: int = DIRECT, block: int = BLOCK) -> Joined:
    """The best audits, forced deletions included, between the ``states`` before and all states after the turns."""
    size = len(codes) if len(codes) <= direct else block
    parts = []
    for a in range(0, max(len(codes), 1), max(size, 1)):
        b = min(a + size, len(codes))
        own = [runs[0] if a == 0 else 0, *runs[a + 1:b + 1]]
        forced = DELETE * sum(own)
        before = states if size == len(codes) else range(4)
        parts.append({(p, q): (c + forced, weave(s, own)) for p in before for q, (c, s) in best_audits(codes[a:b], p).items()})
    while len(parts) > 1:                       # in pairs, so audits are copied log times
        parts = [join(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def decide(between: Joined) -> tuple[int, int, str]:
    """State after the whole conversation, cost and audit: nothing is left, or an assistant has the last turn."""
    cost, audit, state = min((*between[START, q], q) for q in (START, ASSISTANT) if (START, q) in between)
    return state, cost, audit


def edits(audit: str, state: int, codes: str, runs: list[int]) -> Iterator[tuple[str, int, str | None]]:
    """``(edit, live turn or -1, role letter of the repaired turn)`` of an audit, forced deletions left out."""
    at, k = runs[0], 0
    while at < len(audit):
        edit = audit[at]
        at += 1
        letter = None
        if edit != "D":
            letter = "s" if edit == "K" and codes[k].lower() == "s" else "a" if state == USER else "u"
            state = _AFTER[letter]
        yield edit, (-1 if edit == "I" else k), letter
        if edit != "I":
            k += 1
            at += runs[k]


class Part:
    """The turns of one conversation in one range."""

    def __init__(self, conv_id: int | None, first_live: int):
        self.conv_id, self.first_live = conv_id, first_live
        self.codes: list[str] = []
        self.runs = [0]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_role = self.last_role = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, initial: str, n: int, blank: bool, live: bool, truncated: bool) -> None:
        if self.first_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in _LEGAL
        self.illegal += n - 1                   # equal initials side by side
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = (turn if self.first_turn is None else self.first_turn), turn
        if live:
            code = initial if initial in _AFTER else "x"
            self.codes.append(code.upper() if truncated else code)
            self.runs.append(0)
            self.truncated += truncated
        rest = n - live
        self.runs[-1] += rest
        if blank:
            self.blank += rest
        else:
            self.duplicate += rest

    def follow(self, other: "Part") -> None:
        """Adds the counts of the same conversation's next range."""
        self.illegal += other.illegal + (self.last_role + other.first_role not in _LEGAL)
        self.last_role = other.last_role
        self.blank, self.duplicate, self.truncated = (self.blank + other.blank, self.duplicate + other.duplicate,
                                                      self.truncated + other.truncated)
        if other.first_turn is not None:
            self.turns += other.turns - (other.first_turn == self.last_turn)
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn

    def summary(self, cost: int, audit: str) -> dict:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"kind": "summary", "conv_id": self.conv_id, "gaps": min(gaps, _MAX), "blank": self.blank,
                "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


_SCHEMA = pa.schema([("kind", pa.string()), ("conv_id", pa.int64()), ("range", pa.int32()), ("live", pa.int64()), ("place", pa.int64()),
                     ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
                     *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()),
                     ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
                     ("first_role", pa.string()), ("last_role", pa.string()), ("codes", pa.string()), ("runs", pa.list_(pa.int64())),
                     ("before", pa.list_(pa.int32())), ("after", pa.list_(pa.int32())),
                     ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_FIELDS = ("kind string, conv_id long, range int, live long, place long, edit string, role string, text string, gaps long, blank long, "
           "duplicate long, truncated long, illegal long, cost long, audit string, first_turn long, last_turn long, turns long, "
           "first_role string, last_role string, codes string, runs array<long>, before array<int>, after array<int>, "
           "costs array<long>, audits array<string>")
FLUSH_ROWS, FLUSH_BYTES = 4096, 4 << 20


class _Out:
    """Rows on their way out, in batches bounded by rows and bytes."""

    def __init__(self):
        self.rows: list[dict] = []
        self.size = 0

    def put(self, row: dict) -> None:
        self.rows.append(row)
        self.size += len(row.get("text") or "") + len(row.get("audit") or "")

    def full(self) -> bool:
        return len(self.rows) >= FLUSH_ROWS or self.size >= FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.size = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _edit_rows(part: Part, number: int, audit: str, state: int) -> Iterator[dict]:
    for place, (edit, k, letter) in enumerate(edits(audit, state, "".join(part.codes), part.runs)):
        yield {"kind": "edit", "conv_id": part.conv_id, "range": number, "place": place, "edit": edit,
               "live": None if k < 0 else part.first_live + k, "role": None if edit in "DK" else _ROLES[letter]}


def _align_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: its live turns, the edits and the summaries of all conversations but the first and the last,
    whose parts are handed on."""
    out, part, is_first, live, number = _Out(), None, True, 0, 0

    def close(part: Part, is_open: bool) -> None:
        codes = "".join(part.codes)
        if is_open:
            between = sorted(joined(codes, part.runs).items())
            out.put({"kind": "open", "conv_id": part.conv_id, "range": number, "live": part.first_live, "codes": codes,
                     "runs": part.runs, **{c: getattr(part, c) for c in (
                         "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", "first_role", "last_role")},
                     "before": [p for (p, _), _ in between], "after": [q for (_, q), _ in between],
                     "costs": [c for _, (c, _) in between], "audits": [s for _, (_, s) in between]})
            return
        _, cost, audit = decide(joined(codes, part.runs, (START,)))
        out.put(part.summary(cost, audit))
        for row in _edit_rows(part, number, audit, START):
            out.put(row)

    for b in batches:
        for conv, turn, role, text, n, blank, is_live, truncated, number in zip(*(c.to_pylist() for c in b.columns)):
            if part is None or conv != part.conv_id:
                if part is not None:
                    close(part, is_first)
                    is_first = False
                part = Part(conv, live)
            part.add(turn, role[:1], n, blank, is_live, truncated)
            if is_live:
                out.put({"kind": "turn", "range": number, "live": live, "role": role, "text": text})
                live += 1
            if out.full():
                yield out.batch()
    if part is not None:
        close(part, True)
    yield out.batch()


def _join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries and edits of the conversations at the edges of ranges, from their parts in order."""
    out, parts = _Out(), []

    def finish() -> None:
        owns, backs, total = [], [], {START: (0, "")}
        for row in parts:                       # best audits so far by state, and the state before this range
            own = {(p, q): (c, s) for p, q, c, s in zip(row["before"], row["after"], row["costs"], row["audits"])}
            new, back = {}, {}
            for (p, q), (c, s) in own.items():
                if p in total and (q not in new or total[p][0] + c <= new[q][0]):
                    option = total[p][0] + c, total[p][1] + s
                    if q not in new or option < new[q]:
                        new[q], back[q] = option, p
            total = new
            owns.append(own)
            backs.append(back)
        state, cost, audit = decide({(START, q): best for q, best in total.items()})
        after = [state]
        for back in reversed(backs[1:]):
            after.insert(0, back[after[0]])
        whole, before = None, START
        for row, own, q in zip(parts, owns, after):
            p = Part(row["conv_id"], row["live"])
            for c in ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "turns", "first_role", "last_role", "runs"):
                setattr(p, c, row[c])
            p.codes = list(row["codes"])
            for r in _edit_rows(p, row["range"], own[before, q][1], before):
                out.put(r)
            before = q
            if whole is None:
                whole = p
            else:
                whole.follow(p)
        out.put(whole.summary(cost, audit))

    for b in batches:
        for row in b.to_pylist():
            if parts and row["conv_id"] != parts[0]["conv_id"]:
                finish()
                parts = []
            parts.append(row)
            if out.full():
                yield out.batch()
    if parts:
        finish()
    yield out.batch()


def _key(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.length(role).cast("string"),
                           F.lit(":"), role, text), 256)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``conv_id, turn, role, text``: a summary of every conversation (``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit``) and the repaired turns (``conv_id, range, place, edit, role, text``; in the order of range, place)."""
    rows = stored(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
                  .groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
                  .withColumn("key", _key(F.col("role"), F.col("text"))), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    again = stored(rows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
                   .select("key", "first"), "first_turns")
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    faults = (rows.join(again, "key", "left")
              .select("conv_id", "turn", "role", "text", "n", blank.alias("blank"),
                      (~blank & (F.col("first").isNull() | (F.col("first") == place))).alias("live"),
                      (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("truncated")))
    conv, turn = F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()
    ranges = (faults.repartitionByRange(conv, turn, "role", F.substring("text", 1, 16))
              .sortWithinPartitions(conv, turn, "role", "text").withColumn("range", F.spark_partition_id()))
    first = stored(ranges.mapInArrow(_align_range, _FIELDS), "aligned")
    edges = (first.where("kind = 'open'").repartition("conv_id").sortWithinPartitions("conv_id", "range")
             .mapInArrow(_join_ranges, _FIELDS))
    found = stored(edges, "edges").unionByName(first)
    kept = first.where("kind = 'turn'").select("range", "live", F.col("role").alias("old_role"), "text")
    changes = found.where("kind = 'edit' and edit <> 'D'").select("conv_id", "range", "place", "edit", "role", "live")
    fixed = (changes.where("edit <> 'I'").join(kept, ["range", "live"])
             .select("conv_id", "range", "place", "edit", F.coalesce("role", "old_role").alias("role"), "text")
             .unionByName(changes.where("edit = 'I'").select("conv_id", "range", "place", "edit", "role", F.lit("").alias("text"))))
    return (found.where("kind = 'summary'").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"),
            fixed)


def digests(fixed: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the repaired turns' ``role:text``, joined by newlines. A digest reads its
    conversation in order, so that one task streams it; nothing is gathered."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for b in batches:
            done = []
            for own, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if digest is None or own != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(schema.types)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "repaired_sha256": [digest.hexdigest()]}, schema)

    return (fixed.repartition("conv_id").sortWithinPartitions("conv_id", "range", "place").select("conv_id", "role", "text")
            .mapInArrow(run, "conv_id long, repaired_sha256 string"))


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32(``conv_id:turn``) mod 20 chooses: 0 drops the row, 1 empties its
    text, 2 removes the text's ``. ! ?``, 3 repeats the row, 4 sets the role to user. Nulls are read as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    kind = F.col("kind")
    return (turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"),
                         (F.crc32(key.cast("binary")) % 20).alias("kind")).where("kind <> 0")
            .select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy")).drop("_copy"))


def with_digests(turns: DataFrame, original: DataFrame) -> DataFrame:
    """The summary and the digest of every conversation of ``original``; zeros, an empty audit and the digest of nothing where
    ``turns`` has none of it or no turn is left."""
    summary, fixed = repair(turns)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = (original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
             .unionByName(summary, allowMissingColumns=True).unionByName(digests(fixed), allowMissingColumns=True))
    return (every.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts),
                                         F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                         F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
