"""Conversation repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``, by their initials.

Faults and places are found by Spark on rows that are dealt out by conversation.  A conversation then is a string with a
letter for each row: what its role's initial is and what is wrong with it.  Batches of such strings go to DuckDB, whose
recursive query advances all of them by one row at a time and keeps, for each state of the grammar, the least cost and the
letters of its edits (of equal costs the smaller letters).  Two edits of equal cost are never a prefix of each other, as an
insertion alone would cost more, so what is smaller stays smaller whatever follows.

Strings of more than ``CHUNK`` rows are cut: every chunk is walked from each state it may begin in, at once with all others,
and neighbours are merged in pairs, so a conversation of n rows takes CHUNK steps and log(n / CHUNK) merges.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairfold.llm.common import save

#: Rows of a conversation that one recursion walks.
CHUNK = 256
#: Letters of the strings, and conversations, that DuckDB gets at a time.
BATCH, MOST = 1 << 19, 20_000
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_NEXT = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
_INSERT, _DELETE, _REROLE, _TRUNCATED = 5, 2, 1, 5
#: What texts may have without saying anything.
_SPACE = " \t\n\x0b\x0c\r"


def edits() -> list[tuple[str, str, str, int, str]]:
    """(state, letter, next state, cost, edits): what may be done about a row, with turns inserted before it.

    Letters of rows: s, u, a by the role's initial, o for other ones; upper case if truncated; x if it has to go.
    """
    gaps, before = [(q, q, 0, "") for q in "ESUA"], 0
    while before < len(gaps):  # at most two insertions: a third would lead back
        p, q, cost, done = gaps[before]
        before += 1
        gaps += [(p, _NEXT[q, r], cost + _INSERT, done + "I") for r in "ua" if (q, r) in _NEXT and len(done) < 2]
    out = []
    for p, q, cost, done in gaps:
        for letter in "suaoSUAOx":
            out.append((p, letter, q, cost + _DELETE, done + "D"))
            if letter == "x":
                continue
            more = _TRUNCATED if letter.isupper() else 0
            if (q, letter.lower()) in _NEXT:
                out.append((p, letter, _NEXT[q, letter.lower()], cost + more, done + "K"))
            out += [(p, letter, _NEXT[q, r], cost + more + _REROLE, done + "R") for r in "ua" if (q, r) in _NEXT]
        out.append((p, "$", q, cost, done))  # the end
    return out


_WALK = """
    WITH RECURSIVE walk(conv, chunk, origin, state, step, cost, done, letters) USING KEY (conv, chunk, origin, state) AS (
        SELECT conv, chunk, origin, origin, 0, 0::BIGINT, '', letters FROM chunks, (VALUES ('E'), ('S'), ('U'), ('A')) o(origin) WHERE chunk > 0 OR origin = 'E'
        UNION
        SELECT conv, chunk, origin, next, step + 1, best.cost, best.done, letters FROM (
            SELECT w.conv, w.chunk, w.origin, e.next, w.step, min({'cost': w.cost + e.cost, 'done': w.done || e.done}) AS best, any_value(w.letters) AS letters
            FROM walk w JOIN edits e ON e.state = w.state AND e.letter = w.letters[w.step + 1]
            WHERE w.step < length(w.letters) GROUP BY 1, 2, 3, 4, 5
        )
    )
    SELECT conv, chunk, origin, state, cost, done FROM walk WHERE step = length(letters)
"""
_MERGE = """
    SELECT l.conv, l.chunk // 2 AS chunk, l.origin, coalesce(r.state, l.state) AS state,
        min({'cost': l.cost + coalesce(r.cost, 0), 'done': l.done || coalesce(r.done, '')}) AS best
    FROM walked l LEFT JOIN walked r ON r.conv = l.conv AND r.chunk = l.chunk + 1 AND r.origin = l.state
    WHERE l.chunk % 2 = 0 GROUP BY 1, 2, 3, 4
"""


def cheapest(letters: list[str]) -> list[tuple[int, str]]:
    """Cost and edits of each string of row letters."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    try:
        rules = pa.table(dict(zip(("state", "letter", "next", "cost", "done"), zip(*edits(), strict=True), strict=True)))
        cuts = [(i, k, s[a : a + CHUNK]) for i, s in enumerate(f"{s}$" for s in letters) for k, a in enumerate(range(0, len(s), CHUNK))]
        conv, chunk, part = zip(*cuts, strict=True)
        con.register("rules", rules)
        con.register("cuts", pa.table({"conv": pa.array(conv, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "letters": pa.array(part, pa.string())}))
        con.execute("CREATE TABLE edits AS SELECT * FROM rules")
        con.execute("CREATE TABLE chunks AS SELECT * FROM cuts")
        con.execute(f"CREATE TABLE walked AS {_WALK}")
        most = max(chunk) + 1
        while most > 1:
            con.execute(f"CREATE TABLE merged AS SELECT conv, chunk, origin, state, best.cost AS cost, best.done AS done FROM ({_MERGE})")
            con.execute("DROP TABLE walked")
            con.execute("ALTER TABLE merged RENAME TO walked")
            most = -(-most // 2)
        best = con.execute("SELECT conv, min({'cost': cost, 'done': done}) AS best FROM walked WHERE origin = 'E' AND state IN ('E', 'A') GROUP BY 1 ORDER BY 1").fetchall()
        return [(b["cost"], b["done"]) for _, b in best]
    finally:
        con.close()


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), with a space for a null role or text."""
    space = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


PLAN = "conv_id long, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan_repairs(conversations: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit).

    Rows count by turn (nulls first), then role, then text; a null role or text is one space, and a null conv_id is a
    conversation of its own.  The first fault of a row counts: ``blank`` (nothing but ASCII white space), ``duplicate`` (an
    earlier row has its role and text), ``truncated`` (its last character that is no white space isn't one of .!?).
    ``gaps`` is how many numbers between the least and the largest turn are missing, ``illegal`` how many neighbours have
    initials of roles other than su, ua, au.

    Edits: K keep (0), R give the role user or assistant (1), D delete (2; blank and duplicate rows must be), I insert an empty
    turn (5); a truncated row that is kept costs 5.  ``audit`` has the letters of the cheapest ones in order, of several the
    smallest in ASCII.  An empty table gives no rows; other columns are not read.

    A conversation's rows meet in one task, sorted by Spark, which spills; what is held there is a letter for each row.
    """
    turns = _turns(conversations).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    fault = F.when(last == "", "blank").when(again, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    known = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("own")).otherwise(F.col("own"))
    judged = turns.withColumn("fault", fault).withColumn("own", known).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    slim = judged.select("conv_id", "turn", "own", "fault", letter.alias("letter"))

    def run(batches):
        done: list[tuple] = []
        size, own = 0, None  # own: conv_id, letters, initials, counts of faults, least, largest and number of distinct turns

        def close():
            conv, letters, initials, faults, low, high, distinct = own
            gaps = high - low + 1 - distinct if distinct else 0
            wrong = sum(initials[i : i + 2] not in (b"su", b"ua", b"au") for i in range(len(initials) - 1))
            done.append((conv, len(initials), gaps, faults.get("blank", 0), faults.get("duplicate", 0), faults.get("truncated", 0), wrong, "".join(letters)))

        def flush():
            nonlocal done, size
            found = cheapest([d[-1] for d in done])
            rows = [(*d[:-1], *f) for d, f in zip(done, found, strict=True)]
            done, size = [], 0
            kinds = [pa.int64()] * 8 + [pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PLAN.split(", ")])

        for b in batches:
            for conv, turn, initial, fault, one in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "own", "fault", "letter")), strict=True):
                if own is None or own[0] != conv:
                    if own is not None:
                        close()
                        if size >= BATCH or len(done) >= MOST:
                            yield flush()
                    own = [conv, [], bytearray(), {}, None, None, 0]
                own[1].append(one)
                own[2] += initial.encode()
                size += 1
                if fault:
                    own[3][fault] = own[3].get(fault, 0) + 1
                if turn is not None and turn != own[5]:
                    own[4], own[5], own[6] = turn if own[4] is None else own[4], turn, own[6] + 1
        if own is not None:
            close()
            own = None
            yield flush()

    return slim.mapInArrow(run, PLAN)


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of each conversation that its plan leaves, numbered from 0.

    Inserted turns have an empty text.  A task passes over its conversations row by row and holds no more than a plan, so
    the length of a conversation is bounded by its plan's letters alone.  Rows of a conversation come together and in order.
    """
    letters = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = letters.unionByName(_turns(conversations).withColumn("kind", F.lit(1)))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        audit, at, place, odd, out = "", 0, 0, 0, []

        def put(conv, role, text, edit):
            nonlocal place
            want = "s" if odd and not place else "ua"[(place - odd) % 2]
            out.append((conv, place, role if edit == "K" else {"u": "user", "a": "assistant"}[want], text, edit))
            place += 1

        def inserted(conv):
            nonlocal at
            while audit[at : at + 1] == "I":
                put(conv, "", "", "I")
                at += 1

        for b in batches:
            for conv, kind, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True):
                if kind == 0:
                    audit, at, place = text, 0, 0
                    odd = (len(audit) - audit.count("D")) % 2  # only a system turn makes it odd
                    inserted(conv)
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(conv, role, text, edit)
                inserted(conv)
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)
                out = []

    return ordered.select("conv_id", "kind", "role", "text").mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "place", "role", "text", "edit"])


def turn_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what ``repaired_turns`` gives: the digest of ``role:text`` of its turns, a line feed between.

    Conversations without turns have no row.  Texts pass one by one and are never put together.
    """

    def run(batches):
        digest, own, begun, out = hashlib.sha256(), None, False, []
        for b in batches:
            for conv, place, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
                if place == 0:
                    if begun:
                        out.append((own, digest.hexdigest()))
                    digest, own, begun = hashlib.sha256(), conv, True
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if out:
                yield _digests(out)
                out = []
        if begun:
            yield _digests([(own, digest.hexdigest())])

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b)], ["conv_id", "repaired_sha256"])


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by ``crc32(conv_id:turn) % 20``; nulls are one space in all but numbers.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user.
    """
    turns, space = _turns(conversations), F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.withColumn("kind", kind).where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation, and of those of ``ids`` that have no rows.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); without rows: zeros, no edits and the
    digest of nothing.
    """
    plans = save(plan_repairs(conversations), "repairs")
    digests = turn_digests(repaired_turns(conversations, plans)).withColumnRenamed("conv_id", "other")
    known = (ids if ids is not None else plans).select(F.col("conv_id").cast("long").alias("id")).distinct()
    rows = known.join(plans, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(digests, F.col("id").eqNullSafe(F.col("other")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
