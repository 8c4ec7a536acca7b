"""Repair of conversation structure: the cheapest edits that turn the role initials
of a conversation into ``(s?(ua)+)?``, found by Hirschberg's divide and conquer.

Edits of a row: K keeps it (0), R gives it the role user or assistant (1), D deletes
it (2); I inserts an empty user or assistant turn anywhere (5).  Blank rows and
repeats of an earlier row must go; a truncated row that stays costs 5 more.

The pattern has four states (nothing yet, after system, after user, after
assistant).  A row is a small matrix: the cheapest cost of getting from state to
state over it, and the order of the edits that do so.  To place the edits of rows
lo..hi between two known states, the cost vector of the first half is built forward,
that of the second half backward; of the states where both meet at the least total
the one with the ASCII-least edits is the crossing, and both halves are solved alike.
Vectors of four entries are all that is held beside the rows.  Edits of one start
state that cover the same rows are never prefixes of each other, and equal edits end
in the same state, so a rank beside each cost is enough to compare them.

No task holds a conversation.  Rows without their texts are put in order by a range
partition, numbered, and cut into blocks.  A conversation inside one block is solved
there.  Of one that crosses blocks, each block yields one matrix; matrices are
composed up a tree, crossings are chosen down the same tree, and then each block
solves its own rows between its two states.

Null roles and texts are read as one space; null conversation ids form one
conversation; null turns come first.  Rows of equal turn are ordered by role and the
SHA-256 of the text.  Equal rows are held once with a count: all but the first are
repeats.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import written

#: Costs of the edits, and of a truncated row that stays.
RETITLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block, and matrices composed at a time further up.
BLOCK = 4096
FAN = 512

ROLES = {"u": "user", "a": "assistant"}
#: State after an inserted turn, and the state after a kept role from each state.
_NEXT = (2, 2, 3, 2)
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_LETTER = " sua"
_FAR = 1 << 60
#: Symbols of rows: 0 must go, else 1 + 2 * (initial's place here) + (truncated).
_INITIALS = "suax"
_END = 9

_WORD = "[^\\x20\\x09-\\x0D]"


def _moves(symbol: int) -> list[dict[int, tuple[int, str]]]:
    """From each state: {state after the row: (cost, edits)}, the least of each."""
    out: list[dict[int, tuple[int, str]]] = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}

        def offer(to: int | None, cost: int, edits: str) -> None:
            if to is not None and (to not in best or (cost, edits) < best[to]):
                best[to] = (cost, edits)

        at = state
        for inserted in range(3):
            cost, edits = INSERT * inserted, "I" * inserted
            if symbol == _END:
                offer(0 if at in (0, 3) else None, cost, edits)
            else:
                offer(at, cost + DELETE, edits + "D")
                if symbol:
                    initial, cut = _INITIALS[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
                    offer(_KEEP.get(initial, (None,) * 4)[at], cost + cut, edits + "K")
                    offer(_NEXT[at], cost + cut + RETITLE, edits + "R")
            at = _NEXT[at]
        out.append(best)
    return out


MOVES = [_moves(symbol) for symbol in range(10)]

#: (16 costs from state p to q at 4p + q, 16 ranks of their edits among those from p)
Matrix = tuple[tuple[int, ...], tuple[int, ...]]


def _matrix(moves: list[dict[int, tuple[int, str]]]) -> Matrix:
    cost, rank = [_FAR] * 16, [0] * 16
    for p, best in enumerate(moves):
        for place, q in enumerate(sorted(best, key=lambda to: best[to][1])):
            cost[4 * p + q], rank[4 * p + q] = best[q][0], place
    return tuple(cost), tuple(rank)


MATRICES = [_matrix(moves) for moves in MOVES]


def forward(items: list[Matrix], lo: int, hi: int, p: int) -> tuple[list[int], list[int]]:
    """Costs from state ``p`` over items lo..hi to each state, and the ranks of the
    least edits that reach them."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[p] = 0
    for i in range(lo, hi):
        step, order = items[i]
        best = [(_FAR, 0, 0)] * 4
        for a in range(4):
            have = cost[a]
            if have < _FAR:
                for b in range(4):
                    more = step[4 * a + b]
                    if more < _FAR:
                        offer = (have + more, rank[a], order[4 * a + b])
                        if offer < best[b]:
                            best[b] = offer
        cost = [c for c, _, _ in best]
        places = {key: place for place, key in enumerate(sorted({key[1:] for key in best if key[0] < _FAR}))}
        rank = [places.get(key[1:], 0) for key in best]
    return cost, rank


def backward(items: list[Matrix], lo: int, hi: int, q: int) -> list[int]:
    """Costs from each state over items lo..hi to state ``q``."""
    cost = [_FAR] * 4
    cost[q] = 0
    for i in range(hi - 1, lo - 1, -1):
        step = items[i][0]
        cost = [min(step[4 * a + b] + cost[b] for b in range(4)) for a in range(4)]
        cost = [min(c, _FAR) for c in cost]
    return cost


def crossings(items: list[Matrix], p: int, q: int) -> list[int]:
    """The states before, between and after the items on the least path from p to q."""
    states = [p] * (len(items) + 1)
    states[-1] = q
    todo = [(0, len(items))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead, rank = forward(items, lo, mid, states[lo])
        back = backward(items, mid, hi, states[hi])
        states[mid] = min((ahead[s] + back[s], rank[s], s) for s in range(4) if ahead[s] < _FAR and back[s] < _FAR)[2]
        todo += [(lo, mid), (mid, hi)]
    return states


def compose(items: list[Matrix]) -> Matrix:
    """One matrix for a run of items."""
    parts = [forward(items, 0, len(items), p) for p in range(4)]
    return tuple(c for cost, _ in parts for c in cost), tuple(r for _, rank in parts for r in rank)


def row_edits(symbols: tuple[int, ...], p: int, q: int) -> list[tuple[int, str, str]]:
    """(cost, edits, role initials that the edits give) of each symbol from p to q."""
    states = crossings([MATRICES[s] for s in symbols], p, q)
    out = []
    for symbol, a, b in zip(symbols, states, states[1:]):
        cost, edits = MOVES[symbol][a][b]
        given, at = "", a
        for _ in range(edits.count("I")):
            at = _NEXT[at]
            given += _LETTER[at]
        out.append((cost, edits, given + ("" if not edits or edits[-1] in "DI" else _LETTER[b])))
    return out


@functools.lru_cache(maxsize=1 << 14)
def _short_edits(symbols: tuple[int, ...]) -> list[tuple[int, str, str]]:
    return row_edits(symbols, 0, 0)


def _runs(keys: list) -> list[tuple[int, int]]:
    starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return [(lo, hi) for lo, hi in zip(starts, starts[1:]) if hi > lo]


def _flags(table) -> tuple[bool, bool]:
    return bool(table.column("left")[0].as_py()), bool(table.column("right")[0].as_py())


_PIECE = "ckey string, node long, opens boolean, closes boolean, cost array<long>, rank array<long>"


def _piece_rows(rows: list[tuple]):
    import pyarrow as pa

    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["ckey", "node", "opens", "closes", "cost", "rank"]
    return pa.table([pa.array([row[i] for row in rows], t) for i, t in enumerate(types)], names)


def _block_pieces(table):
    """The matrices of the conversations that a block shares with its neighbours."""
    table = table.sort_by("ord")
    left, right = _flags(table)
    keys, symbols, node = table.column("ckey").to_pylist(), table.column("symbol").to_pylist(), table.column("block")[0].as_py()
    out = []
    for lo, hi in _runs(keys):
        opens, closes = not (left and lo == 0), not (right and hi == len(keys))
        if not (opens and closes):
            items = [MATRICES[s] for s in symbols[lo:hi]] + ([MATRICES[_END]] if closes else [])
            out.append((keys[lo], node, opens, closes, *compose(items)))
    return _piece_rows(out)


def _grouped_pieces(table):
    table = table.sort_by([("ckey", "ascending"), ("node", "ascending")])
    rows = table.to_pylist()
    for lo, hi in _runs([row["ckey"] for row in rows]):
        part = rows[lo:hi]
        yield part, [(row["cost"], row["rank"]) for row in part]


def _composed(table, fan: int):
    """One matrix for each conversation that goes on beyond a group of nodes."""
    out = []
    for part, items in _grouped_pieces(table):
        opens, closes = any(row["opens"] for row in part), any(row["closes"] for row in part)
        if not (opens and closes):
            out.append((part[0]["ckey"], part[0]["node"] // fan, opens, closes, *compose(items)))
    return _piece_rows(out)


_SPAN = "ckey string, node long, p int, q int"


def _crossed(table):
    """The states at both ends of each node of a group, from those of the group."""
    import pyarrow as pa

    out = []
    for part, items in _grouped_pieces(table):
        p, q = part[0]["p"], part[0]["q"]
        states = crossings(items, p or 0, q or 0)
        out += [(row["ckey"], row["node"], a, b) for row, a, b in zip(part, states, states[1:])]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32()]
    return pa.table([pa.array([row[i] for row in out], t) for i, t in enumerate(types)], ["ckey", "node", "p", "q"])


def _spans(pieces: DataFrame, nodes: int, fan: int) -> DataFrame:
    """(ckey, node, p, q): the states between which each piece lies on the least path."""
    levels = [pieces]
    while nodes > fan:
        def composed(table):
            return _composed(table, fan)

        up = levels[-1].withColumn("parent", F.expr(f"node div {fan}")).groupBy("parent").applyInArrow(composed, _PIECE)
        levels.append(written(up, "pieces"))
        nodes = -(-nodes // fan)
    known = None
    for level in reversed(levels):
        rows = level.withColumn("parent", F.expr(f"node div {fan}"))
        if known is None:
            rows = rows.withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
        else:
            rows = rows.join(known.withColumnRenamed("node", "parent"), ["ckey", "parent"], "left")
        known = written(rows.groupBy("parent").applyInArrow(_crossed, _SPAN), "spans")
    return known


def _edited(table):
    """The edits of a block's rows."""
    import pyarrow as pa

    table = table.sort_by("ord")
    left, right = _flags(table)
    keys, symbols = table.column("ckey").to_pylist(), table.column("symbol").to_pylist()
    ps, qs, copies = (table.column(name).to_pylist() for name in ("p", "q", "copies"))
    cost, edits, given = [], [], []
    for lo, hi in _runs(keys):
        opens, closes = not (left and lo == 0), not (right and hi == len(keys))
        row = tuple(symbols[lo:hi]) + ((_END,) if closes else ())
        if opens and closes:
            made = _short_edits(row) if len(row) <= 64 else row_edits(row, 0, 0)
        else:
            made = row_edits(row, ps[lo], qs[lo])
        for c, e, g in made[:hi - lo]:
            cost.append(c)
            edits.append(e)
            given.append(g)
        if closes:
            cost[-1] += made[-1][0]
            edits[-1] += made[-1][1]
            given[-1] += made[-1][2]
    cost = [c + DELETE * (n - 1) for c, n in zip(cost, copies)]
    keep = table.select(["rid", "ckey", "ord", "turn", "role", "initial", "copies", "fault"])
    return keep.append_column("cost", pa.array(cost, pa.int64())).append_column("edits", pa.array(edits, pa.string())) \
        .append_column("given", pa.array(given, pa.string()))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``ord``: the place of each row in the order of conversation, turn, role and text."""
    order = [F.col("ckey"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "pos", F.monotonically_increasing_id()), "turns")
    part, place = F.shiftright("pos", 33), F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of the written table
    sizes = placed.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("size")).collect()
    start, starts = 0, []
    for row in sorted(sizes, key=lambda r: r["part"]):
        starts.append((row["part"], start))
        start += row["size"]
    base = F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, base long"))
    return placed.withColumn("part", part).join(base, "part").withColumn("ord", F.col("base") + place).drop("part", "base", "pos")


def turn_edits(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The edits of each distinct row, and the rows themselves by ``rid``."""
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    texts = df.select(F.col(conv).alias("conv"), key.alias("ckey"), F.col(turn).alias("turn"),
                      F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    shown = F.coalesce(F.concat(F.lit("="), F.col("turn").cast("string")), F.lit(""))
    texts = texts.withColumn("rid", F.unhex(F.sha2(F.concat_ws(
        "\0", F.length("ckey"), F.length(shown), F.length("role"), "ckey", shown, "role", "text"), 256)))
    last = F.regexp_extract("text", f"({_WORD})[\\x20\\x09-\\x0D]*+\\z", 1)
    rows = texts.select("rid", "ckey", "turn", "role", F.unhex(F.sha2("text", 256)).alias("said"), last.alias("last")) \
        .groupBy("rid", "ckey", "turn", "role", "said", "last").agg(F.count("*").alias("copies"))
    rows = _numbered(rows)
    first = rows.groupBy("ckey", "role", "said").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate") \
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    steps = written(rows.join(first, "ord", "left").withColumn("fault", fault).select(
        "rid", "ckey", "ord", "turn", "role", initial.alias("initial"), "copies", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(
            1 + 2 * place + F.coalesce((F.col("fault") == "truncated").cast("int"), F.lit(0))).alias("symbol"),
        F.expr(f"ord div {block}").alias("block")), "steps")

    # blocks whose first row goes on with the conversation of the row before
    heads = steps.filter(f"ord % {block} = 0").select("block", "ckey")
    tails = steps.filter(f"ord % {block} = {block - 1}").select((F.col("block") + 1).alias("block"), "ckey")
    shared = written(heads.join(tails, ["block", "ckey"]).select("block"), "shared")
    sides = shared.select("block", F.lit(True).alias("left")).join(
        shared.select((F.col("block") - 1).alias("block"), F.lit(True).alias("right")), "block", "full")
    steps = steps.join(sides, "block", "left").fillna(False, ["left", "right"])
    nodes = (steps.agg(F.max("block")).first()[0] or 0) + 1
    crossing = steps.filter(F.col("left") | F.col("right"))
    spans = _spans(written(crossing.groupBy("block").applyInArrow(_block_pieces, _PIECE), "pieces"), nodes, fan)
    steps = steps.join(spans.withColumnRenamed("node", "block"), ["ckey", "block"], "left")
    schema = f"rid binary, ckey string, ord long, turn {dict(texts.dtypes)['turn']}, role string, initial string, " \
        "copies long, fault string, cost long, edits string, given string"
    return steps.groupBy("block").applyInArrow(_edited, schema), texts


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """A row per distinct input row: conversation, ord (order in the whole table), turn,
    role and text as read, copies, fault (of the first copy), cost, edits (letters, the
    inserts before a row first, those that end a conversation on its last row) and
    given (the role initials they put in place).  Copies after the first are deleted."""
    edits, texts = turn_edits(df, conv, turn, role, text, block, fan)
    stay = edits.select("rid", "ckey", "ord", "turn", "role", "initial", "copies", "fault", "cost", "edits", "given")
    return stay.join(texts.dropDuplicates(["rid"]).select("rid", "conv", "text"), "rid").drop("rid")


def _records(edits: str, given: str, role: str, text: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a row's edits leave."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            continue
        if edit == "I":
            out.append((ROLES[given[at]], ""))
        else:
            out.append((role if edit == "K" else ROLES[given[at]], text))
        at += 1
    return out


def repaired_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The repaired conversations, a row per turn: conversation, ord, place (of the turn
    among those of its input row), edit, role, text."""
    rows = repair(df, conv, turn, role, text, block, fan)
    made = F.regexp_replace("edits", "D", "")
    one = F.transform(F.sequence(F.lit(1), F.length(made)), lambda i: F.struct(
        i.alias("place"), F.substring(made, i, F.lit(1)).alias("edit"),
        F.when(F.substring(made, i, F.lit(1)) == "K", F.col("role")).when(
            F.substring("given", i, F.lit(1)) == "u", "user").otherwise("assistant").alias("role"),
        F.when(F.substring(made, i, F.lit(1)) == "I", "").otherwise(F.col("text")).alias("text")))
    return rows.filter(F.length(made) > 0).select(F.col("conv").alias(conv), "ord", F.explode(one).alias("turn_")) \
        .select(conv, "ord", "turn_.*")


_LEGAL = {"su", "ua", "au"}
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _folded(batches, conv: str):
    """Sorted rows to one row per conversation; holds one conversation's counts,
    running hash and audit."""
    import pyarrow as pa

    made: list[tuple] = []
    at = None

    def close():
        if at is not None:
            spread = at["max"] - at["min"] + 1 - at["turns"] if at["turns"] else 0
            made.append((at["conv"], spread, at["blank"], at["duplicate"], at["truncated"], at["illegal"], at["cost"],
                         "".join(at["audit"]), at["hash"].hexdigest()))

    def flush(conv_type):
        types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        names = [conv, *_COUNTS, "audit", "repaired_sha256"]
        batch = pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names)
        made.clear()
        return batch

    conv_type = None
    for batch in batches:
        conv_type = batch.schema.field("conv").type
        cols = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for i, key in enumerate(cols["ckey"]):
            if at is None or at["key"] != key:
                close()
                at = {"key": key, "conv": cols["conv"][i], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                      "cost": 0, "turns": 0, "min": 0, "max": 0, "last": None, "audit": [], "hash": hashlib.sha256(),
                      "begun": False}
            n, fault, turn, initial = cols["copies"][i], cols["fault"][i], cols["turn"][i], cols["initial"][i]
            if fault == "blank":
                at["blank"] += n
            else:
                at["duplicate"] += n if fault == "duplicate" else n - 1
                at["truncated"] += fault == "truncated"
            if turn is not None and (not at["turns"] or turn != at["max"]):
                at["min"] = at["min"] if at["turns"] else turn
                at["max"] = turn
                at["turns"] += 1
            at["illegal"] += n - 1 + (at["last"] is not None and at["last"] + initial not in _LEGAL)
            at["last"] = initial
            at["cost"] += cols["cost"][i]
            edits = cols["edits"][i]
            whole = len(edits.rstrip("I")) if edits[-1:] == "I" else len(edits)
            at["audit"].append(edits[:whole] + "D" * (n - 1) + edits[whole:])
            for name, text in _records(edits, cols["given"][i], cols["role"][i], cols["text"][i]):
                at["hash"].update((("\n" if at["begun"] else "") + name + ":" + text).encode())
                at["begun"] = True
        if len(made) > 2000:
            yield flush(conv_type)
    close()
    if made:
        yield flush(conv_type)


def audits(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Per conversation: gaps, faults, cost, audit and the hash of the repaired turns.
    A hash runs over its conversation in order, so a partition streams its sorted rows."""
    rows = repair(df, conv, turn, role, text, block, fan)
    kind = dict(rows.dtypes)["conv"]
    schema = f"`{conv}` {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return rows.repartition("ckey").sortWithinPartitions("ckey", "ord") \
        .mapInArrow(functools.partial(_folded, conv=conv), schema)


def damage(df: DataFrame) -> DataFrame:
    """Damaged conversations by a hash of id and turn: a twentieth of the rows each is
    dropped, emptied, stripped of its sentence ends, repeated or given to the user."""
    rows = df.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("hit", F.pmod(F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")), F.lit(20)))
    return rows.filter("hit <> 0").withColumn("copy", F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1)))
                                                                .otherwise(F.array(F.lit(0))))).select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"))


def damaged_audits(df: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The audit of every original conversation after ``damage``; one without rows left
    has zeros, no edits and the hash of nothing."""
    done = audits(damage(df), block=block, fan=fan)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    left = F.max(F.pmod(F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")), F.lit(20)) != 0)
    gone = df.groupBy("conv_id").agg(left.alias("left")).filter("not left")
    return done.unionByName(gone.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in _COUNTS], F.lit("").alias("audit"),
                                        F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256")))
