"""Conversation repair against a plain table of all states and edits."""

import hashlib
import random
import re
import zlib

import pytest

from barlake.llm import conversation_repair as C

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain(rows):
    """(cost, audit, repaired) of rows (role, text, must_go, truncated), by whole strings."""
    best = {"": (0, "", ())}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, kept) in list(out.items()):
                to = NEXT[state]
                offer = (cost + 5, audit + "I", kept + (({"u": "user", "a": "assistant"}[to], ""),))
                if to not in out or offer[:2] < out[to][:2]:
                    out[to] = offer
        return out

    for role, text, must_go, truncated in rows:
        after = {}
        for state, (cost, audit, kept) in inserted(best).items():
            offers = [(state, (cost + 2, audit + "D", kept))]
            if not must_go:
                extra, initial = 5 * truncated, role[:1]
                if initial == "s" and state == "" or initial == "u" and state != "u" or initial == "a" and state == "u":
                    offers.append((initial, (cost + extra, audit + "K", kept + ((role, text),))))
                to = NEXT[state]
                offers.append((to, (cost + extra + 1, audit + "R", kept + (({"u": "user", "a": "assistant"}[to], text),))))
            for to, offer in offers:
                if to not in after or offer[:2] < after[to][:2]:
                    after[to] = offer
        best = after
    return min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2]) if rows else (0, "", ())


def brute(table, damaged=True):
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20 if damaged else 9
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        groups[conv] += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else \
                "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, kept = plain(marked)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def rows_of(df):
    rows = df.collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                          r["repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def made_up(n, longest, seed):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "why", "a b c", "", " \n", None, "Who? ", "ünd.", "x" * 5000 + "."]
    table = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = ("user", "assistant")[turn % 2] if rng.random() < .6 else rng.choice(roles)
            table.append((conv or None, rng.choice([turn, turn, turn, turn + 2, None]), role,
                          f"{turn}." if rng.random() < .5 else rng.choice(texts)))
    return table + table[:5]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block,fan", [(4096, 512), (3, 2)])
def test_equals_the_plain_table(spark, block, fan):
    table = made_up(60, 9, 1) + [(7, t % 50, ("user", "assistant")[t % 3 % 2], f"{t % 41}{'.' * (t % 5 > 0)}") for t in range(150)]
    got = rows_of(C.damaged_audits(spark.createDataFrame(table, SCHEMA), block=block, fan=fan))
    assert got == brute(table)


def test_random_symbols_against_whole_strings():
    rng = random.Random(3)
    for _ in range(400):
        row = tuple(rng.randrange(9) for _ in range(rng.randrange(1, 12)))
        made = C.row_edits((*row, C._END), 0, 0)
        marked = [("suax"[(s - 1) // 2] if s else "u", "", s == 0, bool(s and (s - 1) % 2)) for s in row]
        cost, audit, kept = plain(marked)
        assert (sum(m[0] for m in made), "".join(m[1] for m in made)) == (cost, audit)
        assert [r[:1] for r, _ in kept] == list("".join(m[2] for m in made))


def test_repaired_turns_are_legal_and_whole(spark):
    table = made_up(40, 9, 5)
    df = spark.createDataFrame(table, SCHEMA)
    turns = C.repaired_turns(df, block=3, fan=2).orderBy("ord", "place").collect()
    kept = {}
    for t in turns:
        kept.setdefault(t["conv_id"], []).append((t["role"], t["text"]))
    want = brute(table, damaged=False)
    for conv, rows in kept.items():
        assert re.fullmatch("s?(ua)+", "".join(r[0] for r, _ in rows))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest() == want[conv][-1]
    assert set(kept) == {c for c, w in want.items() if w[-1] != hashlib.sha256().hexdigest()}


def test_other_types_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi.", "x", 1), ("a", 2, "assistant", "Yes.", "y", 2), (None, 1, "user", "q?", "z", 3)],
                               "conv_id string, turn int, role string, text string, ckey string, ord long")
    got = {r["conv_id"]: r["audit"] for r in C.audits(df).collect()}
    assert got == {"a": "KK", None: "D"}
    assert C.damaged_audits(df.limit(0).select("conv_id", "turn", "role", "text")).collect() == []


def test_query_on_the_given_table(spark):
    import duckdb

    from barlake.llm.queries import QUERIES

    path = "/root/testdata/sf0.01"
    table = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{path}/conversations.parquet'").fetchall()
    assert rows_of(QUERIES["op11_conversation_repair"](spark, path)) == brute(table)
