import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from statfold.llm.queries import ORACLE, QUERIES
from statfold.llm.repair import (ENDS, SUMMARY, Survivors, damaged, options, repair, segment_moves, summaries)
from tests.llm.helpers import rows

FORM = re.compile(r"(s?(ua)+)?")
COLUMNS = ("conv_id", *SUMMARY, "audit", "repaired_sha256")


def all_edits(row):
    """(cost, letter, role initial or '') of every edit of one row."""
    initial, removed, truncated = row
    extra = 3 if truncated else 0
    yield 4, "D", ""
    if not removed:
        yield extra, "K", initial
        yield 3 + extra, "R", "u"
        yield 3 + extra, "R", "a"


INSERTS = [(3 * n, "I" * n, "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n)]


def exhaustive(data):
    """Least (cost, edits) of all edits whatever, kept if the roles have the form."""
    ways = {("", ""): 0}
    for row in data:
        nxt = {}
        for (audit, roles), cost in ways.items():
            for c1, l1, r1 in INSERTS:
                for c2, l2, r2 in all_edits(row):
                    key, c = (audit + l1 + l2, roles + r1 + r2), cost + c1 + c2
                    nxt[key] = min(c, nxt.get(key, c))
        ways = nxt
    return min((cost + c, audit + letters) for (audit, roles), cost in ways.items() for c, letters, r in INSERTS
               if FORM.fullmatch(roles + r))


def by_table(data):
    """Least (cost, edits) by a table of whole strings for every state."""
    ways = {0: (0, "")}
    for row in data:
        nxt = {}
        for a, b, c, e in options(*row):
            if a in ways:
                way = (ways[a][0] + c, ways[a][1] + e.decode())
                nxt[b] = min(way, nxt.get(b, way))
        ways = nxt
    return min((ways[s][0] + c, ways[s][1] + e.decode()) for s, c, e in ENDS if s in ways)


def viterbi(data):
    s, out = Survivors(), b""
    for row in data:
        out += s.step(options(*row))
    cost, rest = s.finish()
    return cost, (out + rest).decode()


ROW = st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans())


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_cheapest_of_all_edits(data):
    assert viterbi(data) == exhaustive(data)


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=60))
def test_ties_by_whole_strings(data):
    assert viterbi(data) == by_table(data)


@settings(max_examples=100, deadline=None)
@given(st.lists(ROW, max_size=30), st.integers(1, 7))
def test_segments_chain_to_the_whole(data, size):
    s, out = Survivors(), b""
    for k in range(0, len(data), size):
        out += s.step(segment_moves(iter(data[k:k + size])))
    cost, rest = s.finish()
    assert (cost, (out + rest).decode()) == by_table(data)


def test_memory_is_that_of_the_open_edits():
    s, most = Survivors(), 0
    for k in range(20_000):
        s.step(options("ua"[k % 2] if k % 7 else "s", k % 11 == 0, k % 13 == 0))
        most = max(most, s.open_edits())
    assert most < 200
    # rows that all go, after a beginning that leaves several states open
    s, given = Survivors(), b""
    for k in range(200_000):
        given += s.step(options("u", k > 0, False))
        most = max(most, s.open_edits())
    assert most < 200 and given + s.finish()[1] == b"K" + b"D" * 199_999 + b"I"


def plain(data):
    """The contract row by row, from (conv, turn, role, text) after damage."""
    out = []
    for conv in dict.fromkeys(r[0] for r in data):
        own = sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, facts, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\v\f\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
            n[fault] += 1
            facts.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = by_table(facts)
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        lines, left, last = [], iter(own), "a"
        for letter in audit:
            row = next(left) if letter != "I" else ("", 0, "", "")
            if letter == "D":
                continue
            if letter == "K" and row[2][0] == "s":
                lines.append(f"{row[2]}:{row[3]}")
                continue
            last = "u" if last == "a" else "a"
            lines.append(f"{row[2] if letter == 'K' else {'u': 'user', 'a': 'assistant'}[last]}:{row[3]}")
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"],
                    n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                       T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("part", T.StringType()), T.StructField("k1", T.StringType()),
                       T.StructField("fault", T.StringType())])


def frame(spark, data):
    return spark.createDataFrame([(*r, "p", "k", "f") for r in data], SCHEMA).repartition(3)


def talk(conv, n, seed):
    import random
    rnd = random.Random(seed)
    return [(conv, 2 * k, rnd.choice(["user", "assistant", "assistant", "user", "system", "tool"]),
             rnd.choice(["Yes.", "No!", "Half a", f"Text {k}?", f"Cut {k}", " \n"])) for k in range(n)]


DATA = [*talk(1, 40, 1), *talk(2, 23, 2), *talk(None, 9, 3), (4, None, "user", "a."), (4, None, "user", "a."),
        (4, 3, "user", "a."), (4, 3, "assistant", "b?"), (5, 1, "system", "S."), (6, 1, "", "x."), (6, 2, "user", "y."),
        (7, None, "assistant", "z"), (8, 5, "user", "Long. " * 50_000), (8, 5, "user", "Long. " * 50_000),
        (9, 1, "user", "\x0b\x0c"), (9, 2, "user", " "), (10, 1, "us", "ok.")]


@pytest.mark.parametrize("segment_rows", [200_000, 7, 1])
def test_repair_equals_the_contract(spark, segment_rows):
    got = summaries(repair(frame(spark, DATA), segment_rows=segment_rows, together=True))
    assert rows(got, *COLUMNS) == sorted(plain(DATA), key=str)


def test_nulls_and_no_rows(spark):
    data = [(1, 0, None, None), (1, 1, "user", None), (None, None, None, "a.")]
    filled = [(a, b, c or " ", d or " ") for a, b, c, d in data]
    assert rows(summaries(repair(frame(spark, data))), *COLUMNS) == sorted(plain(filled), key=str)
    assert summaries(repair(frame(spark, []))).count() == 0


def test_one_conversation_of_a_third_of_all_rows(spark):
    data = [r for c in range(40) for r in talk(c, 5, c)] + talk(99, 100, 7) + [(99, 300, "user", "Again.")] * 60
    got = repair(frame(spark, data), segment_rows=25, together=True)
    assert rows(summaries(got), *COLUMNS) == sorted(plain(data), key=str)
    spread = repair(frame(spark, data), segment_rows=25)
    assert rows(got, *got.columns) == rows(spread, *got.columns)


def test_damage(spark):
    data = [(c, t, "assistant", f"Well. {t}? Yes!") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    want = []
    for c, t, role, text in data:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role or " ", "" if kind == 1 else text or " ")
        if kind == 2:
            row = (*row[:3], re.sub("[.!?]", "", row[3]))
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    assert rows(damaged(frame(spark, data)), "conv_id", "turn", "role", "text") == sorted(want, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    import duckdb
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    want = duckdb.sql(ORACLE["op12_conversation_repair"])
    got = QUERIES["op12_conversation_repair"](spark, f"/root/testdata/{sf}")
    assert got.columns == want.columns
    assert rows(got, *COLUMNS) == sorted(want.fetchall(), key=str)
