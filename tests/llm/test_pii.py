import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statfold.llm.pii import find_spans, proposals, redact, span_list
from statfold.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, docs

from ..conftest import SF_SMALL


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    """The plain patterns, by kind and start."""
    t, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def found(spark, data):
    got = find_spans(docs(spark, data)).select("doc_id", F.filter("spans", lambda x: x["base"]).alias("b")).collect()
    return sorted(((r.doc_id, [(x.kind, x.start, x.end) for x in r.b]) for r in got), key=str)


CASES = ["a@b.c%d@e.f", "a@b..c x@y", "..@a.b.", "é a.b+c@d-e.f.g, 😀 z@z.z", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.004",
         "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111", "4111111111111111 4111111111111111", "1 2  3--4",
         "+1 (988) 555-2485.", "+12345678 +1-+2 345 678 901", "1.2.3.4 12 ab@c.d", "0.0.0.0a@1.2.3.4",
         "+1" + " " * 50 + "2", "1.2.3", "a@b.c.", "a@b.c-", "-@-.-", "12345678901234567890"]


def test_base_matches_equal_the_plain_patterns(spark):
    data = [*AWKWARD, *[(100 + k, t) for k, t in enumerate(CASES)], (99, " ".join(CASES))]
    assert found(spark, data) == sorted(((i, base(t)) for i, t in data), key=str)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1@.+- 4%()", max_size=40), min_size=30, max_size=60))
def test_any_text(spark, texts):
    data = list(enumerate(texts))
    assert found(spark, data) == sorted(((i, base(t)) for i, t in data), key=str)


def test_long_texts_take_no_square_time_and_overflow_no_stack(spark):
    parts = ["1", "1 ", "a.", "1.", "a", "+1", "a@b.", "@", "1-"]
    proposals(docs(spark, [(k, p * 60_000) for k, p in enumerate(parts)])).filter("base").count()
    data = [(k, p * 700) for k, p in enumerate(parts)]
    assert found(spark, data) == sorted(((i, base(t)) for i, t in data), key=str)


def test_empty_table(spark):
    assert find_spans(docs(spark, [])).count() == 0


def test_trees_add_spans_and_keep_base_ones(spark):
    got = {r.doc_id: r for r in QUERIES["op6_pii_boosted"](spark, SF_SMALL).collect()}
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        r, want = got[d.doc_id], [f"{k}:{a}:{b}" for k, a, b in base(d.text)]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want)
                                                            for k in ("email:", "ip:", "card:", "phone:")]
        listed = r.spans.split(",") if r.spans else []
        assert set(want) <= set(listed)


def test_planted_secrets_and_cards_are_added_and_broken_ones_are_not(spark):
    base_only = [(k, f"mail a{k}@b.org, ip 10.0.{k}.1 or 300.1.{k}.2, call +1 234 567 89{k:02d}") for k in range(80)]
    secrets = [(200 + k, f"use token=ab{k}cd{k}ef9 now") for k in range(40)]
    plain = [(300 + k, f"the secret: {'lettersonly'[k % 4:]} word") for k in range(40)]
    got = {r.doc_id: r.s for r in find_spans(docs(spark, [*base_only, *secrets, *plain]))
           .select("doc_id", span_list(F.col("spans")).alias("s")).collect()}
    assert all("email:" in got[i] and "ip:" in got[i] and "phone:" in got[i] for i, _ in base_only)
    assert all("secret:" in got[i] for i, _ in secrets)
    assert not [i for i, _ in plain if got[i]]


def test_contacts_of_any_length_are_proposed_whole(spark):
    many = "x" * 90 + " [at] " + " [dot] ".join(f"part{k}" for k in range(30))
    deep = "a@" + ".".join(["b"] * 100_000)
    got = proposals(docs(spark, [(1, f"to {many} !"), (2, deep), (3, "a [at] b")])).filter("name = 'contact'")
    assert sorted(map(tuple, got.select("id", "m").collect())) == [(1, many), (2, deep)]


def test_copied_cards_are_found_though_the_base_pattern_joins_them(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881"]
    good = [(k, f"my card {cards[k % 3]} here, ip 10.0.{k}.1") for k in range(60)]
    bad = [(100 + k, f"part 41111111111111{k % 10}{(k + 3) % 10} no") for k in range(60)]
    got = {r.doc_id: r.s for r in find_spans(docs(spark, [*good, *bad, (500, f"{cards[0]} {cards[1]}")]))
           .select("doc_id", span_list(F.col("spans")).alias("s")).collect()}
    assert got[0].startswith("ip:") and "card:8:24" in got[0]
    assert not [i for i in range(100, 160) if got[i] and not luhn(f"41111111111111{(i - 100) % 10}{(i - 97) % 10}")]


def test_redaction(spark):
    df = spark.createDataFrame([("call +1 234 567 890 or a@b.c!",)], "t string").withColumn("s", F.expr(
        "array(named_struct('kind', 'phone', 'start', 5L, 'end', 19L), named_struct('kind', 'number', 'start', 8L, 'end', 19L),"
        " named_struct('kind', 'email', 'start', 23L, 'end', 28L))"))
    assert df.select(redact(F.col("t"), F.col("s"))).first()[0] == "call [phone] or [email]!"


def test_long_secrets_are_proposed_whole(spark):
    long, key = "eyJ0." * 100, "sk-" + "a1B2" * 30
    data = [(1, f"the token={long} ends"), (3, "token=" + "x" * 100_000)]
    got = proposals(docs(spark, data)).filter("name = 'secret'").select("id", "m").collect()
    assert sorted(map(tuple, got)) == [(1, f"token={long}"), (3, data[1][1])]
    marked = [(4, f"key: 1, use {key} here")]
    got = proposals(docs(spark, marked)).filter("name = 'secret'").select("id", "m").collect()
    assert sorted(map(tuple, got)) == [(4, key)]
