import hashlib

import duckdb
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from statfold.llm.blocknames import drop_exact_copies, exact_dedup, exact_names
from statfold.llm.queries import EXACT_SQL
from tests.llm.helpers import AWKWARD, docs, rows


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(data):
    out = []
    for i, t in data:
        same = [j for j, u in data if lower(u) == lower(t)]
        known = [j for j in same if j is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_awkward_rows(spark):
    data = [*AWKWARD, (9, "Ab" * 5000), (10, "aB" * 5000), (11, "ab" * 4999 + "ac"), (12, "É"), (13, "é"), (14, "X")]
    assert rows(exact_dedup(docs(spark, data), block_chars=16), *COLS) == brute(data)


def test_empty_table(spark):
    assert exact_dedup(docs(spark, [])).count() == 0
    assert drop_exact_copies(docs(spark, [])).count() == 0


def test_names_do_not_depend_on_partitions(spark):
    data = [(k, "abc" * (k % 7) + "d" * (k % 3)) for k in range(60)]
    got = [rows(exact_names(docs(spark, data, parts=p), block_chars=2)[1], "id", "identity") for p in (1, 5)]
    assert got[0] == got[1]


def test_drop_keeps_columns_and_one_row(spark):
    data = [(1, "Same"), (2, "same"), (3, "other"), (3, "other"), (None, "same")]
    left = drop_exact_copies(docs(spark, data))
    assert left.columns == docs(spark, data).columns
    assert rows(left, "doc_id", "text") == [(2, "same"), (3, "other")]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAbé ", max_size=9), max_size=12))
def test_any_texts(spark, texts):
    data = list(enumerate(texts))
    assert rows(exact_dedup(docs(spark, data), block_chars=2), *COLS) == brute(data)


def test_sql_agrees_with_brute_force():
    documents = pd.DataFrame({"doc_id": [1, 2, 3, 4], "text": ["A b", "a B", None, ""]})  # noqa: F841
    got = duckdb.sql(EXACT_SQL).fetchall()
    assert sorted(got, key=str) == brute([(1, "A b"), (2, "a B"), (3, None), (4, "")])


def test_pieces_of_any_length(spark):
    from pyspark.sql import functions as F

    from statfold.llm.common import cut_pieces
    texts = ["", "a", "aé😀" * 5, "x" * 48, "xyz" * 300, "0123456789" * 5_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in df.select(cut_pieces(F.col("t"), 3)).collect()]
    assert got == [[t[k:k + 3] for k in range(0, max(len(t), 1), 3)] for t in texts]


def test_time_grows_with_the_text(spark):
    import time

    from pyspark.sql import functions as F

    from statfold.llm.common import cut_pieces

    def took(n):
        df = spark.range(1).select(F.repeat(F.lit("abcdefgh"), F.lit(n // 8) + F.col("id").cast("int")).alias("t"))
        start = time.time()
        assert df.select(F.size(cut_pieces(F.col("t"), 4096))).first()[0] == n // 4096
        return time.time() - start
    took(1 << 20)
    assert took(1 << 25) < 12 * max(took(1 << 22), 0.5)
