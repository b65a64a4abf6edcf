"""The registered queries on the smallest tables, against their SQL or a plain version in Python."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from test_llm import fingerprint
from versewise.llm import queries

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def texts(con):
    return [(i, t or "") for i, t in con.execute("select doc_id, text from documents order by doc_id desc").fetchall()]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DIR)
    want = con.execute(queries.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_order_minhash_query(spark, con):
    rows = texts(con)
    want, hexed = {}, lambda fp: "".join("." * 16 if x is None else f"{x % (1 << 64):016x}" for x in fp)
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(following)

        def near(x, y):
            either = [(p, q) for p, q in zip(x, y) if p is not None or q is not None]
            return sum(p == q for p, q in either) / len(either) if either else 1.0

        want[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c))
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in queries.op6_order_minhash(spark, DIR).collect()}
    assert got == want


def test_token_store_query(spark, con):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), 0, {}
    for i, text in reversed(texts(con)):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_store(spark, DIR).collect()} == want


def test_personal_data_query(spark, con):
    """Base spans by the plain patterns of the contract; all spans hold them."""
    import re

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    got = {r.doc_id: r for r in queries.op4_personal_data(spark, DIR).collect()}
    for i, text in texts(con):
        spans = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if good(k, m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in plain] == [sum(s[0] == k for s in spans) for k in plain]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(got[i].spans.split(","))
